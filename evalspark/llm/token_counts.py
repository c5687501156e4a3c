"""Exact token counts of every prefix of a text by dynamic programming.

The encoding of a byte string by BPE ends in one token, and without that token it is the encoding
of a shorter prefix. So one table over the prefixes is enough: for every prefix its last token and
its number of tokens, found from the shorter ones. A token may follow the last token of a shorter
prefix if no merge across their border comes before the merges that make the two; this is
decided from the merge ranks of the parts at the border and remembered per pair of tokens.

The counts of all prefixes of a text (in characters) are kept as differences, compressed: the
index. It answers how many tokens a prefix has, and how long a prefix fits a budget, without
encoding again. Counts are not monotone: a longer prefix can have fewer tokens.

Null texts are empty and have no tokens. Repeated rows are counted each for itself. Special
strings inside a text are one token, as the library's default has it.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import cache
from operator import sub

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import read
from evalspark.llm.vocabulary import BLANK, Memory, load, public_path, units

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
#: The public pattern that byte-level BPE cuts with, white space spelled out.
CUT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
)
RUN = regex.compile(f"[{BLANK}]+")
#: Texts that a worker holds at once, in characters.
GROUP = 2_000_000
PAIRS = 1_000_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix tables for one tokenizer file."""

    def __init__(self, path: str) -> None:
        load(path)  # refuses what is not cut into units
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters = _byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        self.rank: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in described["model"]["merges"]:
            left, right = (spell(part) for part in (merge.split(" ") if isinstance(merge, str) else merge))
            pair = self.rank[left], self.rank[right]
            self.merged[pair] = self.rank[left + right] = len(self.parts)
            self.parts.append(pair)
        self.longest = max(map(len, self.rank))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in described["added_tokens"]) or "(?!)")
        self.shortest_special = min((len(t["content"]) for t in described["added_tokens"]), default=1)
        self.follows: dict[tuple[int, int], bool] = {}
        self.latest: tuple[bytes, list[int], list[int]] = b"", [0], [-1]
        self.short: dict[str, list[int]] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` side by side stay apart."""
        pair = left, right
        known = self.follows.get(pair)
        if known is None:
            if len(self.follows) > PAIRS:
                self.follows.clear()
            known = self.follows[pair] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        # undo the later of the two tokens' merges step by step; a border merge that would have
        # come before the one just undone joins them
        before = len(self.parts)
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                before, left = left, self.parts[left][1]
            else:
                before, right = right + 1, self.parts[right][0]

    def piece(self, data: bytes) -> list[int]:
        """The number of tokens of every prefix of a byte string, from the empty one on.

        What it has in common with the piece before is not done again; pieces come sorted.
        """
        rank, (before, counts, last) = self.rank, self.latest
        same = 0
        for a, b in zip(data, before, strict=False):
            if a != b:
                break
            same += 1
        counts, last = counts[: same + 1], last[: same + 1]
        for end in range(same + 1, len(data) + 1):
            for begin in range(max(0, end - self.longest), end):
                token = rank.get(data[begin:end])
                if token is not None and (not begin or self.may_follow(last[begin], token)):
                    last.append(token)
                    counts.append(counts[begin] + 1)
                    break
        self.latest = data, counts, last
        return counts

    def _characters(self, text: str) -> list[int]:
        """``piece`` at the ends of characters, without the empty prefix."""
        data = text.encode()
        if len(text) < 3:  # punctuation, mostly, that would come between sorted words
            if text not in self.short:
                if len(self.short) > PAIRS:
                    self.short.clear()
                self.latest, latest = (b"", [0], [-1]), self.latest
                self.short[text] = self._ends(data, self.piece(data))
                self.latest = latest
            return self.short[text]
        return self._ends(data, self.piece(data))

    @staticmethod
    def _ends(data: bytes, counts: list[int]) -> list[int]:
        if data.isascii():
            return counts[1:]
        return [counts[end + 1] for end in range(len(data)) if end + 1 == len(data) or data[end + 1] & 0xC0 != 0x80]

    def _plain(self, text: str) -> list[int]:
        """Counts of all prefixes of a text without special strings."""
        counts, total = [], 0
        pieces = [match.span() for match in CUT.finditer(text)]
        if len(pieces) == 1 and pieces[0][1] - pieces[0][0] != 3:
            return self._characters(text)
        runs = {match.start(): match.end() for match in RUN.finditer(text)}
        blank_until = 0
        for start, end in pieces:
            own = self._characters(text[start:end])
            if end - start == 3 and text[start:end] in ("'re", "'ve", "'ll"):
                own[1] = 2  # a prefix that ends before the last letter is not cut as one piece
            if start in runs and runs[start] - start > 1:
                # white space at the end of a prefix is one piece, however it is cut further on
                counts += [total + n for n in self._characters(text[start : runs[start]])]
                blank_until = runs[start]
            counts += [total + n for n in own[max(0, blank_until - start) :]]
            total += own[-1]
        return counts

    def prefixes(self, unit: str) -> list[int]:
        """Counts of all prefixes of a unit, the whole last."""
        counts, total, at = [], 0, 0
        if len(unit) < self.shortest_special:
            return self._plain(unit)
        for match in self.special.finditer(unit):
            inside = self._plain(unit[at : match.end() - 1])
            counts += [total + n for n in inside]
            before = match.start() - at
            total += (inside[before - 1] if before else 0) + 1
            counts.append(total)
            at = match.end()
        return counts + [total + n for n in (self._plain(unit[at:]) if at < len(unit) else [])]

    def differences(self, unit: str) -> bytes:
        counts = self.prefixes(unit)
        return array("h", map(sub, counts, [0, *counts])).tobytes()


@cache
def _memory(path: str) -> Memory:
    counter = PrefixCounter(path)
    return Memory(lambda missing: map(counter.differences, missing))


def prefix_index(texts: list[str], path: str) -> list[bytes]:
    """The differences of the prefix counts of every text."""
    return [b"".join(parts) for parts in _memory(path).values_of([units(text) for text in texts])]


def unpack(index: bytes) -> np.ndarray:
    """The counts of all prefixes, from the empty one on."""
    differences = np.frombuffer(zstandard.ZstdDecompressor().decompress(index), "<i2")
    return np.concatenate([[0], np.cumsum(differences, dtype=np.int64)])


def tokens_of_prefix(index: bytes, n_chars: int) -> int:
    counts = unpack(index)
    return int(counts[min(n_chars, len(counts) - 1)])


def longest_within(index: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    return int(np.flatnonzero(unpack(index) <= budget)[-1])


def _index_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for rows in groups(texts):
                own = texts[rows]
                indexes = prefix_index(own, path)
                totals = [int(np.frombuffer(index, "<i2").sum(dtype=np.int64)) for index in indexes]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[rows], pa.array([len(text.encode()) for text in own], pa.int64()),
                        pa.array(totals, pa.int64()), pa.array(map(pack.compress, indexes), pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "index"],
                )

    return run


def groups(texts: list[str]) -> Iterator[slice]:
    """Consecutive texts of about ``GROUP`` characters together."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= GROUP or at + 1 == len(texts):
            yield slice(start, at + 1)
            start, size = at + 1, 0


def token_index(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, index) per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _index_rows(path), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, index binary"
    )


def op5_token_counts(spark, folder: str) -> DataFrame:
    found = token_index(read(spark, folder, "documents"), public_path(VOCABULARY))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
