"""Units of a text for byte-level BPE tokenizers, and what the tokenizers library makes of them.

Before its merges such a tokenizer cuts a text with a pattern whose matches never run from a
character into the white space behind it. So a text falls into units, white space and what
follows it up to the next white space, that are tokenized as if they stood alone. Units repeat
far more often than texts; each is given to the library once per worker and remembered.

Matches do not run from letters into digits or punctuation either, nor from digits into letters or
punctuation, nor, but for the apostrophe of ``'s``, from punctuation into letters. ``cuts`` finds
all these places in the bytes of many texts at once, which leaves fewer different units.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has one task per core already

from tokenizers import Tokenizer  # noqa: E402

#: Characters with the property White_Space.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_BYTES = tuple(c.encode() for c in re.findall(f"[{BLANK}]", "".join(map(chr, range(1 << 14)))))
UNIT = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
#: A worker remembers so many units at most in each of two generations, none longer than so many
#: characters.
REMEMBERED, LONGEST = 800_000, 64

#: Kinds of bytes, and the pairs of kinds that no match has in its middle. Bytes of other characters
#: than the letters from U+00C0 to U+00FF are ``OTHER``: what they are is not looked up.
WHITE, LETTER, DIGIT, MARK, APOSTROPHE, OTHER = range(6)
APART = {
    *((kind, WHITE) for kind in (LETTER, DIGIT, MARK, APOSTROPHE, OTHER)), *((LETTER, kind) for kind in (DIGIT, MARK, APOSTROPHE)),
    *((DIGIT, kind) for kind in (LETTER, MARK, APOSTROPHE)), (MARK, LETTER), (MARK, DIGIT), (APOSTROPHE, DIGIT),
}
_KINDS = bytes(
    WHITE if b in b"\t\n\x0b\f\r " else APOSTROPHE if b == 39 else OTHER if b < 33 or b > 126
    else DIGIT if chr(b).isdigit() else LETTER if chr(b).isalpha() else MARK for b in range(256)
)
_CUTS = bytes((b >> 3, b & 7) in APART for b in range(256))
#: Wide white space before other white space, with which it is one run.
_RUN_ON = re.compile(b"(?:" + b"|".join(blank for blank in BLANK_BYTES if len(blank) > 1) + rb")(?=[\t-\r ])")


def units(text: str) -> list[str]:
    return UNIT.findall(text)


def cuts(data: bytes, whole: list[bytes]) -> np.ndarray:
    """For every byte, and the end, whether a unit may begin there; strings of ``whole`` are not cut.

    ``data`` is text in UTF-8.
    """
    if not data:
        return np.zeros(1, bool)
    kinds, codes = np.frombuffer(bytearray(data.translate(_KINDS)), np.uint8), np.frombuffer(data, np.uint8)
    lead = np.flatnonzero(codes[:-1] == 0xC3)  # from U+00C0 to U+00FF, letters but for the signs of times and division
    lead = lead[(codes[lead + 1] != 0x97) & (codes[lead + 1] != 0xB7)]
    kinds[lead] = kinds[lead + 1] = LETTER
    pairs = (kinds[:-1] << 3) | kinds[1:]
    found = np.frombuffer(bytearray(b"\0" + pairs.tobytes().translate(_CUTS) + b"\0"), bool)
    if not data.isascii():
        found[[match.end() for match in _RUN_ON.finditer(data)]] = False
    for string in whole:
        at = data.find(string)
        while at >= 0:
            found[at + 1 : at + len(string)] = False
            at = data.find(string, at + 1)
    return found


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def load(path: str) -> Tokenizer:
    """The tokenizer of a file whose units may be taken alone; others are refused."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    cut = described["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    stripping = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in described["added_tokens"])
    if not plain or described["normalizer"] or described["model"]["type"] != "BPE" or stripping:
        raise ValueError(f"{path}: only byte-level BPE without normalizer is cut into units")
    return Tokenizer.from_file(path)


class Memory(dict):
    """Unit -> value; ``make`` gets the sorted units that are missing and yields their values.

    When it is full, what was used since the last time stays for one more generation.
    """

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def values_of(self, texts: list[list[str]]) -> list[list]:
        """The values of the units of every text."""
        found = [list(map(self.get, text)) for text in texts]
        holes = [at for at, values in enumerate(found) if None in values]
        missing = set()
        for at in holes:
            missing.update(unit for unit, value in zip(texts[at], found[at], strict=True) if value is None)
        fresh = {unit: self.older[unit] for unit in missing & self.older.keys()}
        missing = sorted(missing.difference(fresh))
        fresh |= zip(missing, self.make(missing), strict=True)
        if len(self) + len(fresh) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        self.update((unit, value) for unit, value in fresh.items() if len(unit) <= LONGEST)
        for at in holes:
            found[at] = [fresh[unit] if value is None else value for unit, value in zip(texts[at], found[at], strict=True)]
        return found
