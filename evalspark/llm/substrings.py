"""Removal of long repeated word sequences by a compacted De Bruijn graph.

An edge is a window of 35 consecutive words of a document (from its first 34 words to its last
34). The words of an edge that occurs twice anywhere are removed. The graph is never spelled out:

1. Every window has a minimizer, the least hash among its 12-word k-mers. Equal windows have
   equal minimizers, so only windows whose minimizer occurs twice can be repeated. Occurrences are
   counted with Spark; the repeated minimizers go into a Bloom filter of fixed size
   (``FILTER_BYTES``), the only thing that is broadcast. A full filter costs work, not rows.
2. Consecutive windows around one occurrence of a repeated minimizer are a path, kept as one row:
   minimizer, source coordinates, a 128-bit digest of its words, its edge hashes. Joins compact
   the graph: a path that occurs twice is repeated as a whole.
3. Only at branching minimizers, those with several distinct paths, single edges matter. Their
   distinct paths are taken apart, each counted as often as it occurs, and the edges found twice
   mark the paths that occur once, by their source coordinates.

Thousands of copies are one distinct path; a passage shared by many documents makes its minimizers
hot only on the left of semi joins, which adaptive execution splits, and in combined counts.
Equality rests on digests of the words at the coordinates: 128 bits for a path, and 64 bits of
the edge besides 64 bits of its minimizer for an edge.

Null texts have no words. Windows do not cross documents. Repeated rows of a document are copies
of each other, so their windows are removed; rows of one doc_id with different texts are kept
apart by a hash of the text. A text is worked on in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import read, stored, word_blocks

WINDOW, KMER = 35, 12
FILTER_BYTES, PAGE_BYTES = 1 << 24, 1 << 12
#: Words that are worked on at once, about; positions in a block need less than 2 ** PLACE_BITS.
BLOCK_WORDS, PLACE_BITS = 400_000, 21
BASE = 0x9E3779B97F4A7C15
U64 = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    values = np.full(n, base, U64)
    values[0] = 1
    return np.multiply.accumulate(values)


def _mix(values: np.ndarray) -> np.ndarray:
    """The bijective finalizer of MurmurHash3, which spreads all bits."""
    values = (values ^ (values >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> U64(33))


class Block:
    """Words of several texts, or of a part of one; ``segments`` are (row, first word, length)."""

    def __init__(self, segments: list[tuple[int, int, int]], words: list[bytes], window: int, kmer: int) -> None:
        self.words, self.window = words, window
        n = len(words)
        rows, firsts, sizes = (np.array(part, np.int64) for part in zip(*segments, strict=True))
        begins = np.cumsum(sizes) - sizes
        counts = np.maximum(sizes - window + 1, 0)
        owner = np.repeat(np.arange(len(sizes)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        #: of every window: the place of its first word, row, and number of the first word in its text
        self.places = begins[owner] + within
        self.rows, self.firsts = rows[owner], firsts[owner] + within
        if not len(self.places):
            return
        codes = np.fromiter(map(xxhash.xxh64_intdigest, words), U64, n)
        powers = _powers(BASE, n + 1)
        self.inverse = _powers(pow(BASE, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(codes * powers[:n], out=self.sums[1:])
        kmers = self._hashes(kmer)
        least = (kmers >> U64(PLACE_BITS) << U64(PLACE_BITS)) | np.arange(len(kmers), dtype=U64)
        span, reach = window - kmer + 1, 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(least) - span + reach], least[span - reach :])
        self.minimizer_places = (least[self.places] & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
        self.minimizers = kmers[self.minimizer_places]
        same = (self.minimizer_places[1:] == self.minimizer_places[:-1]) & (owner[1:] == owner[:-1])
        #: the first window of every run of windows with one occurrence of a minimizer
        self.runs = np.flatnonzero(np.concatenate([[True], ~same]))

    def _hashes(self, size: int) -> np.ndarray:
        ends = self.sums[size:] - self.sums[:-size]
        return _mix(ends * self.inverse[: len(ends)])

    def edges(self) -> np.ndarray:
        return self._hashes(self.window)[self.places]


def blocks(texts: list[bytes | None], window: int, kmer: int) -> Iterator[Block]:
    segments, words = [], []
    for row, text in enumerate(texts):
        first, tail = 0, []
        for part in word_blocks(text or b""):
            piece = tail + part
            segments.append((row, first, len(piece)))
            words += piece
            tail = piece[max(0, len(piece) - window + 1) :]
            first += len(piece) - len(tail)
            if len(words) >= BLOCK_WORDS:
                yield Block(segments, words, window, kmer)
                segments, words = [], []
    if segments:
        yield Block(segments, words, window, kmer)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64))


def _count_minimizers(window: int, kmer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0).to_pylist(), window, kmer):
                if len(block.places):
                    values, counts = np.unique(block.minimizers[block.runs], return_counts=True)
                    yield pa.RecordBatch.from_arrays([_signed(values), _signed(counts)], ["m", "n"])

    return run


def _filter_bits(values: np.ndarray) -> list[np.ndarray]:
    """Three bits of a value inside its page, as (page, bit) packed into one number."""
    page_bits = PAGE_BYTES * 8
    page = (values % U64(FILTER_BYTES // PAGE_BYTES)) * U64(page_bits)
    return [page + ((values >> U64(shift)) % U64(page_bits)) for shift in (16, 32, 48)]


def _fill_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages: dict[int, np.ndarray] = {}
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
        for bits in _filter_bits(values):
            page = (bits // U64(PAGE_BYTES * 8)).astype(np.int64)
            order = np.argsort(page, kind="stable")
            cuts = np.flatnonzero(np.diff(page[order])) + 1
            for group in np.split(order, cuts) if len(order) else []:
                own = pages.setdefault(int(page[group[0]]), np.zeros(PAGE_BYTES, np.uint8))
                inside = bits[group] % U64(PAGE_BYTES * 8)
                np.bitwise_or.at(own, (inside >> U64(3)).astype(np.int64), np.left_shift(np.uint8(1), (inside & U64(7)).astype(np.uint8)))
    if pages:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(pages), pa.int64()), pa.array([p.tobytes() for p in pages.values()], pa.binary())], ["page", "bits"]
        )


def repeated_filter(docs: DataFrame, window: int, kmer: int) -> bytes:
    """The Bloom filter of the minimizers that occur at least twice; its size is fixed."""
    seen = docs.select(F.col("text").cast("binary")).mapInArrow(_count_minimizers(window, kmer), "m bigint, n bigint")
    twice = seen.groupBy("m").agg(F.sum("n").alias("n")).where("n > 1").select("m")
    pages = FILTER_BYTES // PAGE_BYTES
    page = F.pmod(F.col("m"), F.lit(pages))  # pages are a power of two, so the sign does not matter
    filled = twice.repartition(page).mapInArrow(_fill_pages, "page bigint, bits binary")
    bits = bytearray(FILTER_BYTES)
    for row in filled.toLocalIterator():
        bits[row["page"] * PAGE_BYTES : (row["page"] + 1) * PAGE_BYTES] = row["bits"]
    return bytes(bits)


def _find_paths(shared, window: int, kmer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, versions = batch.column(0), batch.column(1)
            for block in blocks(batch.column(2).to_pylist(), window, kmer):
                if not len(block.places):
                    continue
                runs = block.runs
                ends = np.append(runs[1:], len(block.places))
                known = np.ones(len(runs), bool)
                for at in _filter_bits(block.minimizers[runs]):
                    known &= (bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1) == 1
                runs, ends = runs[known], ends[known]
                if not len(runs):
                    continue
                sizes = ends - runs
                places = block.places[runs]
                digests = [
                    xxhash.xxh3_128_digest(b" ".join(block.words[a : a + size + window - 1]))
                    for a, size in zip(places.tolist(), sizes.tolist(), strict=True)
                ]
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                chosen = np.repeat(runs, sizes) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
                edges = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _signed(block.edges()[chosen]))
                rows = pa.array(block.rows[runs])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(rows), versions.take(rows), pa.array(block.firsts[runs]),
                        _signed(block.minimizers[runs]), pa.array(digests, pa.binary()), edges,
                    ],
                    ["doc_id", "version", "start", "m", "path", "edges"],
                )

    return run


def _versions(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("version"), text.alias("text"))


def repeated_paths(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc_id, version, start, m, path, edges): all paths around minimizers that may be repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated_filter(docs, window, kmer))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _versions(docs).select("doc_id", "version", F.col("text").cast("binary"))
    schema = f"doc_id {kind}, version bigint, start bigint, m bigint, path binary, edges array<bigint>"
    return rows.mapInArrow(_find_paths(shared, window, kmer), schema)


def repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc_id, version, start, end) in words from 0: what windows that occur twice cover, with overlaps."""
    paths = stored(repeated_paths(docs, window, kmer), "paths")
    counts = stored(paths.groupBy("m", "path").agg(F.count("*").alias("n")), "path-counts")
    source = ["doc_id", "version", "start"]
    whole = paths.join(counts.where("n > 1"), ["m", "path"], "left_semi").select(
        *source, (F.col("start") + F.size("edges") + window - 1).alias("end")
    )
    branching = counts.groupBy("m").agg(F.count("*").alias("ways")).where("ways > 1")
    forked = paths.join(branching, "m", "left_semi").groupBy("m", "path").agg(
        *[F.first(name).alias(name) for name in (*source, "edges")], F.count("*").alias("n")
    )
    forked = stored(forked.select("m", "n", *source, F.posexplode("edges").alias("at", "h")), "edges")
    twice = forked.groupBy("m", "h").agg(F.sum("n").alias("total")).where("total > 1")
    single = forked.where("n = 1").join(twice, ["m", "h"], "left_semi").select(
        "doc_id", "version", (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("at") + window).alias("end")
    )
    return whole.unionByName(single)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            spans = spans.as_py() or []
            gone, kept, base, at = 0, [], 0, 0
            for words in word_blocks(text.as_py() or b""):
                stop, last = base + len(words), base
                while at < len(spans) and spans[at]["start"] < stop:
                    begin, end = max(spans[at]["start"], last), min(spans[at]["end"], stop)
                    if end > begin:
                        kept += words[last - base : begin - base]
                        gone += end - begin
                        last = end
                    if spans[at]["end"] > stop:
                        break
                    at += 1
                kept += words[last - base :]
                base = stop
            out.append((base, gone, b" ".join(kept)))
        counts, removed, texts = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(texts, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256): ``kept`` is UTF-8, words joined by a blank."""
    spans = repeated_spans(docs, window, kmer).groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")
    )
    spans = spans.select(F.col("doc_id").alias("of_id"), F.col("version").alias("of_version"), "spans")
    rows = _versions(docs)
    found = rows.join(spans, rows["doc_id"].eqNullSafe(F.col("of_id")) & (F.col("version") == F.col("of_version")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary, kept_sha256 string"
    return found.select("doc_id", F.col("text").cast("binary"), "spans").mapInArrow(_remove, schema)


def op6_substring_dedup(spark, folder: str) -> DataFrame:
    found = remove_repeats(read(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
