"""Token-id files coded by a canonical length-limited Huffman code.

Code lengths come from the counts of all ids (package-merge, at most ``MAX_BITS`` bits), codes are
canonical, so the codebook is only (id, length). A document's ids start at a byte, after every
``CHECKPOINT`` ids the bit offset is noted, and what lies between two checkpoints can be decoded
without the rest: the decoder runs through all such stretches at once, looking up
``MAX_BITS`` bits at a time in a table.

A folder holds ``ids`` (rows of one document in ascending order of doc_id, numbered shards, each
shard sorted: shard, first id of the document in the shard, number of ids, payload, checkpoints),
``codebook`` and ``shards`` (number of the first id of each shard). All are Parquet written by
Spark, so that a lost task is repeated and any store will do. Texts are tokenized once; the ids are
kept in shared storage between counting and coding.

Null texts are empty and have the end id alone. Null doc_ids come first; rows with one doc_id
follow each other, the order among different texts is that of a checksum. No rows give empty
tables. ``docs`` may have any other columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import compress, filterfalse
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.common import read, shared_folder, stored, tasks_for
from evalspark.llm.vocabulary import BLANK_BYTES, LONGEST, cuts, load, public_path

VOCABULARY, END = "byte_bpe_50k.json", 0
MAX_BITS, CHECKPOINT = 20, 512
#: Ids that are coded at once, about, so that what is made of them stays in the caches; and decoded at
#: once, where many stretches share every step.
CODED_IDS, DECODED_IDS = 100_000, 1_000_000
#: Units that are given to the library as one text, and texts that are given to it at once.
ROW, ROWS = 500, 16
#: Texts that are cut at once, in bytes, about.
CUT_BYTES = 4_000_000
#: A worker remembers so many units at most, none longer than ``LONGEST`` bytes.
REMEMBERED = 1_200_000
LAST_BYTES = frozenset(blank[-1] for blank in BLANK_BYTES)


def token_lengths(tokenizer) -> np.ndarray:
    """Bytes of text of every id: a character of a byte-level token is a byte, added tokens are as written."""
    lengths = {i: len(token) for token, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    lengths |= {i: len(token.content.encode()) for i, token in tokenizer.get_added_tokens_decoder().items()}
    table = np.zeros(max(lengths, default=-1) + 1, np.int64)
    table[list(lengths)] = list(lengths.values())
    return table


def _width(tokenizer) -> np.dtype:
    return np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


def _stands_apart(unit: bytes) -> bool:
    """Begins with white space and ends without it; with wide white space in front it is not looked at."""
    return unit[0] in b"\t\n\x0b\f\r " and (unit[-1] not in LAST_BYTES or not unit.endswith(BLANK_BYTES))


def _encode_units(tokenizer, lengths: np.ndarray, units: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The units in another order, the ids of all of them, and how many each has.

    A unit that begins with white space and ends without it is tokenized after another such unit as
    it is alone, so many are given to the library in one row; the others are given one by one. Where
    a unit ends among the ids of its row follows from the lengths of the tokens.
    """
    width, order, ids, sizes = _width(tokenizer), [], [], []
    apart = list(map(_stands_apart, units))
    alone, units = list(compress(units, map(not_, apart))), list(compress(units, apart))
    rows = [units[start : start + ROW] for start in range(0, len(units), ROW)]
    for start in range(0, len(rows), ROWS):
        some = rows[start : start + ROWS]
        texts = [b"".join(row).decode() for row in some]
        for row, encoded in zip(some, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            found = np.array(encoded.ids, width)
            ends, bounds = np.cumsum(np.array(list(map(len, row)), np.int64)), np.cumsum(lengths[found])
            last = np.searchsorted(bounds, ends)  # the last id of every unit
            if last[-1] + 1 != len(found) or (bounds[last] != ends).any():
                alone += row  # a token runs over the end of a unit
                continue
            order += row
            ids.append(found)
            sizes.append(np.diff(last, prepend=-1))
    for start in range(0, len(alone), ROW):
        some = alone[start : start + ROW]
        encoded = [found.ids for found in tokenizer.encode_batch_fast([unit.decode() for unit in some], add_special_tokens=False)]
        order += some
        ids += [np.array(found, width) for found in encoded]
        sizes.append(np.array(list(map(len, encoded)), np.int64))
    return order, np.concatenate([np.zeros(0, width), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])


class Units:
    """The ids of the units that a worker has met, one after the other, and the number of every unit.

    It begins anew when it is full. Long units are forgotten after each call.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.lengths = tokenizer, token_lengths(tokenizer)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids, self.sizes = np.zeros(0, _width(self.tokenizer)), np.zeros(0, np.int64)

    def add(self, units: list[bytes]) -> None:
        order, ids, sizes = _encode_units(self.tokenizer, self.lengths, units)
        self.numbers.update(zip(order, range(len(self.sizes), len(self.sizes) + len(order)), strict=True))
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def of(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, sizes, ids): the number of every unit, and by number the sizes and ids of all."""
        missing = list(filterfalse(self.numbers.__contains__, units))
        if len(self.numbers) + len(missing) > REMEMBERED:
            self.forget()
            missing = units
        long = [unit for unit in missing if len(unit) > LONGEST]
        self.add([unit for unit in missing if len(unit) <= LONGEST] if long else missing)
        kept = self.ids, self.sizes
        if long:
            self.add(long)
        found = np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units)), self.sizes, self.ids
        for unit in long:
            del self.numbers[unit]
        self.ids, self.sizes = kept
        return found


@cache
def _memory(path: str) -> Units:
    return Units(load(path))


def _encode_texts(path: str, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, ``end`` behind each, and where those of each text end.

    Every different unit of the texts is looked up once; the ids are gathered by its number.
    """
    tokenizer, data = load(path), b"".join(texts)
    ends = np.cumsum(np.array(list(map(len, texts)), np.int64))
    begins = cuts(data, [token.content.encode() for token in tokenizer.get_added_tokens_decoder().values()])
    begins[0] = begins[ends] = True
    bounds = np.flatnonzero(begins).astype(np.int64)
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(data)]
    units = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, buffers).dictionary_encode()
    numbers, sizes, pool = _memory(path).of(units.dictionary.to_numpy(zero_copy_only=False).tolist())
    pool, sizes = np.append(pool, np.array([end], pool.dtype)), np.append(sizes, 1)
    places = np.cumsum(sizes) - sizes
    behind = np.searchsorted(bounds, ends)  # so many units up to the end of each text
    numbers = np.insert(numbers[units.indices.to_numpy()], behind, len(sizes) - 1)
    sizes, places = sizes[numbers], places[numbers]
    stops = np.cumsum(sizes)
    ids = pool[np.repeat(places - stops + sizes, sizes) + np.arange(stops[-1])]
    return ids, stops[behind + np.arange(len(texts))]


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or b"" for text in batch.column(1).cast(pa.binary()).to_pylist()]
            for rows in _slices(list(map(len, texts)), CUT_BYTES):
                ids, ends = _encode_texts(path, texts[rows], end)
                sizes, ends = np.diff(ends, prepend=0), ends.tolist()
                data, full = ids.tobytes(), memoryview(ids.astype("<u4").tobytes())
                spans = list(zip([0, *ends], ends, strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[rows], pa.array([zlib.crc32(full[4 * a : 4 * b]) for a, b in spans], pa.int64()),
                        pa.array([data[ids.itemsize * a : ids.itemsize * b] for a, b in spans], pa.binary()), pa.array(sizes, pa.int64()),
                    ],
                    ["doc_id", "crc", "ids", "n_ids"],
                )

    return run


def token_ids(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, crc, ids, n_ids): ids in two bytes each, or four for a vocabulary beyond 65,536."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _tokenize(path, end), f"doc_id {kind}, crc bigint, ids binary, n_ids bigint"
    )


def _slices(sizes: list[int], ids: int) -> Iterator[slice]:
    start, total = 0, 0
    for at, size in enumerate(sizes):
        total += size
        if total >= ids or at + 1 == len(sizes):
            yield slice(start, at + 1)
            start, total = at + 1, 0


def _unpacked(rows: list[bytes], sizes: list[int]) -> np.ndarray:
    width = "<u2" if len(rows[0]) == 2 * sizes[0] else "<u4"
    return np.frombuffer(b"".join(rows), width).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        rows, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for part in _slices(sizes, CODED_IDS):
            counts = np.bincount(_unpacked(rows[part], sizes[part]))
            if len(counts) > len(total):
                counts, total = total, counts
            total[: len(counts)] += counts
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``most`` bits, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << most:
        raise ValueError(f"{n} ids do not fit codes of {most} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    levels, merged = [], weights
    leaf = np.ones(n, bool)
    for _ in range(most - 1):
        levels.append(leaf)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        merged, leaf = both[by], by < n
    levels.append(leaf)
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:taken].sum())
        lengths[:leaves] += 1
        taken = 2 * (taken - leaves)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: codes ascend with (length, id)."""

    def __init__(self, ids: list[int], lengths: list[int]) -> None:
        ids, lengths = np.array(ids, np.int64), np.array(lengths, np.int64)
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        steps = np.left_shift(1, MAX_BITS - lengths)
        starts = np.cumsum(steps) - steps
        size = int(ids.max()) + 1 if len(ids) else 0
        self.code, self.length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.code[ids], self.length[ids] = starts >> (MAX_BITS - lengths), lengths
        #: for every possible next MAX_BITS bits, the id and in the lowest five bits the length of its code
        self.table = np.repeat((ids << 5 | lengths).astype(np.int32 if size <= 1 << 26 else np.int64), steps)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
        """Payload and checkpoint bit offsets of consecutive documents of ``sizes`` ids."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        firsts = np.cumsum(sizes) - sizes
        before = np.concatenate([[0], ends])
        bits = before[firsts + sizes] - before[firsts]
        n_bytes = (bits + 7) >> 3
        starts = np.cumsum(n_bytes) - n_bytes
        shift = np.repeat(8 * starts - before[firsts], sizes)
        places = before[:-1] + shift
        window = self.code[ids] << (48 - (places & 15) - lengths)
        word = places >> 4
        n_words = int(n_bytes.sum() + 1) // 2 + 3
        words = np.zeros(n_words)
        for part in range(3):
            value = (window >> (32 - 16 * part)) & 0xFFFF
            words += np.bincount(word + part, value, n_words)
        data = words.astype(">u2").tobytes()
        payloads = [data[a : a + n] for a, n in zip(starts.tolist(), n_bytes.tolist(), strict=True)]
        marks = [places[a : a + n : CHECKPOINT] - 8 * b for a, n, b in zip(firsts.tolist(), sizes.tolist(), starts.tolist(), strict=True)]
        return payloads, marks

    def decode(self, payloads: list[bytes], marks: list[list[int]], sizes: np.ndarray) -> np.ndarray:
        """The ids of consecutive documents, every stretch between checkpoints on its own."""
        data = np.frombuffer(b"".join(payloads) + bytes(8), np.uint8).astype(np.uint32)
        ahead = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]  # the 32 bits from every byte on
        n_bytes = np.array([len(payload) for payload in payloads], np.int64)
        starts = 8 * (np.cumsum(n_bytes) - n_bytes)
        lanes = np.array([len(own) for own in marks], np.int64)
        places = np.concatenate([np.asarray(own, np.int64) for own in marks]) + np.repeat(starts, lanes)
        number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        left = np.minimum(np.repeat(sizes, lanes) - CHECKPOINT * number, CHECKPOINT)
        out = np.empty(int(sizes.sum()), np.int64)
        into = np.cumsum(left) - left
        order = np.argsort(-left, kind="stable")
        places, into, left = places[order], into[order], left[order]
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, "left"))
            places, into = places[:live], into[:live]
            bits = ahead[places >> 3] >> (32 - MAX_BITS - (places & 7)).astype(np.uint32) & np.uint32((1 << MAX_BITS) - 1)
            found = self.table[bits]
            out[into + step] = found >> 5
            places = places + (found & 31)
        return out


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows in code, with their shard and the number of the first id of each in it."""
        code, shard, before = Code(*shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, sizes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for part in _slices(sizes, CODED_IDS):
                own = np.array(sizes[part], np.int64)
                payloads, marks = code.encode(_unpacked(rows[part], sizes[part]), own)
                firsts = before + np.cumsum(own) - own
                before += int(own.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), shard, np.int64)), pa.array(firsts), batch.column(0)[part], pa.array(own),
                        pa.array(payloads, pa.binary()), pa.array(marks, pa.list_(pa.int64())),
                    ],
                    ["shard", "first", "doc_id", "n_ids", "payload", "marks"],
                )

    return run


def write_token_files(docs: DataFrame, path: str, folder: str, end: int = END) -> None:
    """Tokenize, count, code and write; the driver holds the codebook, as long as the vocabulary."""
    spark = docs.sparkSession
    ids = stored(token_ids(docs, path, end), "token-ids")
    tallies = ids.select("ids", "n_ids").mapInArrow(_tally, "id bigint, n bigint")
    counts = sorted(tuple(row) for row in tallies.groupBy("id").agg(F.sum("n")).collect())
    lengths = code_lengths(np.array([n for _, n in counts], np.int64)).tolist()
    book = spark.createDataFrame([(i, n) for (i, _), n in zip(counts, lengths, strict=True)], "id bigint, length bigint")
    book.coalesce(1).write.parquet(f"{folder}/codebook")
    shared = spark.sparkContext.broadcast(([i for i, _ in counts], lengths))
    kind = ids.schema["doc_id"].dataType.simpleString()
    # sorted before coding: finding the ranges runs what comes before it a second time
    ordered = ids.repartitionByRange(tasks_for(spark), "doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    schema = f"shard bigint, first bigint, doc_id {kind}, n_ids bigint, payload binary, marks array<bigint>"
    coded = ordered.select("doc_id", "ids", "n_ids").mapInArrow(_encode(shared), schema)
    coded.write.option("compression", "none").parquet(f"{folder}/ids")
    sizes = spark.read.parquet(f"{folder}/ids").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.select("shard", before.alias("start")).write.parquet(f"{folder}/shards")  # a row per file


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*shared.value)
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            for part in _slices(sizes, DECODED_IDS):
                own = np.array(sizes[part], np.int64)
                ids = code.decode(batch.column(3)[part].to_pylist(), batch.column(4)[part].to_pylist(), own)
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(own).tolist()
                texts = [data[4 * (b - n) : 4 * b] for b, n in zip(ends, own.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part], batch.column(1)[part], pa.array(own),
                        pa.array([zlib.crc32(text) for text in texts], pa.int64()), pa.array(texts, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids), ids as little-endian unsigned 32-bit numbers."""
    book = [tuple(row) for row in spark.read.parquet(f"{folder}/codebook").collect()]  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast(([i for i, _ in book], [n for _, n in book]))
    rows, shards = spark.read.parquet(f"{folder}/ids"), spark.read.parquet(f"{folder}/shards")
    placed = rows.join(shards, "shard").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_ids", "payload", "marks")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(
        _decode(shared), f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    )


def op8_token_id_output(spark, folder: str) -> DataFrame:
    target = shared_folder(spark, "token-files")
    write_token_files(read(spark, folder, "documents"), public_path(VOCABULARY), target)
    return read_token_files(spark, target).drop("ids")
