"""SimHash near-duplicates by covering locality-sensitive hashing.

A text gets a 64-bit fingerprint. Two fingerprints are linked if they differ in at most
``RADIUS`` = 2 bits; linked texts form components. Links are found without comparing pairs:

1. Covering: every bit position has a nonzero code of three bits; every nonzero mask code keeps
   the positions whose code has an odd inner product with it (36 or 37 of 64). For two differing
   positions there is a mask code orthogonal to both of their codes, so that mask drops both:
   any pair within the radius has equal kept bits in at least one of the seven tables.
   Fingerprints alone in all their buckets have no partner.
2. Inside a bucket partners differ in dropped bits only. Two fingerprints are within two bits if,
   and only if, some value is within one bit of both. So each member lists itself and its
   one-bit neighbours over the dropped positions, and those that meet at a value are linked to the
   smallest among them. A value has at most 65 distinct members, whatever the size of the
   bucket: no pairs are spelled out and nothing is capped.

Equal fingerprints are one class from the start, so that thousands of copies are one row.
Components are made by contraction, in shared storage, never on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import read, split_marked, stored, word_blocks

SHINGLE, RADIUS, SEED = 3, 2, 42
BITS = 64


def _covering_masks() -> list[int]:
    """Seven masks; position i has code i mod 7 + 1, a mask keeps odd inner products."""
    codes = [position % 7 + 1 for position in range(BITS)]
    return [
        sum(1 << at for at, code in enumerate(codes) if (code & mask).bit_count() % 2)
        for mask in range(1, 2 ** (RADIUS + 1))
    ]


MASKS = _covering_masks()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every shingle of ``words``, of which there are at least ``size``."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    values = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    return np.array(values, "<u8")


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """A bit is set if it is set in more than half of the shingle hashes; no words give zero."""
    ones, total, words = np.zeros(BITS, np.int64), 0, []
    for block in word_blocks((text or b"").lower()):
        words += block
        if len(words) >= size:
            hashes = _hashes(words, size)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
            words = words[len(words) - size + 1 :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(fingerprint(text.as_py(), size)) for text in batch.column("text")]
            others = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in others), pa.array(prints, pa.int64())], [*others, "print"]
            )

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *carry, print): the fingerprint of every text as a signed 64-bit number."""
    names = ["doc_id", *carry]
    schema = ", ".join(f"{name} {docs.schema[name].dataType.simpleString()}" for name in names)
    rows = docs.select(*names, F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(size), f"{schema}, print bigint")


def links(classes: DataFrame) -> DataFrame:
    """(a, b) with b < a: links that connect all distinct fingerprints (``print``) within two bits."""
    masks = F.array(*[F.lit(_signed(mask)) for mask in MASKS])
    keys = classes.select("print", F.posexplode(masks).alias("table", "mask")).select(
        "print", "table", F.col("print").bitwiseAND(F.col("mask")).alias("key")
    )
    crowded = keys.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = keys.join(crowded.select("table", "key"), ["table", "key"], "left_semi").select("print", "table")
    flips = [
        F.array(*[F.lit(0)], *[F.lit(_signed(1 << at)) for at in range(BITS) if not mask >> at & 1])
        for mask in MASKS
    ]
    flip = F.explode(F.element_at(F.array(*flips), F.col("table") + 1))
    met = members.select("print", flip.alias("flip")).select(
        "print", F.col("print").bitwiseXOR(F.col("flip")).alias("value")
    )
    groups = met.groupBy("value").agg(F.collect_set("print").alias("prints")).where(F.size("prints") > 1)
    pairs = groups.select(F.explode("prints").alias("a"), F.array_min("prints").alias("b"))
    return pairs.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) edges: the smallest node of its component.

    Each round maps every node to the smallest of itself and its neighbours and keeps the edges
    between what is left; a round of a long chain leaves about a third of it. Both tables are
    stored after each round.
    """
    edges = stored(edges, "edges")
    roots = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = roots.withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        steps = both.groupBy("a").agg(F.min("b").alias("low"))
        steps = stored(steps.select("a", F.least("a", "low").alias("low")), "steps")
        step_of = lambda name: steps.select(F.col("a").alias(name), F.col("low").alias(f"{name}_low"))
        roots = stored(
            roots.join(step_of("root"), "root", "left").select(
                "node", F.coalesce("root_low", "root").alias("root")
            ),
            "roots",
        )
        moved = edges.join(step_of("a"), "a").join(step_of("b"), "b")
        edges = stored(
            moved.where("a_low <> b_low")
            .select(F.col("a_low").alias("a"), F.col("b_low").alias("b"))
            .distinct(),
            "edges",
        )
    return roots


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, print, component_id): fingerprint and smallest doc_id that links reach.

    Null and empty texts have fingerprint zero and are linked like others. ``docs`` may have any
    other columns. Repeated rows of one doc_id with one text are returned as often as they come.
    """
    return _grouped(docs, size).select("doc_id", "print", "component_id")


def _grouped(docs: DataFrame, size: int, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *carry, print, root, component_id), ``root`` being the component's own key."""
    prints = stored(fingerprints(docs, size, carry), "fingerprints")
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    classes = stored(classes, "classes")
    roots = components(links(classes))
    placed = classes.join(roots, classes["print"] == roots["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = placed.join(lowest, "root").select(F.col("print").alias("class"), "root", "component_id")
    return prints.join(placed, prints["print"] == placed["class"]).select(
        prints["doc_id"], *(prints[name] for name in carry), prints["print"], "root", "component_id"
    )


def text_digest(docs: DataFrame) -> Column:
    return F.sha2(F.coalesce(docs["text"], F.lit("")), 256)


def keep_first(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of every component, that of its smallest doc_id, all columns as they came.

    A component is known by its fingerprints and a row by doc_id and text, so different texts under
    one doc_id are what their fingerprints make them. Of one doc_id's texts in a component the one
    with the least SHA-256 stays, of repeated rows one. Rows without doc_id link others but stay
    themselves. Rows are held against the (doc_id, text) pairs that go, fewer than those that stay; a
    filter of fixed size tells beforehand which rows may be among these, and only their texts are moved.
    """
    digest = text_digest(docs)
    known = _grouped(docs.select("doc_id", "text", digest.alias("digest")), size, ["digest"]).where("doc_id IS NOT NULL")
    rows = stored(known.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n")), "rows")
    keepers = rows.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("stays")).select("root", "stays.*")
    keepers = stored(keepers, "keepers")
    pairs = lambda some: some.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    gone = stored(pairs(rows.join(keepers, ["root", "doc_id", "digest"], "left_anti")), "gone")
    often = stored(pairs(rows.where("n > 1").join(keepers, ["root", "doc_id", "digest"], "left_semi")), "often")
    same = lambda some, other: (some["doc_id"] == other["_id"]) & (text_digest(some) == other["_digest"])
    asked, clear = split_marked(docs, [docs["doc_id"], digest], gone.union(often))
    left = stored(asked.join(gone, same(asked, gone), "left_anti"), "left")
    repeated = left.join(often, same(left, often), "left_semi").withColumn("_digest", text_digest(left))
    repeated = repeated.dropDuplicates(["doc_id", "_digest"]).drop("_digest")
    return clear.unionByName(left.join(often, same(left, often), "left_anti")).unionByName(repeated)


def hex64(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def op7_simhash_near_dedup(spark, folder: str) -> DataFrame:
    found = near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", hex64(F.col("print")).alias("fingerprint"), "component_id")
