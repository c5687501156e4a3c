"""Exact duplicates by composable polynomial fingerprints, verified chunk by chunk.

The fingerprint of a text is the value of its bytes, read as the coefficients of a polynomial, at
two points modulo two primes below 2^31. It composes: the fingerprint of two parts in a row is that
of the first, multiplied by the base to the length of the second, plus that of the second. So a
text of more than ``HUGE`` bytes is dealt out in pieces, each piece is hashed by any task, shifted
by what follows it, and the sum over its pieces, in any order, is its fingerprint.

Texts of one length and one fingerprint are a class. Its members are then compared byte by byte:

1. In an Arrow batch a member is compared with the first of its class there, and only the first
   goes on: thousands of copies are one row a batch.
2. What is left of a class is dealt into groups of about ``FAN_IN``. A group is a sorted stream of
   chunks, all first chunks, then all second ones; each is compared with the chunk of the first
   member, so a task holds one chunk however long the texts or large the class.
3. The first members of the groups meet in the next level, until a class is one group.

If two members differ, the fingerprints of this base collided: all is done again with another base.
The classes that come back are therefore equal texts and nothing else.

Null texts are empty; empty texts are one class. Of equal texts the row with the largest doc_id
stays (a null doc_id is below all others); of repeated rows of that doc_id exactly one. ``docs`` may
have any other columns and no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator, Sequence
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import read, stored, tasks_for

MODULI = (2**31 - 1, 2**31 - 19)
#: Bytes of a chunk; a product of a byte and a residue has 39 bits, so this many of them have 59.
CHUNK = 1 << 20
#: Texts with more bytes are hashed in pieces by several tasks.
HUGE = 8 << 20
#: Members of a class that are compared in one group.
FAN_IN = 256
#: A class with more than one row in so many is joined by itself: there are at most so many.
HOT = 512

Bases = tuple[int, int]


def fresh_bases(seed: int = 20) -> Iterator[Bases]:
    """Pairs of bases, another for every attempt."""
    for attempt in count(seed):
        draw = random.Random(attempt)
        yield tuple(draw.randrange(1 << 20, modulus) for modulus in MODULI)


@cache
def _powers(base: int, modulus: int) -> np.ndarray:
    """Descending powers of the base down to 1, as many as a chunk has bytes."""
    powers = np.ones(1, np.uint64)
    while len(powers) < CHUNK:
        step = np.uint64(pow(base, len(powers), modulus))
        powers = np.concatenate([powers * step % np.uint64(modulus), powers])
    return powers


def combine(left: tuple[int, int], right: tuple[int, int], length: int, bases: Bases) -> tuple[int, int]:
    """The fingerprint of two parts in a row, the second of ``length`` bytes."""
    return tuple(
        (a * pow(base, length, modulus) + b) % modulus
        for a, b, base, modulus in zip(left, right, bases, MODULI, strict=True)
    )


def fingerprint(data: bytes, bases: Bases) -> tuple[int, int]:
    """The two residues of a text, chunk after chunk."""
    found = (0, 0)
    for start in range(0, len(data), CHUNK):
        part = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - start), start).astype(np.uint64)
        own = tuple(
            int(np.dot(part, _powers(base, modulus)[CHUNK - len(part) :])) % modulus
            for base, modulus in zip(bases, MODULI, strict=True)
        )
        found = own if not start else combine(found, own, len(part), bases)
    return found


def _joined(residues: tuple[int, int]) -> int:
    return residues[0] << 31 | residues[1]


def _leads(texts: list[bytes], prints: list[int]) -> list[bool]:
    """Which texts of a batch are equal to none before them."""
    seen: dict[tuple[int, int], list[bytes]] = {}
    leads = []
    for text, key in zip(texts, zip(map(len, texts), prints, strict=True), strict=True):
        equals = seen.setdefault(key, [])
        lead = not any(text == other for other in equals)
        if lead:
            equals.append(text)
        leads.append(lead)
    return leads


def _print_rows(bases: Bases, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            prints = [_joined(fingerprint(text, bases)) for text in texts]
            made = [
                pa.array(map(len, texts), pa.int64()), pa.array(prints, pa.int64()),
                pa.array(map(int, _leads(texts, prints)), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), *made], [*names, "_length", "_print", "_lead"]
            )

    return run


def _piece_rows(bases: Bases):
    """Every piece's share of the fingerprint: its own, shifted by the bytes that follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [
                combine(fingerprint(piece, bases), (0, 0), after, bases)
                for piece, after in zip(batch.column("_piece").to_pylist(), batch.column("_after").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), *(pa.array([share[at] for share in shares], pa.int64()) for at in (0, 1))],
                ["_row", "_share0", "_share1"],
            )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).drop("text")


def _pieces(text: Column, size: int) -> Column:
    """(_at, _piece): the pieces of a text; an empty text has an empty one."""
    last = F.greatest(F.lit(0), (F.octet_length(text) - 1).cast("int"))
    starts = F.sequence(F.lit(0), F.floor(last / F.lit(size)).cast("int"))
    return F.transform(
        starts, lambda at: F.struct(at.alias("_at"), F.substring(text, at * size + 1, F.lit(size)).alias("_piece"))
    )


def fingerprints(docs: DataFrame, carry: Sequence[str], bases: Bases, huge: int = HUGE) -> DataFrame:
    """(doc_id, *carry, _row, _length, _print, _lead) of every row, ``_row`` being a number of its own.

    ``_lead`` is 1 where no equal text stands before a row in its batch.
    """
    spark, names = docs.sparkSession, ["doc_id", *carry]
    rows = _texts(docs.select(*names, "text")).withColumn("_row", F.monotonically_increasing_id())
    kept = [*names, "_row"]
    schema = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in kept)
    whole = rows.where(F.octet_length("_text") <= huge)
    plain = whole.mapInArrow(_print_rows(bases, kept), f"{schema}, _length bigint, _print bigint, _lead bigint")

    long = rows.where(F.octet_length("_text") > huge).withColumn("_length", F.octet_length("_text").cast("bigint"))
    long = long.select(*names, "_row", "_length", F.inline(_pieces(F.col("_text"), min(CHUNK, huge))))
    after = F.greatest(F.lit(0).cast("bigint"), F.col("_length") - (F.col("_at") + 1) * min(CHUNK, huge))
    dealt = long.select("_row", "_piece", after.alias("_after")).repartition(tasks_for(spark), "_row", "_after")
    shares = dealt.mapInArrow(_piece_rows(bases), "_row bigint, _share0 bigint, _share1 bigint")
    sums = shares.groupBy("_row").agg(
        *[(F.sum(f"_share{at}") % F.lit(modulus)).alias(f"_sum{at}") for at, modulus in enumerate(MODULI)]
    )
    joined = F.shiftleft("_sum0", 31).bitwiseOR(F.col("_sum1"))
    heads = long.where("_at = 0").drop("_at", "_piece").join(sums, "_row")
    parted = heads.select(*kept, "_length", joined.alias("_print"), F.lit(1).cast("bigint").alias("_lead"))
    return plain.unionByName(parted)


def _lead_texts(bases: Bases):
    """The texts that are equal to none before them in their batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            prints = [_joined(fingerprint(text, bases)) for text in texts]
            at = [i for i, lead in enumerate(_leads(texts, prints)) if lead]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(texts[i]) for i in at], pa.int64()), pa.array([prints[i] for i in at], pa.int64()),
                    batch.column("_text").take(pa.array(at, pa.int64())),
                ],
                ["_length", "_print", "_text"],
            )

    return run


COMPARED = "_length bigint, _print bigint, _groups bigint, _differs boolean, _member bigint, _at int, _piece binary"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by group, chunk number and member: the first member's, and where one differs."""
    group = chunk = first = None
    told = False  # that a member of this group differs
    names = ["_length", "_print", "_groups", "_differs", "_member", "_at", "_piece"]
    for batch in batches:
        out = []
        columns = (batch.column(name).to_pylist() for name in ("_length", "_print", "_group", "_groups", "_member", "_at"))
        pieces = batch.column("_piece")
        for row, (length, key, number, groups, member, at) in enumerate(zip(*columns, strict=True)):
            piece = pieces[row].as_py()
            if (length, key, number) != group:
                group, chunk, told = (length, key, number), None, False
            if at != chunk:
                chunk, first = at, piece
                if groups > 1:
                    out.append((length, key, groups, False, member, at, piece))
            elif piece != first and not told:
                told = True
                out.append((length, key, groups, True, member, at, b""))
        columns = zip(*out, strict=True) if out else [[] for _ in names]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names)


def collisions(docs: DataFrame, classes: DataFrame, bases: Bases, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """(_length, _print) of the classes that hold different texts; ``classes`` has ``_leads`` as well."""
    wanted = classes.where("_leads > 1").select(
        "_length", "_print", F.ceil(F.col("_leads") / F.lit(fan_in)).cast("bigint").alias("_groups")
    )
    wanted = stored(wanted, "wanted")
    most = wanted.agg(F.max("_groups")).first()[0]
    if most is None:
        return wanted.select("_length", "_print")
    texts = _texts(docs.select("text")).mapInArrow(_lead_texts(bases), "_length bigint, _print bigint, _text binary")
    members = texts.join(wanted, ["_length", "_print"]).withColumn("_member", F.monotonically_increasing_id())
    members = members.select("_length", "_print", "_groups", "_member", F.inline(_pieces(F.col("_text"), chunk)))
    found = None
    while True:
        number = F.pmod(F.xxhash64("_member"), F.col("_groups"))
        dealt = members.withColumn("_group", number).repartition(
            tasks_for(docs.sparkSession), "_length", "_print", "_group"
        )
        ordered = dealt.sortWithinPartitions("_length", "_print", "_group", "_at", "_member")
        level = stored(ordered.mapInArrow(_compare, COMPARED), "compared")
        differing = level.where("_differs").select("_length", "_print")
        found = differing if found is None else found.union(differing)
        if most <= 1:
            return found.distinct()
        most = -(-most // fan_in)
        left = F.ceil(F.col("_groups") / F.lit(fan_in)).cast("bigint")
        members = level.where("NOT _differs").select("_length", "_print", left.alias("_groups"), "_member", "_at", "_piece")


def with_classes(rows: DataFrame, classes: DataFrame, key: Sequence[str], size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their class, whatever class is frequent.

    Classes with more than one row in ``HOT`` are at most ``HOT``; these are broadcast, so that
    their rows stay where they are. Of the others none fills a task.
    """
    is_hot = F.col(size) * HOT > total
    hot, cold = classes.where(is_hot), classes.where(~is_hot)
    marked = rows.join(F.broadcast(hot.select(*key).withColumn("_hot", F.lit(True))), list(key), "left")
    near = marked.where("_hot").drop("_hot").join(F.broadcast(hot), list(key))
    return near.unionByName(marked.where("_hot IS NULL").drop("_hot").join(cold, list(key)))


def exact_groups(
    docs: DataFrame,
    carry: Sequence[str] = (),
    bases: Iterable[Bases] | None = None,
    huge: int = HUGE,
    chunk: int = CHUNK,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, *carry, keep_id, first_id, group_size, kept.

    ``keep_id`` and ``first_id`` are the largest and the smallest doc_id of the equal texts;
    ``kept`` is true for one row of them. ``carry`` names columns of ``docs`` to bring along.
    """
    for own in bases if bases is not None else fresh_bases():
        prints = stored(fingerprints(docs, carry, own, huge), "prints")
        classes = prints.groupBy("_length", "_print").agg(
            F.count("*").alias("group_size"), F.sum("_lead").alias("_leads"),
            F.max(F.struct("doc_id", "_row")).alias("_keep"), F.min("doc_id").alias("first_id"),
        )
        classes = stored(classes, "classes")
        if collisions(docs, classes, own, chunk, fan_in).isEmpty():
            break
    else:
        raise ValueError("the fingerprints of all given bases collide")
    total = prints.count()
    placed = with_classes(prints, classes.drop("_leads"), ("_length", "_print"), "group_size", total)
    return placed.select(
        "doc_id", *carry, F.col("_keep.doc_id").alias("keep_id"), "first_id", "group_size",
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
    )


def op12_exact_dedup(spark, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_groups(docs, ["text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
