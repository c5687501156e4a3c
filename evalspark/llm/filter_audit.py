"""How filters interact: what each of five filters removes in every order, from a walk over subsets.

A document fails some of the filters; the set of those is a mask of five bits, and all that an
audit asks depends only on how many documents a part has for each mask. So the documents are
counted into 32 cells a part (and, of these, the good and the toxic ones), and the rest is
arithmetic on cells, part by part:

* The subsets of filters are walked in Gray-code order, which toggles one filter at a time. Every
  cell has a counter of the active filters that it fails; a cell whose counter leaves zero is taken
  from the running survivors, one whose counter returns to zero is added. After each of the
  32 steps the survivors are stored under their subset.
* An order of the filters is a chain of subsets; what a step removes is the difference of
  two stored states. What a filter removes late, or alone, and its Shapley sum follow from these.

Counting combines on the map side, so a part with a third of all documents is at most 32 rows per
task before it is shuffled; a part is at most 32 rows when it is walked.

Null texts are empty. Filter E fails a document whose text is identical to that of a smaller doc_id;
a null doc_id neither fails it nor counts as smaller, and rows that share doc_id and text do not
fail it through each other. A null source is the part "". Labels may repeat a doc_id: one with quality 1
makes the document good, one with toxic 1 toxic. ``docs`` may have any other columns; without rows
there are no parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import read
from evalspark.llm.exact import exact_groups

FILTERS = "ABCDE"
#: Fixed values of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
_CAPITALS = bytes(range(0x41, 0x5B))
_CONTINUATIONS = bytes(range(0x80, 0xC0))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: bytes) -> int:
    """The mask of the filters A to D, which look at one text; bit 0 is A."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUATIONS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


@F.pandas_udf(T.IntegerType())
def _own_failures(texts: pd.Series) -> pd.Series:
    return texts.map(own_failures)


def fail_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row: bit i is set if the document fails filter i."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id", "text", F.coalesce("source", F.lit("")).alias("part"), _own_failures(text.cast("binary")).alias("own")
    )
    groups = exact_groups(rows, ["part", "own"])
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return groups.select("doc_id", "part", F.col("own").bitwiseOR(copy.cast("int") * 16).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of every part by what they fail.

    Rows of one doc_id, part and mask are one row before the labels are joined, so that neither
    a frequent nor a null doc_id fills a task.
    """
    one = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("bigint"))
    known = labels.groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    counted = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marked = counted.join(known, "doc_id", "left")
    of = lambda name: F.sum(F.col("n") * F.coalesce(name, F.lit(0))).alias(name)
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def subset_states(counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters; ``counts`` has a row of numbers for each of the 32 masks."""
    size = len(counts)
    failing = np.zeros(size, np.int64)  # active filters that a cell fails
    survivors = counts.sum(axis=0)
    states = np.empty_like(counts)
    masks, active = np.arange(size), 0
    states[0] = survivors
    for step in range(1, size):
        bit = step & -step  # the Gray code of a step differs from the one before in this bit
        cells_of = masks & bit != 0
        active ^= bit
        if active & bit:
            survivors = survivors - counts[cells_of & (failing == 0)].sum(axis=0)
            failing[cells_of] += 1
        else:
            failing[cells_of] -= 1
            survivors = survivors + counts[cells_of & (failing == 0)].sum(axis=0)
        states[active] = survivors
    return states


def audit(counts: np.ndarray) -> Iterator[tuple]:
    """(order, step, *COUNTS) for all orders, from the cells of a part (n, good, toxic)."""
    states = subset_states(counts)
    everything = len(states) - 1
    fails = [int(states[0, 0] - states[1 << i, 0]) for i in range(len(FILTERS))]
    alone = [int(states[everything ^ 1 << i, 0] - states[everything, 0]) for i in range(len(FILTERS))]
    rows, shapley = [], [0] * len(FILTERS)
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            i = FILTERS.index(name)
            after = before | 1 << i
            removed, good, toxic = (states[before] - states[after]).tolist()
            shapley[i] += removed
            rows.append((order, step, i, int(states[after, 0]), removed, good, toxic))
            before = after
    for order, step, i, kept, removed, good, toxic in rows:
        yield order, step, kept, removed, fails[i] - removed, alone[i], good, toxic, shapley[i]


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "filter_order", "step", *COUNTS]
    for batch in batches:
        for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.zeros((1 << len(FILTERS), 3), np.int64)
            for cell in found:
                counts[cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
            orders, steps, *numbers = zip(*audit(counts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(orders)), pa.array(orders), pa.array(steps, pa.int32()), *(pa.array(n, pa.int64()) for n in numbers)],
                names,
            )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and ``COUNTS``: one row per part, order of the filters and step."""
    counted = cells(fail_masks(docs), labels)
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{name} bigint" for name in COUNTS)
    return parts.mapInArrow(_audits, schema)


def op13_filter_interaction_audit(spark, folder: str) -> DataFrame:
    return filter_audit(read(spark, folder, "documents"), read(spark, folder, "labels"))
