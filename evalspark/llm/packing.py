"""Best-fit packing of documents into bins under conflicts.

A bin holds at most ``CAPACITY`` words; longer documents are cut into full pieces and a rest. Two
documents of one source, or of one cluster of exact copies, never share a bin. In a shard, pieces
come from the longest to the shortest. The open bins stand in order of their residual, each with
a bitmap of its sources and one of its clusters; a tree over the residuals keeps what all bins
below have in common, so that the search for the tightest bin that fits goes on to the successor
past whole ranges whose bins all conflict. What fits nowhere opens a bin.

Shards are drawn by a hash of the row and its number, about ``SHARD`` rows each, whatever source,
cluster or doc_id is frequent, null ids and repeated rows included: no task gets more than a shard, only lengths and hashes are moved, and the bins that a
shard leaves part full are few against those it fills. Conflicts concern bins, and a bin lies in
one shard, so they hold over all.

Null and empty texts have no pieces; they come back once, without a bin. A null source conflicts
with nothing. Repeated rows are copies, so they land in different bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import compute_once
from evalspark.llm.common import WORD, read, stored

CAPACITY, SHARD = 1024, 20_000
SCHEMA = "doc_id {}, piece bigint, n_words bigint, shard bigint, bin bigint, offset bigint"


class Bins:
    """Open bins by residual. ``common[node]`` is what all bins below a tree node share, or -1 (all bits) if none is there."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1).bit_length()
        self.common = [-1] * (2 * self.size)
        #: residual -> bitmap of sources -> the bins that have it, newest last
        self.leaves: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.clusters: list[int] = []
        self.fill: list[int] = []
        self.capacity = capacity

    def _refresh(self, residual: int) -> None:
        shared = -1
        for sources in self.leaves[residual]:
            shared &= sources
        node = residual + self.size
        self.common[node] = shared
        while node > 1:
            node >>= 1
            self.common[node] = self.common[2 * node] & self.common[2 * node + 1]

    def _successor(self, residual: int, source: int) -> int:
        """The least residual from ``residual`` on with a bin without ``source``; -1 if there is none."""
        open_at = lambda node: self.common[node] != -1 and not self.common[node] & source
        node = residual + self.size
        while not open_at(node):
            while node & 1:
                node >>= 1
            if node <= 1:
                return -1
            node += 1
        while node < self.size:
            node *= 2
            if not open_at(node):
                node += 1
        return node - self.size

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin and offset of a piece; source and cluster are single bits, or 0 for no conflict."""
        residual = self._successor(size, source) if size <= self.capacity else -1
        while residual >= 0:
            leaf = self.leaves[residual]
            for sources, numbers in leaf.items():
                if sources & source:
                    continue
                for at in range(len(numbers) - 1, -1, -1):
                    number = numbers[at]
                    if not self.clusters[number] & cluster:
                        numbers.pop(at)
                        if not numbers:
                            del leaf[sources]
                        return self._put(number, residual, size, sources | source, cluster)
            residual = self._successor(residual + 1, source) if residual < self.capacity else -1
        self.clusters.append(0)
        self.fill.append(0)
        return self._put(len(self.fill) - 1, None, size, source, cluster)

    def _put(self, number: int, residual: int | None, size: int, sources: int, cluster: int) -> tuple[int, int]:
        offset = self.fill[number]
        self.fill[number] += size
        self.clusters[number] |= cluster
        left = self.capacity - self.fill[number]
        if left:
            self.leaves[left].setdefault(sources, []).append(number)
            self._refresh(left)
        if residual is not None:
            self._refresh(residual)
        return number, offset


def _bits(values: pd.Series, repeated_only: bool) -> list[int]:
    """A bit per value, 0 for null; values that occur once conflict with nothing and need none."""
    codes, numbers = {}, []
    often = values.map(values.value_counts()) if repeated_only else None
    for at, value in enumerate(values):
        if value is None or value != value or (repeated_only and often.iat[at] < 2):
            numbers.append(0)
        else:
            numbers.append(1 << codes.setdefault(value, len(codes)))
    return numbers


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "doc_id", "cluster"], ascending=[False, True, True], kind="stable")
        bins, out = Bins(capacity), []
        shard = int(rows["shard"].iat[0])
        sources, clusters = _bits(rows["source"], False), _bits(rows["cluster"], True)
        for doc, words, source, cluster in zip(rows["doc_id"], rows["n_words"], sources, clusters, strict=True):
            full, rest = divmod(int(words), capacity)
            for piece in range(full):
                out.append((doc, piece, capacity, shard, *bins.place(capacity, source, cluster)))
            if rest:
                out.append((doc, full, rest, shard, *bins.place(rest, source, cluster)))
            elif not full:
                out.append((doc, 0, 0, shard, None, None))
        names = ["doc_id", "piece", "n_words", "shard", "bin", "offset"]
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64", "bin": "Int64", "offset": "Int64"})

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, n_words, shard, bin, offset): where every piece lies; bins are numbered in shards."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", text.alias("text"))
    rows = compute_once(
        rows, {"n_words": F.regexp_count("text", F.lit(WORD)).cast("bigint"), "cluster": F.xxhash64("text")}, ("text",)
    )
    rows = stored(rows, "lengths")
    shards = max(1, -(-rows.count() // shard))
    number = F.xxhash64("doc_id", "cluster", F.monotonically_increasing_id(), F.lit(17))
    drawn = rows.withColumn("shard", F.pmod(number, F.lit(shards)))
    return drawn.groupBy("shard").applyInPandas(_pack(capacity), SCHEMA.format("bigint"))


def op1_best_fit_packing(spark, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"))
