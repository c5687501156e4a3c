"""From raw documents to packed training bins: five operators, one after the other.

Every stage gets all that its predecessor kept, as Parquet in shared storage, and returns the
columns of documents; the last returns where each piece of a document lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm.common import read, stored
from evalspark.llm.decontaminate import decontaminate
from evalspark.llm.packing import pack
from evalspark.llm.quality import keep_good
from evalspark.llm.secret_scan import redact
from evalspark.llm.simhash import keep_first


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules reject go; cutoffs come from the labels."""
    return keep_good(docs, read(spark, folder, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id stays."""
    return keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents contaminated with benchmark items go."""
    return decontaminate(docs, read(spark, folder, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets are replaced by a mark, in ``n_chars`` as well."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The bins of what is left."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: SimHash votes and the packing order are not expressible in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = read(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
