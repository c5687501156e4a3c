"""Helpers that several operators share: shared folders, words of a text, the ASCII lower case."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.marks import filter_of, split

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: A word is a run of anything but these; the same set that ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a long text are handed out in blocks of about so many bytes.
BLOCK_BYTES = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which driver and executors share.

    Where the session has none, a local session (tests) gets one on this machine; on a cluster
    such a folder would not be shared, so that is an error.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_SETTING} is not set")
        root = "file://" + tempfile.mkdtemp(prefix="evalspark-")
        spark.conf.set(CHECKPOINT_SETTING, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new shared folder and read back.

    What is used several times is computed once, lineage is cut, and lost executors do not matter.
    """
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def split_marked(docs: DataFrame, key: Sequence[Column], marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, clear): the rows of ``docs`` whose key may be a row of ``marked``, and those whose key is none.

    A join that drops or changes few rows then moves the texts of ``asked`` alone.
    """
    return split(docs, key, stored(filter_of(marked), "filter"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does the same to a text without other letters."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def word_blocks(data: bytes, block: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size, so that a long text is never split whole."""
    if len(data) <= block:
        yield data.split()
        return
    start = 0
    while start < len(data):
        gap = _BLANK.search(data, start + block)
        end = gap.start() if gap else len(data)
        yield data[start:end].split()
        start = end


def tasks_for(spark: SparkSession, at_least: int = 1) -> int:
    """The number of shuffle partitions of the session, which a cluster sizes to its data."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
