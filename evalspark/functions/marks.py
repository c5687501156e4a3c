"""A filter of fixed size that tells which rows may have one of many marked keys.

Every marked key sets one bit. Rows whose bit is not set have no marked key; the others may have
one, and what depends on it is decided from them alone. At most ``FILTER_CELLS`` numbers are
broadcast, whatever the sizes: a fuller filter lets more rows through, it loses none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of 64 bits, 2 MB of bits in all.
FILTER_CELLS = 1 << 18


def _cell(key: Sequence[Column]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(FILTER_CELLS))


def _bit(key: Sequence[Column]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 58).cast("int")


def filter_of(marked: DataFrame) -> DataFrame:
    """(_cell, _bits): the filter of the keys that the columns of ``marked`` are."""
    key = [marked[name] for name in marked.columns]
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(key))
    return marked.groupBy(_cell(key).alias("_cell")).agg(F.bit_or(one).alias("_bits"))


def split(rows: DataFrame, key: Sequence[Column], cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, clear): the rows whose key may be a marked one, and those whose key is none."""
    probed = rows.join(F.broadcast(cells), _cell(key) == F.col("_cell"), "left")
    hit = F.coalesce(F.getbit("_bits", _bit(key)) == 1, F.lit(False))
    columns = [rows[name] for name in rows.columns]
    return probed.where(hit).select(*columns), probed.where(~hit).select(*columns)
