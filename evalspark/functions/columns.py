"""Computing expensive columns exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add columns that the optimizer will not copy into other places of the plan.

    Catalyst merges neighbouring projections and pushes filters below them, and repeats the
    expression of a column wherever it is used. For a parse or a hash of a whole document that
    means doing the work again for every filter on its result, and plans that grow with each
    step. A one-row generator has the same result, is part of generated code, and is not
    looked through.
    """
    record = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [name for name in df.columns if name not in drop]
    return df.select(*kept, F.inline(F.array(record)))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]
