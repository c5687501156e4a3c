"""Summaries that are kept up instead of computed again: counts and sums per task and model.

A changed run takes its old row out of the totals and puts its new one in, so totals cost what has
changed and a report costs one row per task and model. Sums are decimals of 12 places, so a value
that was added can be taken out again without a rest, in any order. Scores and durations
that are no such decimal (NaN, infinite, 10^16 or more) are counted apart; the average of a
group that has any is NaN.

Totals are combined on the map side, and a hot task or model is as many rows as it has partners.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.identity import short_model
from evalspark.operators.runs import is_pending, matching_task_ids, model_like, succeeded, with_tasks
from evalspark.plans.summaries import pass_rate

KEYS = ("task_id", "model")
#: Columns of the run table that totals are made of.
READ = (*KEYS, "error", "validation_passed", "validation_score", "validation_pending", "duration_ms")
_VALUE, _SUM = "decimal(28,12)", T.DecimalType(38, 12)
_AVERAGED = {"score": "validation_score", "duration": "duration_ms"}
COUNTS = ("runs", "errors", "pending", "total_runs", "passed", *(f"{kind}_{name}" for name in _AVERAGED for kind in ("known", "odd")))
SUMS = tuple(f"sum_{name}" for name in _AVERAGED)
TOTALS = T.StructType(
    [T.StructField(name, T.StringType()) for name in KEYS]
    + [T.StructField(name, T.LongType()) for name in COUNTS]
    + [T.StructField(name, _SUM) for name in SUMS]
)


def _per_run() -> dict[str, Column]:
    """What one run adds to each total; averages are those of runs without error."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    count = lambda condition: F.when(condition, one).otherwise(zero)
    out = {
        "runs": one,
        "errors": count(~succeeded()),
        "pending": count(is_pending()),
        "total_runs": count(succeeded()),
        "passed": count(succeeded() & F.col("validation_passed")),
    }
    for name, column in _AVERAGED.items():
        value = F.expr(f"try_cast({column} AS {_VALUE})")
        known, there = value.isNotNull() & succeeded(), F.col(column).isNotNull() & succeeded()
        out[f"known_{name}"] = count(known)
        out[f"odd_{name}"] = count(there & value.isNull())
        out[f"sum_{name}"] = F.when(known, value).otherwise(F.lit(0).cast(_VALUE)).cast(_VALUE)
    return out


def _summed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    totals = rows.groupBy(*KEYS).agg(
        *[F.sum(column).cast(TOTALS[name].dataType).alias(name) for name, column in columns.items()]
    )
    return totals.select(TOTALS.fieldNames())


def run_totals(runs: DataFrame) -> DataFrame:
    """The totals of a run table."""
    return _summed(runs, _per_run())


def changed_totals(pairs: DataFrame) -> DataFrame:
    """What changed runs add to the totals, from (old, new): structs with the columns of ``READ``, NULL
    where there is no run. Counts and sums may be negative."""
    sides = F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("old").alias("run")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("run"))
    )
    rows = pairs.select(F.inline(sides)).filter("run IS NOT NULL").select("sign", "run.*")
    signed = {name: F.when(F.col("sign") < 0, -column).otherwise(column) for name, column in _per_run().items()}
    return _summed(rows, signed)


def merge_totals(totals: DataFrame, *changes: DataFrame) -> DataFrame:
    """Totals after changes, in any order; groups without runs go."""
    rows = totals
    for change in changes:
        rows = rows.unionByName(change)
    return _summed(rows, {name: F.col(name) for name in (*COUNTS, *SUMS)}).filter("runs <> 0")


def _average(name: str) -> Column:
    plain = F.col(f"sum_{name}").cast("double") / F.col(f"known_{name}")
    return F.when(F.col(f"odd_{name}") > 0, F.lit(float("nan"))).when(F.col(f"known_{name}") > 0, plain)


def _found(totals: DataFrame, tasks: DataFrame | None, patterns: Sequence[str], model_filter: str | None) -> DataFrame:
    totals = totals.filter("total_runs > 0")
    if model_filter:
        totals = totals.filter(model_like(F.col("model"), model_filter))
    if patterns:
        if tasks is None:
            raise ValueError("patterns need the task table")
        totals = totals.join(matching_task_ids(tasks, patterns), "task_id", "left_semi")
    return totals


def _grouped(totals: DataFrame, key: str) -> DataFrame:
    return totals.groupBy(key).agg(*[F.sum(name).cast(TOTALS[name].dataType).alias(name) for name in (*COUNTS, *SUMS)])


def totals_by_model(
    totals: DataFrame, tasks: DataFrame | None = None, patterns: Sequence[str] = (), model_filter: str | None = None
) -> DataFrame:
    """``summary_by_model`` from totals."""
    return (
        _grouped(_found(totals, tasks, patterns, model_filter), "model")
        .select(
            "model", short_model(F.col("model")).alias("model_name"), "total_runs", "passed", pass_rate().alias("pass_rate"),
            _average("score").alias("avg_score"), _average("duration").alias("avg_duration_ms"),
        )
        .orderBy(F.desc_nulls_last("avg_score"), "model")
    )


def totals_by_task(
    totals: DataFrame, tasks: DataFrame, patterns: Sequence[str] = (), model_filter: str | None = None, ordered: bool = True
) -> DataFrame:
    """``summary_by_task`` from totals."""
    named = with_tasks(_grouped(_found(totals, tasks, patterns, model_filter), "task_id"), tasks, "display_name").select(
        "display_name", "task_id", "total_runs", "passed", pass_rate().alias("pass_rate"), _average("score").alias("avg_score")
    )
    return named.orderBy(F.desc_nulls_last("avg_score"), "task_id") if ordered else named


def totals_per_model(totals: DataFrame) -> DataFrame:
    """``runs_per_model`` from totals: failed runs count too."""
    grouped = totals.groupBy("model").agg(F.sum("runs").alias("runs"))
    return grouped.select("model", short_model(F.col("model")).alias("model_name"), "runs").orderBy(F.desc("runs"), "model")


def totals_counts(tasks: DataFrame, totals: DataFrame) -> DataFrame:
    """``store_counts`` from totals."""
    counted = totals.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("runs", "errors", "pending")])
    return counted.select(tasks.agg(F.count("*")).scalar().alias("tasks"), "runs", "errors", "pending")
