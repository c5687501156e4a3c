"""Keyed upserts: a table and a batch of records in, the changed table out.

A batch is first brought down to one row per key by an aggregation, which also combines on
the map side: a key that makes up a third of the batch is one row per input task before
anything is shuffled. The batch then meets the table in two joins:

* the table LEFT JOIN the batch, for keys that exist (values replaced), and
* the batch LEFT ANTI JOIN the table's keys, for keys that are new.

Unlike one full outer join, both can become broadcast joins when the batch turns out to be
small, so that a small batch never shuffles a large table. For a large batch the second join
costs one more pass over the table's key column only; the reduced batch is shuffled once and
read by both joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import compute_once
from evalspark.functions.identity import execution_id
from evalspark.functions.marks import filter_of, split
from evalspark.schemas import TASK_RUNS, TASKS, conform

# What a repeated run replaces, and what it keeps from the first time.
REPLACED = (
    "output",
    "duration_ms",
    "error",
    "validation_passed",
    "validation_score",
    "validation_reason",
    "validation_metadata",
    "validation_pending",
    "validation_rubric",
    "run_config",
)
KEPT = ("task_id", "messages_hash", "model", "created_at")


def _stamp(now: Column | None) -> Column:
    return (F.current_timestamp() if now is None else now).cast("timestamp_ntz")


def _order(columns: Sequence[str | Column]) -> Column:
    if not columns:
        raise ValueError("an order of the records is needed to know which one is the last")
    return F.struct(*columns)


def _merge(table: DataFrame, batch: DataFrame, key: str, replaced: Sequence[str]) -> DataFrame:
    """Replace columns of the rows whose key is in the batch, and add the rows with new keys.

    The batch stands on the right of both joins with the table, so one that Spark knows to be
    small (files, or an aggregate of files) is broadcast and the table stays where it is. All joins take the batch with all its columns, behind a step
    that is not pruned: they then have the same plan below them.
    """
    columns = table.columns
    values = [name for name in columns if name != key]
    batch = compute_once(batch.select(*columns), {name: F.col(name) for name in values}, drop=tuple(values))
    incoming = batch.select(
        F.col(key).alias("_key"), *[F.col(name).alias(f"_{name}") for name in replaced]
    )
    changed = table.join(incoming, F.col(key) == F.col("_key"), "left").select(
        *[
            F.when(F.col("_key").isNotNull(), F.col(f"_{name}")).otherwise(F.col(name)).alias(name)
            if name in replaced
            else F.col(name)
            for name in columns
        ]
    )
    # keys of the batch that the table has: never more than the batch, whatever the table's size
    known = table.select(key).join(batch.select(key), key, "left_semi")
    added = batch.join(known, key, "left_anti").select(*columns)
    return changed.unionByName(added)


def latest_tasks(tasks: DataFrame, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """One row per task id, the last one in the given order (by default: path, part by part)."""
    order = _order(order_by or [F.split("path", "/")])
    values = F.struct("id_chain", "display_name", "path", "messages_hash")
    last = tasks.filter(F.col("task_id").isNotNull()).groupBy("task_id").agg(F.max_by(values, order).alias("last"))
    return last.select("task_id", "last.*")


def upsert_tasks(
    table: DataFrame,
    tasks: DataFrame,
    now: Column | None = None,
    order_by: Sequence[str | Column] = (),
) -> DataFrame:
    """Register tasks: known ones get new values and ``updated_at``, and keep ``created_at``."""
    batch = (
        latest_tasks(tasks, order_by)
        .withColumn("created_at", _stamp(now))
        .withColumn("updated_at", _stamp(now))
    )
    replaced = ("id_chain", "display_name", "path", "messages_hash", "updated_at")
    return _merge(conform(table, TASKS), batch, "task_id", replaced)


def flatten_validation(runs: DataFrame, validation: str = "validation") -> DataFrame:
    """Spread a validation struct over the run columns; no validation means NULLs, not pending.

    Empty metadata and an empty run configuration are stored as NULL.
    """

    def field(name: str) -> Column:
        return F.col(validation)[name]

    flat = runs.withColumns(
        {
            "validation_passed": field("passed"),
            "validation_score": field("score"),
            "validation_reason": field("reason"),
            "validation_metadata": json_or_null(field("metadata")),
            "validation_pending": F.coalesce(field("pending"), F.lit(False)),
            "validation_rubric": field("rubric"),
        }
    ).drop(validation)
    if "run_config" in flat.columns:
        flat = flat.withColumn("run_config", json_or_null(F.col("run_config")))
    return flat


def json_or_null(text: Column) -> Column:
    """JSON text, or NULL for an empty object."""
    return F.when(~F.coalesce(text, F.lit("")).rlike(r"^\s*(?:\{\s*\})?\s*\z"), text)


def reduce_attempts(
    attempts: DataFrame, order_by: Sequence[str | Column], ends_first: bool = False
) -> DataFrame:
    """One row per execution: values of the last attempt, ``created_at`` of the first.

    ``attempts`` has the run columns except ``execution_id``; a record without task or model
    is no run of anything and has no key. One aggregate carries all the values, as comparing
    the order once per record is what this costs. It sorts what it combines: with ``ends_first`` the
    least and greatest order of every execution are found beforehand, in a pass of their own over
    the narrow columns, and the outputs of attempts in between are never sorted or spilled. This
    is for attempts that repeat and are read from tables; what computes them is run twice.
    """
    order = _order(order_by)
    key = execution_id(F.col("task_id"), F.col("model"))
    keyed = compute_once(attempts, {"execution_id": key}).filter(F.col("execution_id").isNotNull())
    if ends_first:
        keyed = _possible_ends(keyed, order)
    reduced = keyed.groupBy("execution_id").agg(
        F.min_by(F.struct(*KEPT), order).alias("first"),
        F.max_by(F.struct(*REPLACED), order).alias("last"),
    )
    return reduced.select("execution_id", "first.*", "last.*").select(*TASK_RUNS.fieldNames())


def _possible_ends(keyed: DataFrame, order: Column) -> DataFrame:
    """The rows that may be the first or the last of their execution, all that are among them."""
    ends = keyed.groupBy("execution_id").agg(F.min(order).alias("low"), F.max(order).alias("high"))
    marked = ends.select("execution_id", F.explode(F.array("low", "high")).alias("end"))
    return split(keyed, [F.col("execution_id"), order], filter_of(marked))[0]


def merge_runs(table: DataFrame, batch: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Merge rows that are already one per execution into a run table; ``columns`` narrows both."""
    table = conform(table, TASK_RUNS)
    if columns is not None:
        wanted = ["execution_id", *[name for name in columns if name != "execution_id"]]
        table, batch = table.select(*wanted), batch.select(*wanted)
    return _merge(table, batch, "execution_id", [name for name in REPLACED if name in table.columns])


def upsert_runs(
    table: DataFrame, attempts: DataFrame, order_by: Sequence[str | Column], ends_first: bool = False
) -> DataFrame:
    """Store attempts: a repeated execution replaces its result and keeps its first time stamp."""
    return merge_runs(table, reduce_attempts(attempts, order_by, ends_first))
