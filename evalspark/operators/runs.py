"""Scans, filters and joins over the run table.

No join carries a broadcast hint: the task table grows with the data, so the choice is left
to Catalyst's size estimate and to adaptive execution, which also splits skewed keys of a
left, semi or anti join. Sorted results take a ``sort``/``ordered`` switch, and every sort
ends in a key, so that rows with equal leading values can still be spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.globs import matches_any
from evalspark.functions.identity import execution_id
from evalspark.schemas import TASK_RUNS


def model_like(model: Column, text: str) -> Column:
    """Case-insensitive LIKE ``%text%``: ``%`` and ``_`` stay wildcards, ``\\`` is itself."""
    pattern = "%" + text.lower().replace("\\", "\\\\") + "%"
    return F.lower(model).like(pattern)


def model_contains(model: Column, text: str) -> Column:
    """Case-insensitive plain substring, as used when grading."""
    return F.lower(model).contains(text.lower())


def succeeded(error: Column | None = None) -> Column:
    return (F.col("error") if error is None else error).isNull()


def is_pending() -> Column:
    """Waiting for a manual grade: marked pending, and the run itself did not fail."""
    return (F.col("validation_pending") == F.lit(True)) & succeeded()


def task_runs(
    runs: DataFrame, task_id: str | None = None, model: str | None = None, ordered: bool = True
) -> DataFrame:
    """All columns of the runs of one task and/or one model, newest first."""
    if task_id is not None:
        runs = runs.filter(F.col("task_id") == task_id)
    if model is not None:
        runs = runs.filter(F.col("model") == model)
    runs = runs.select(*TASK_RUNS.fieldNames())
    if ordered:
        runs = runs.orderBy(F.desc_nulls_last("created_at"), "execution_id")
    return runs


def filter_tasks(tasks: DataFrame, patterns: Sequence[str] = ()) -> DataFrame:
    """The tasks that match any pattern; all of them without patterns."""
    return tasks.filter(matches_any(F.col("id_chain"), patterns))


def matching_task_ids(tasks: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(task_id): the registered tasks with a non-empty chain that match any pattern."""
    return filter_tasks(tasks, patterns).filter(F.size("id_chain") > 0).select("task_id")


def successful_runs(
    runs: DataFrame,
    tasks: DataFrame | None = None,
    patterns: Sequence[str] = (),
    model_filter: str | None = None,
) -> DataFrame:
    """Runs without error, by task pattern and model text where these are given.

    The patterns are evaluated on the task table, never once per run.
    """
    runs = runs.filter(succeeded())
    if model_filter:
        runs = runs.filter(model_like(F.col("model"), model_filter))
    if patterns:
        if tasks is None:
            raise ValueError("patterns need the task table")
        runs = runs.join(matching_task_ids(tasks, patterns), "task_id", "left_semi")
    return runs


def with_tasks(runs: DataFrame, tasks: DataFrame, *columns: str) -> DataFrame:
    """Runs LEFT JOIN tasks: a run may point at a task that is not registered."""
    return runs.join(tasks.select("task_id", *columns), "task_id", "left")


def planned_executions(tasks: DataFrame, models: Sequence[str]) -> DataFrame:
    """(task_id, model, execution_id): every task with every model of a list.

    The list is small configuration, so it is a literal array that each task row is expanded
    by; nothing is joined. A model named twice gives its pairs twice.
    """
    names = F.array(*[F.lit(model) for model in models]) if models else F.array().cast("array<string>")
    pairs = tasks.select("task_id", F.explode(names).alias("model"))
    return pairs.withColumn("execution_id", execution_id(F.col("task_id"), F.col("model")))


def existing_executions(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """(execution_id): those of the given ids that have a stored run, failed runs included."""
    return runs.select("execution_id").join(ids.select("execution_id"), "execution_id", "left_semi")


def missing_pairs(tasks: DataFrame, models: Sequence[str], runs: DataFrame) -> DataFrame:
    """(task_id, model, execution_id) without a stored run. Only ids are shuffled."""
    planned = planned_executions(tasks, models)
    return planned.join(runs.select("execution_id"), "execution_id", "left_anti").select(
        "task_id", "model", "execution_id"
    )


def missing_executions(tasks: DataFrame, models: Sequence[str], runs: DataFrame) -> DataFrame:
    """The work list: missing pairs with the chain and messages of their task.

    The pairs are found on ids alone; the messages join in afterwards, once per pair that is
    really to be run. Rows of a task that is listed twice appear twice.
    """
    pairs = missing_pairs(tasks.select("task_id").distinct(), models, runs)
    return pairs.join(tasks.select("task_id", "id_chain", "messages"), "task_id")


def cache_counts(tasks: DataFrame, models: Sequence[str], runs: DataFrame) -> DataFrame:
    """(tasks, models, planned, cached, missing): one row."""
    missing = missing_pairs(tasks, models, runs).agg(F.count("*").alias("missing"))
    task_count = tasks.agg(F.count("*")).scalar()
    counts = missing.select(
        task_count.alias("tasks"), F.lit(len(models)).cast("bigint").alias("models"), "missing"
    )
    planned = F.col("tasks") * F.col("models")
    return counts.select(
        "tasks", "models", planned.alias("planned"), (planned - F.col("missing")).alias("cached"), "missing"
    )


def runs_for_display(
    runs: DataFrame,
    tasks: DataFrame,
    patterns: Sequence[str] = (),
    model_filter: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Successful runs with the name and chain of their task, by name and model, NULLs last."""
    found = successful_runs(runs, tasks, patterns, model_filter).select(
        "task_id", "model", "validation_passed", "validation_score", "duration_ms"
    )
    rows = with_tasks(found, tasks, "display_name", "id_chain").select(
        "display_name",
        "id_chain",
        "task_id",
        "model",
        "validation_passed",
        "validation_score",
        "duration_ms",
    )
    if ordered:
        rows = rows.orderBy(F.asc_nulls_last("display_name"), F.asc_nulls_last("model"), "task_id")
    return rows


def pending_grades(
    runs: DataFrame, tasks: DataFrame, model_filter: str | None = None, ordered: bool = True
) -> DataFrame:
    """The grading queue, oldest first: pending runs with output, rubric and task."""
    waiting = runs.filter(is_pending())
    if model_filter:
        waiting = waiting.filter(model_contains(F.col("model"), model_filter))
    rows = with_tasks(waiting, tasks, "display_name", "id_chain", "path").select(
        "execution_id",
        "task_id",
        "model",
        "output",
        "validation_rubric",
        "created_at",
        "display_name",
        "id_chain",
        "path",
    )
    if ordered:
        rows = rows.orderBy(F.asc_nulls_last("created_at"), "execution_id")
    return rows


def pending_count(runs: DataFrame) -> DataFrame:
    """(pending): how many runs wait for a grade."""
    return runs.filter(is_pending()).agg(F.count("*").alias("pending"))
