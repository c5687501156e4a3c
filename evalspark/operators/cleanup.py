"""Removing runs: all, failed ones, or those of tasks that no longer exist.

Every function returns the table that remains; the reports say beforehand what would go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.identity import name_or_id
from evalspark.operators.runs import succeeded


def clean_runs(runs: DataFrame) -> DataFrame:
    """No runs at all; the task table is not touched."""
    return runs.limit(0)


def clean_errors(runs: DataFrame) -> DataFrame:
    """The runs that did not fail."""
    return runs.filter(succeeded())


def clean_counts(runs: DataFrame) -> DataFrame:
    """(all_runs, error_runs): what the two clean-ups would remove."""
    return runs.agg(
        F.count("*").alias("all_runs"), F.count_if(F.col("error").isNotNull()).alias("error_runs")
    )


def orphan_run_counts(runs: DataFrame, current: DataFrame) -> DataFrame:
    """(task_id, run_count): tasks that have runs but are not among the current tasks.

    Runs are counted per task before the anti join, so the join sees one row per task. A run
    without a task id belongs to no task and is never an orphan.
    """
    counts = runs.filter(F.col("task_id").isNotNull()).groupBy("task_id").agg(
        F.count("execution_id").alias("run_count")
    )
    return counts.join(current.select("task_id"), "task_id", "left_anti")


def orphan_task_ids(runs: DataFrame, current: DataFrame) -> DataFrame:
    """(task_id): the distinct task ids of runs that are not among the current tasks."""
    used = runs.filter(F.col("task_id").isNotNull()).select("task_id").distinct()
    return used.join(current.select("task_id"), "task_id", "left_anti")


def orphan_report(runs: DataFrame, tasks: DataFrame, current: DataFrame) -> DataFrame:
    """(display_name, task_id, name, run_count) of the registered orphans."""
    known = tasks.select("task_id", "display_name")
    return known.join(orphan_run_counts(runs, current), "task_id").select(
        "display_name", "task_id", name_or_id(F.col("display_name"), F.col("task_id"), 16).alias("name"), "run_count"
    )


def orphan_totals(runs: DataFrame, current: DataFrame) -> DataFrame:
    """(tasks, runs): how much a prune would remove."""
    return orphan_run_counts(runs, current).agg(
        F.count("*").alias("tasks"), F.coalesce(F.sum("run_count"), F.lit(0)).alias("runs")
    )


def prune_runs(runs: DataFrame, current: DataFrame) -> DataFrame:
    """The runs of current tasks, and those without a task id: one pass over the runs."""
    known = current.select(F.col("task_id").alias("_known")).filter("_known IS NOT NULL").distinct()
    marked = runs.join(known, F.col("task_id") == F.col("_known"), "left")
    return marked.filter("_known IS NOT NULL OR task_id IS NULL").select(*runs.columns)


def prune_tasks(tasks: DataFrame, runs: DataFrame, current: DataFrame) -> DataFrame:
    """The registered tasks that are not orphans; a task without runs stays."""
    gone = tasks.select("task_id").join(current.select("task_id"), "task_id", "left_anti")
    orphans = gone.join(runs.select("task_id"), "task_id", "left_semi")
    return tasks.join(orphans, "task_id", "left_anti").select(*tasks.columns)
