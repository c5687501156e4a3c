"""The usual sequences of operators, as one call each. Nothing here runs a job."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame

from evalspark.operators.cleanup import orphan_report, orphan_totals, prune_runs, prune_tasks
from evalspark.operators.runs import cache_counts, filter_tasks, missing_executions, runs_for_display
from evalspark.operators.upsert import upsert_tasks
from evalspark.plans.summaries import summary_by_model, summary_by_task


class RunPlan(NamedTuple):
    """What a round of runs starts from."""

    registry: DataFrame
    work: DataFrame
    counts: DataFrame


class PrunePlan(NamedTuple):
    """What a prune would remove, and the tables that remain."""

    report: DataFrame
    totals: DataFrame
    registry: DataFrame
    runs: DataFrame


def plan_runs(
    tasks: DataFrame,
    registry: DataFrame,
    runs: DataFrame,
    models: Sequence[str],
    patterns: Sequence[str] = (),
    now: Column | None = None,
) -> RunPlan:
    """Choose tasks by pattern, register them, and list the runs that are missing.

    ``models`` are catalogue names (see ``resolve_models``). Whoever calls the models takes the
    work list and returns attempts for ``validate_outputs`` and ``upsert_runs``.
    """
    chosen = filter_tasks(tasks, patterns)
    return RunPlan(
        registry=upsert_tasks(registry, chosen, now),
        work=missing_executions(chosen, models, runs),
        counts=cache_counts(chosen, models, runs),
    )


def results(
    runs: DataFrame,
    registry: DataFrame,
    by_task: bool = False,
    patterns: Sequence[str] = (),
    model_filter: str | None = None,
) -> DataFrame:
    """Results by model, or by task: with patterns the single runs, without them a summary."""
    if not by_task:
        return summary_by_model(runs, registry, patterns, model_filter)
    if patterns:
        return runs_for_display(runs, registry, patterns, model_filter)
    return summary_by_task(runs, registry, model_filter=model_filter)


def plan_prune(registry: DataFrame, runs: DataFrame, current: DataFrame) -> PrunePlan:
    """Find the runs and task rows of tasks that are no longer among the current ones."""
    return PrunePlan(
        report=orphan_report(runs, registry, current),
        totals=orphan_totals(runs, current),
        registry=prune_tasks(registry, runs, current),
        runs=prune_runs(runs, current),
    )
