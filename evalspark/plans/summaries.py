"""Reports over the task and run tables.

Grouped results have few rows or are grouped by a table key; both aggregate on the map side,
so a hot model or task costs one row per input task. Averages and rates are not rounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.identity import chain_text, message_count, short_model
from evalspark.operators.runs import filter_tasks, is_pending, successful_runs, with_tasks


def _totals() -> list[Column]:
    return [
        F.count("*").alias("total_runs"),
        F.count_if(F.col("validation_passed")).alias("passed"),
        F.avg("validation_score").alias("avg_score"),
    ]


def pass_rate() -> Column:
    """Passed runs per hundred; runs that are pending or have no validation count as not passed."""
    return F.lit(100.0) * F.col("passed") / F.col("total_runs")


def summary_by_model(
    runs: DataFrame,
    tasks: DataFrame | None = None,
    patterns: Sequence[str] = (),
    model_filter: str | None = None,
) -> DataFrame:
    """Per model: runs, passed, pass rate, average score and duration; best score first."""
    found = successful_runs(runs, tasks, patterns, model_filter)
    grouped = found.groupBy("model").agg(*_totals(), F.avg("duration_ms").alias("avg_duration_ms"))
    return grouped.select(
        "model",
        short_model(F.col("model")).alias("model_name"),
        "total_runs",
        "passed",
        pass_rate().alias("pass_rate"),
        "avg_score",
        "avg_duration_ms",
    ).orderBy(F.desc_nulls_last("avg_score"), "model")


def summary_by_task(
    runs: DataFrame,
    tasks: DataFrame,
    patterns: Sequence[str] = (),
    model_filter: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Per task: runs, passed, pass rate, average score; best score first.

    Runs are grouped by task id before the names are joined: the same groups, as a task id has
    one name, and the join then has one row per task instead of one per run.
    """
    grouped = successful_runs(runs, tasks, patterns, model_filter).groupBy("task_id").agg(*_totals())
    named = with_tasks(grouped, tasks, "display_name").select(
        "display_name", "task_id", "total_runs", "passed", pass_rate().alias("pass_rate"), "avg_score"
    )
    if ordered:
        named = named.orderBy(F.desc_nulls_last("avg_score"), "task_id")
    return named


def runs_per_model(runs: DataFrame) -> DataFrame:
    """(model, model_name, runs), most first; failed runs count too."""
    grouped = runs.groupBy("model").agg(F.count("*").alias("runs"))
    return grouped.select("model", short_model(F.col("model")).alias("model_name"), "runs").orderBy(
        F.desc("runs"), "model"
    )


def store_counts(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """(tasks, runs, errors, pending): one row, one pass over each table."""
    counted = runs.agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(is_pending()).alias("pending"),
    )
    task_count = tasks.agg(F.count("*")).scalar()
    return counted.select(task_count.alias("tasks"), "runs", "errors", "pending")


def outcome_tally(results: DataFrame) -> DataFrame:
    """(passed, failed, errors, no_validation, pending) of a batch of results.

    The counts overlap: a failing validator gives a failed result that is also an error. A
    result has a validation when it has a score.
    """
    has_validation = F.col("validation_score").isNotNull()
    passed = F.coalesce(F.col("validation_passed"), F.lit(False))
    pending = F.coalesce(F.col("validation_pending"), F.lit(False))
    # An empty error text counts as no error here.
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return results.agg(
        F.count_if(has_validation & passed).alias("passed"),
        F.count_if(has_validation & ~passed & ~pending).alias("failed"),
        F.count_if(failed).alias("errors"),
        F.count_if(~has_validation & ~failed).alias("no_validation"),
        F.count_if(has_validation & pending).alias("pending"),
    )


def task_list(tasks: DataFrame, patterns: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """(id_chain, chain, has_validator, messages), in the order of the chains."""
    rows = filter_tasks(tasks, patterns).select(
        "id_chain",
        chain_text(F.col("id_chain")).alias("chain"),
        "has_validator",
        message_count(F.col("messages")).alias("messages"),
        "path",
    )
    if ordered:
        rows = rows.orderBy("id_chain", "path")
    return rows.drop("path")


def task_tree(tasks: DataFrame, patterns: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """Every node of the id-chain tree.

    ``tasks`` counts the tasks at or below a node, ``own_tasks`` those that end there, and
    ``own_validators`` those of them with a validator; a branch has tasks further down.
    """
    chain = F.col("id_chain")
    found = filter_tasks(tasks, patterns).filter(F.size(chain) > 0)
    steps = found.select(
        "id_chain",
        "has_validator",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(chain)), lambda n: F.slice(chain, F.lit(1), n))).alias("node"),
    )
    ends = F.size("node") == F.size("id_chain")
    nodes = steps.groupBy("node").agg(
        F.count("*").alias("tasks"),
        F.count_if(ends).alias("own_tasks"),
        F.count_if(ends & F.col("has_validator")).alias("own_validators"),
    )
    rows = nodes.select(
        "node",
        chain_text(F.col("node")).alias("chain"),
        F.size("node").alias("depth"),
        F.element_at("node", -1).alias("name"),
        (F.col("tasks") > F.col("own_tasks")).alias("is_branch"),
        "tasks",
        "own_tasks",
        "own_validators",
    )
    if ordered:
        rows = rows.orderBy("node")
    return rows


def list_text(items: Column) -> Column:
    """An array as ``[a, b]``, for formats without arrays.

    An element is quoted where it could be read as something else: empty text, blanks at an end,
    ``null``, and whatever has a comma, quote, bracket, colon, equals sign or backslash.
    """

    def element(item: Column) -> Column:
        odd = item.rlike(r"""\A\z|\A\s|\s\z|\A(?i:null)\z|[,'"\[\]{}():=\\]""")
        quoted = F.concat(F.lit("'"), F.regexp_replace(item, r"(['\\])", r"\\$1"), F.lit("'"))
        return F.when(item.isNull(), "NULL").when(odd, quoted).otherwise(item)

    return F.concat(F.lit("["), F.array_join(F.transform(items, element), ", "), F.lit("]"))


#: Order of the export; the last has no ties.
EXPORT_ORDER = ("task", "model", "execution_id")


def export_rows(runs: DataFrame, tasks: DataFrame, ordered: bool = True) -> DataFrame:
    """The nine columns of the CSV export, failed runs included, by task and model, NULLs last."""
    narrow = runs.select(
        "execution_id",
        "task_id",
        "model",
        "validation_passed",
        "validation_score",
        "validation_reason",
        "duration_ms",
        "error",
        "created_at",
    )
    rows = with_tasks(narrow, tasks, "display_name", "id_chain").withColumnRenamed("display_name", "task")
    if ordered:
        rows = rows.orderBy(*[F.asc_nulls_last(name) for name in EXPORT_ORDER])
    return rows.select(
        "task",
        list_text(F.col("id_chain")).alias("id_chain"),
        "model",
        "validation_passed",
        "validation_score",
        "validation_reason",
        "duration_ms",
        "error",
        "created_at",
    )
