from pyspark.sql import functions as F

from evalspark import plan_prune, plan_runs, results, scan_tree, upsert_runs
from evalspark.schemas import TASK_RUNS, TASKS
from evalspark.sources.tables import empty_table
from tests.conftest import DAY, rows_of
from tests.test_tree import LEAF, node, write


def test_a_round_of_runs_from_files_to_results(spark, tmp_path):
    root = write(
        tmp_path / "tasks",
        {
            "math/description.md": node("math"),
            "math/sum/description.md": node("sum", LEAF),
            "math/product/description.md": node("product", LEAF + "# Assistant\nok\n"),
            "essay/description.md": node("essay", LEAF),
        },
    )
    tasks = scan_tree(spark, root)
    now = F.lit(DAY).cast("timestamp_ntz")
    plan = plan_runs(tasks, empty_table(spark, TASKS), empty_table(spark, TASK_RUNS), ["a/x", "b/y"], ["math::*"], now)
    assert rows_of(plan.counts) == [(2, 2, 4, 0, 4)]
    assert rows_of(plan.registry, "display_name") == [("math / product",), ("math / sum",)]

    # A model has answered: x is right everywhere, y fails.
    attempts = plan.work.select(
        "task_id",
        F.lit("h").alias("messages_hash"),
        "model",
        F.lit("answer").alias("output"),
        F.lit(10.0).alias("duration_ms"),
        F.when(F.col("model") == "b/y", F.lit("down")).alias("error"),
        F.when(F.col("model") == "a/x", F.lit(True)).alias("validation_passed"),
        F.when(F.col("model") == "a/x", F.lit(1.0)).alias("validation_score"),
        *[F.lit(None).cast("string").alias(f"validation_{name}") for name in ("reason", "metadata", "rubric")],
        F.lit(False).alias("validation_pending"),
        F.lit(None).cast("string").alias("run_config"),
        now.alias("created_at"),
    )
    runs = upsert_runs(empty_table(spark, TASK_RUNS), attempts, ["created_at"])
    again = plan_runs(tasks, plan.registry, runs, ["a/x", "b/y", "c/z"], ["math::*"], now)
    assert rows_of(again.counts) == [(2, 3, 6, 4, 2)]
    assert rows_of(again.work, "model") == [("c/z",), ("c/z",)]

    assert rows_of(results(runs, plan.registry), "model", "passed") == [("a/x", 2)]
    assert rows_of(results(runs, plan.registry, by_task=True), "display_name", "total_runs") == [
        ("math / product", 1),
        ("math / sum", 1),
    ]
    shown = results(runs, plan.registry, by_task=True, patterns=["*::sum"])
    assert rows_of(shown, "display_name", "model") == [("math / sum", "a/x")]

    prune = plan_prune(plan.registry, runs, tasks.filter("element_at(id_chain, -1) <> 'sum'"))
    assert rows_of(prune.totals) == [(1, 2)]
    assert rows_of(prune.report, "name", "run_count") == [("math / sum", 2)]
    assert rows_of(prune.registry, "display_name") == [("math / product",)]
    assert prune.runs.count() == 2
