from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evalspark.operators import runs as ops
from evalspark.schemas import TASK_RUNS
from evalspark.sources.tables import empty_table
from tests.conftest import DAY, MESSAGE_PAIR, plan_of, rows_of

GPT, OPUS = "openrouter/openai/gpt-5.2", "openrouter/anthropic/claude-opus-4.6"


@pytest.fixture
def task(make_tasks):
    return make_tasks(("/fake/path", ["test_category", "test_task"], MESSAGE_PAIR))


def test_everything_is_missing_at_first(spark, task):
    missing = ops.missing_executions(task, ["model1", "model2"], empty_table(spark, TASK_RUNS))
    assert rows_of(missing, "model") == [("model1",), ("model2",)]
    assert {r.task_id for r in missing.collect()} == {task.first().task_id}
    assert [tuple(m) for m in missing.first().messages] == MESSAGE_PAIR


def test_stored_and_failed_runs_are_not_missing(task, make_runs):
    key = task.first().task_id
    stored = make_runs({"task_id": key, "model": "model1"}, {"task_id": key, "model": "model3", "error": "boom"})
    assert rows_of(ops.missing_executions(task, ["model1", "model2", "model3"], stored), "model") == [("model2",)]


def test_a_changed_prompt_is_missing_again(make_tasks, make_runs):
    old = make_tasks(("/path", ["cat", "task"], [("user", "Version 1")]))
    new = make_tasks(("/path", ["cat", "task"], [("user", "Version 2")]))
    stored = make_runs({"task_id": old.first().task_id, "model": "model1"})
    assert ops.missing_executions(old, ["model1"], stored).count() == 0
    assert ops.missing_executions(new, ["model1"], stored).count() == 1


def test_repeated_tasks_and_models_stay_repeated(spark, make_tasks):
    tasks = make_tasks(("/a", ["t"], MESSAGE_PAIR), ("/b", ["t"], MESSAGE_PAIR))
    nothing = empty_table(spark, TASK_RUNS)
    assert ops.missing_executions(tasks, ["m", "m", "n"], nothing).count() == 6
    assert ops.planned_executions(tasks, []).count() == 0


def test_counts_of_cached_work(task, make_runs):
    stored = make_runs({"task_id": task.first().task_id, "model": "model1"}, {"task_id": "else", "model": "model1"})
    assert rows_of(ops.cache_counts(task, ["model1", "model2", "model3"], stored)) == [(1, 3, 3, 1, 2)]


def test_existing_executions(task, make_runs):
    planned = ops.planned_executions(task, ["model1", "model2"])
    stored = make_runs({"task_id": task.first().task_id, "model": "model2"})
    assert rows_of(ops.existing_executions(stored, planned)) == rows_of(planned.filter("model = 'model2'"), "execution_id")


def test_joins_for_missing_work_move_only_ids(spark, task, make_runs):
    plan = plan_of(ops.missing_executions(task, ["m"], make_runs({"task_id": "t", "model": "m"})))
    assert "LeftAnti" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_scan_of_runs(make_runs):
    stored = make_runs(
        {"task_id": "t", "model": "model1", "created_at": DAY},
        {"task_id": "t", "model": "model2", "created_at": datetime(2024, 5, 2)},
        {"task_id": "u", "model": "model1", "created_at": datetime(2024, 5, 3)},
    )
    assert [r.created_at.day for r in ops.task_runs(stored).collect()] == [3, 2, 1]
    assert ops.task_runs(stored).columns == TASK_RUNS.fieldNames()
    assert {r.model for r in ops.task_runs(stored, model="model1").collect()} == {"model1"}
    assert ops.task_runs(stored, task_id="t", model="model1").count() == 1


@pytest.mark.parametrize(
    ("text", "expected"),
    [("GPT", {"a/gpt_1", "a/gpt-1"}), ("gpt_1", {"a/gpt_1", "a/gpt-1"}), ("a%1", {"a/gpt_1", "a/gpt-1"}), ("\\", {"b\\c"}), ("b\\c", {"b\\c"})],
)
def test_model_like(spark, text, expected):
    rows = spark.createDataFrame([("a/gpt_1",), ("a/gpt-1",), ("b\\c",)], "model string")
    assert {r.model for r in rows.filter(ops.model_like(F.col("model"), text)).collect()} == expected


def test_model_contains_is_plain(spark):
    rows = spark.createDataFrame([("a/gpt_1",), ("a/gpt-1",)], "model string")
    assert rows_of(rows.filter(ops.model_contains(F.col("model"), "GPT_"))) == [("a/gpt_1",)]


@pytest.fixture
def two_trees(make_tasks, make_runs, register):
    tasks = make_tasks(
        ("/alpha", ["alpha", "first"], MESSAGE_PAIR), ("/beta", ["beta", "second"], [("user", "different")])
    )
    ids = {r.path: r.task_id for r in tasks.collect()}
    stored = make_runs(
        {"task_id": ids["/alpha"], "model": GPT},
        {"task_id": ids["/beta"], "model": GPT},
        {"task_id": ids["/alpha"], "model": OPUS},
        {"task_id": ids["/alpha"], "model": "failed", "error": "x"},
        {"task_id": "gone", "model": GPT},
    )
    return register(tasks), stored, ids


def test_display_combines_filters(two_trees):
    tasks, stored, ids = two_trees
    rows = ops.runs_for_display(stored, tasks, ["alpha::*"], "gpt-5.2").collect()
    assert [(r.task_id, r.model) for r in rows] == [(ids["/alpha"], GPT)]


def test_display_order_puts_unknown_tasks_last(two_trees):
    tasks, stored, _ = two_trees
    rows = ops.runs_for_display(stored, tasks).collect()
    assert [(r.display_name, r.model) for r in rows] == [
        ("alpha / first", OPUS), ("alpha / first", GPT), ("beta / second", GPT), (None, GPT)
    ]


def test_patterns_need_tasks_and_may_match_nothing(two_trees):
    tasks, stored, _ = two_trees
    assert ops.runs_for_display(stored, tasks, ["nothing"]).count() == 0
    with pytest.raises(ValueError, match="task table"):
        ops.successful_runs(stored, None, ["a"])


def test_pattern_filter_is_a_semi_join(two_trees):
    tasks, stored, _ = two_trees
    assert "LeftSemi" in plan_of(ops.successful_runs(stored, tasks, ["alpha::*"]))


def test_grading_queue(two_trees, make_runs):
    tasks, _, ids = two_trees
    stored = make_runs(
        {"task_id": ids["/beta"], "model": "p/Two", "validation_pending": True, "validation_rubric": "r", "created_at": datetime(2024, 5, 2)},
        {"task_id": "gone", "model": "p/one", "validation_pending": True},
        {"task_id": "t", "model": "p/three", "validation_pending": True, "error": "x"},
        {"task_id": "t", "model": "p/four"},
    )
    queue = ops.pending_grades(stored, tasks)
    assert [(r.model, r.display_name, r.path, r.validation_rubric) for r in queue.collect()] == [
        ("p/one", None, None, None),
        ("p/Two", "beta / second", "/beta", "r"),
    ]
    assert queue.columns == [
        "execution_id", "task_id", "model", "output", "validation_rubric", "created_at", "display_name", "id_chain", "path"
    ]
    assert rows_of(ops.pending_grades(stored, tasks, "TWO"), "model") == [("p/Two",)]
    assert rows_of(ops.pending_count(stored)) == [(2,)]
