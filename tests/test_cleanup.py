import pytest

from evalspark.operators import cleanup
from tests.conftest import MESSAGE_PAIR, plan_of, rows_of


@pytest.fixture
def store(make_tasks, make_runs, register):
    tasks = make_tasks(
        ("/a", ["kept"], MESSAGE_PAIR), ("/b", ["deleted"], MESSAGE_PAIR), ("/c", ["never run"], MESSAGE_PAIR)
    )
    ids = {r.path: r.task_id for r in tasks.collect()}
    runs = make_runs(
        {"task_id": ids["/a"], "model": "m"},
        {"task_id": ids["/b"], "model": "m", "error": "x"},
        {"task_id": ids["/b"], "model": "n"},
        {"task_id": "unregistered", "model": "m"},
    )
    # A run without a task has no execution id either; it can only come from elsewhere.
    homeless = runs.limit(1).selectExpr("'e' AS execution_id", "CAST(NULL AS STRING) AS task_id", "* EXCEPT (execution_id, task_id)")
    current = tasks.filter("path = '/a'")
    return register(tasks), runs.unionByName(homeless), current, ids


def test_orphans(store):
    tasks, runs, current, ids = store
    assert rows_of(cleanup.orphan_task_ids(runs, current)) == sorted([(ids["/b"],), ("unregistered",)])
    assert rows_of(cleanup.orphan_report(runs, tasks, current)) == [("deleted", ids["/b"], "deleted", 2)]
    assert rows_of(cleanup.orphan_totals(runs, current)) == [(2, 3)]


def test_nameless_orphans_are_reported_by_id(store):
    tasks, runs, current, ids = store
    nameless = tasks.selectExpr("task_id", "'' AS display_name")
    assert rows_of(cleanup.orphan_report(runs, nameless, current), "name") == [(ids["/b"][:16],)]


def test_prune(store):
    tasks, runs, current, ids = store
    assert rows_of(cleanup.prune_runs(runs, current), "task_id") == sorted([(ids["/a"],), (None,)], key=repr)
    assert rows_of(cleanup.prune_tasks(tasks, runs, current), "display_name") == [("kept",), ("never run",)]
    assert plan_of(cleanup.prune_runs(runs, current)).count("Join") == plan_of(runs).count("Join") + plan_of(current).count("Join") + 1


def test_prune_without_orphans_changes_nothing(store):
    tasks, runs, current, _ = store
    everything = runs.selectExpr("coalesce(task_id, 'none') AS task_id").distinct()
    assert cleanup.prune_runs(runs, everything).count() == runs.count()
    assert cleanup.prune_tasks(tasks, runs, everything).count() == 3


def test_clean(store):
    _, runs, _, _ = store
    assert rows_of(cleanup.clean_counts(runs)) == [(5, 1)]
    assert cleanup.clean_errors(runs).count() == 4
    assert cleanup.clean_runs(runs).count() == 0
    assert cleanup.clean_runs(runs).schema == runs.schema
