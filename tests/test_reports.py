import csv

from evalspark.plans import summaries
from evalspark.sources.tables import write_csv
from tests.conftest import MESSAGE_PAIR, plan_of, rows_of


def test_summary_by_model(make_runs):
    runs = make_runs(
        {"task_id": "t", "model": "a/model1", "validation_passed": True, "validation_score": 0.9},
        {"task_id": "u", "model": "a/model1", "validation_pending": True, "validation_score": 0.0, "duration_ms": 50.0},
        {"task_id": "v", "model": "a/model1", "duration_ms": 300.0},
        {"task_id": "w", "model": "a/model1", "error": "x", "validation_score": 1.0},
        {"task_id": "t", "model": "unscored"},
        {"task_id": "t", "model": "best", "validation_passed": True, "validation_score": 1.0},
    )
    found = [tuple(r) for r in summaries.summary_by_model(runs).collect()]
    assert found == [
        ("best", "best", 1, 1, 100.0, 1.0, 100.0),
        # Pending runs lower the average, runs without a score do not; both lower the rate.
        ("a/model1", "model1", 3, 1, 100.0 / 3, 0.45, 150.0),
        ("unscored", "unscored", 1, 0, 0.0, None, 100.0),
    ]


def test_summary_by_task(make_runs, make_tasks, register):
    tasks = make_tasks(("/p", ["a", "b"], MESSAGE_PAIR))
    key = tasks.first().task_id
    runs = make_runs(
        {"task_id": key, "model": "openrouter/openai/gpt-5.2"},
        {"task_id": key, "model": "openrouter/anthropic/claude-opus-4.6", "validation_passed": True, "validation_score": 1.0},
        {"task_id": "gone", "model": "openrouter/openai/gpt-5.2", "validation_score": 0.5},
    )
    registry = register(tasks)
    narrowed = summaries.summary_by_task(runs, registry, ["a::*"], "gpt-5.2").collect()
    assert [(r.task_id, r.total_runs) for r in narrowed] == [(key, 1)]
    everything = [tuple(r) for r in summaries.summary_by_task(runs, registry).collect()]
    assert everything == [("a / b", key, 2, 1, 50.0, 1.0), (None, "gone", 1, 0, 0.0, 0.5)]


def test_names_are_joined_after_the_aggregation(make_runs, make_tasks, register):
    runs = make_runs({"task_id": "t", "model": "m"})
    plan = plan_of(summaries.summary_by_task(runs, register(make_tasks(("/p", ["a"], MESSAGE_PAIR)))))
    assert plan.index("LeftOuter") < plan.index("partial_count")


def test_store_counts_and_runs_per_model(make_runs, make_tasks, register):
    runs = make_runs(
        {"task_id": "t", "model": "x/a"},
        {"task_id": "u", "model": "x/a", "error": "e", "validation_pending": True},
        {"task_id": "t", "model": "b", "validation_pending": True},
    )
    registry = register(make_tasks(("/p", ["a"], MESSAGE_PAIR)))
    assert rows_of(summaries.store_counts(registry, runs)) == [(1, 3, 1, 1)]
    assert rows_of(summaries.store_counts(registry.limit(0), runs.limit(0))) == [(0, 0, 0, 0)]
    assert [tuple(r) for r in summaries.runs_per_model(runs).collect()] == [("x/a", "a", 2), ("b", "b", 1)]


def test_outcome_tally_overlaps(make_runs):
    results = make_runs(
        {"task_id": "1", "model": "m", "validation_passed": True, "validation_score": 1.0},
        {"task_id": "2", "model": "m", "validation_passed": False, "validation_score": 0.5},
        {"task_id": "3", "model": "m", "validation_passed": False, "validation_score": 0.0, "error": "validator"},
        {"task_id": "4", "model": "m", "error": "timeout", "output": ""},
        {"task_id": "5", "model": "m"},
        {"task_id": "6", "model": "m", "validation_score": 0.0, "validation_pending": True},
    )
    assert rows_of(summaries.outcome_tally(results)) == [(1, 2, 2, 1, 1)]


def test_task_list_and_tree(make_tasks):
    tasks = make_tasks(
        ("/2", ["b"], MESSAGE_PAIR, True),
        ("/1", ["a", "z"], MESSAGE_PAIR[:1], False),
        ("/3", ["a", "b", "c"], MESSAGE_PAIR, True),
        ("/4", ["a", "b"], MESSAGE_PAIR, True),
    )
    listed = summaries.task_list(tasks).collect()
    assert [(r.chain, r.has_validator, r.messages) for r in listed] == [
        ("a::b", True, 2), ("a::b::c", True, 2), ("a::z", False, 1), ("b", True, 2)
    ]
    assert [r.chain for r in summaries.task_list(tasks, ["a::**", "x"]).collect()] == ["a::b", "a::b::c", "a::z"]
    tree = summaries.task_tree(tasks).drop("node").collect()
    assert [tuple(r) for r in tree] == [
        ("a", 1, "a", True, 3, 0, 0),
        ("a::b", 2, "b", True, 2, 1, 1),
        ("a::b::c", 3, "c", False, 1, 1, 1),
        ("a::z", 2, "z", False, 1, 1, 0),
        ("b", 1, "b", False, 1, 1, 1),
    ]


def test_csv_export(make_runs, make_tasks, register, tmp_path):
    tasks = make_tasks(("/p", ["a", "b"], MESSAGE_PAIR))
    runs = make_runs(
        {"task_id": "gone", "model": "m", "error": 'says "no",\nthen stops'},
        {"task_id": tasks.first().task_id, "model": "n", "validation_passed": True, "validation_score": 1.0, "validation_reason": ""},
        {"task_id": tasks.first().task_id, "model": "m"},
    )
    write_csv(summaries.export_rows(runs, register(tasks)).coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    with part.open(newline="") as lines:
        rows = list(csv.reader(lines))
    assert rows[0] == [
        "task", "id_chain", "model", "validation_passed", "validation_score", "validation_reason", "duration_ms", "error", "created_at"
    ]
    assert [row[:5] for row in rows[1:]] == [
        ["a / b", "[a, b]", "m", "", ""], ["a / b", "[a, b]", "n", "true", "1.0"], ["", "", "m", "", ""]
    ]
    assert rows[3][7] == 'says "no",\nthen stops'
    assert rows[1][8] == "2024-05-01 00:00:00"
