import math
import random
from datetime import datetime

import pytest

from evalspark.plans import summaries
from evalspark.plans.totals import (
    READ,
    changed_totals,
    merge_totals,
    run_totals,
    totals_by_model,
    totals_by_task,
    totals_counts,
    totals_per_model,
)
from evalspark.schemas import TASK_RUNS
from evalspark.sources.tables import empty_table
from evalspark.streaming import changes
from tests.conftest import plan_of, rows_of

COLUMNS = [name for name in TASK_RUNS.fieldNames() if name != "execution_id"]
ENTRY = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in TASK_RUNS.fields) + ", op string, at int"
IDS = [(f"e{task}{model}", f"t{task}", model) for task in range(3) for model in "mn"]
DAY = datetime(2024, 5, 1)
#: tenths are no binary fractions: plain sums of doubles would not go back to where they were
SCORES = [None, 0.0, 0.1, 0.7, 1.0, 1e-7]


def an_entry(rng, op, key, at):
    row = dict.fromkeys([*TASK_RUNS.fieldNames(), "op"]) | {"execution_id": key[0], "op": op, "at": at}
    if op == changes.PUT:
        score = rng.choice(SCORES)
        row |= {
            "task_id": key[1], "model": key[2], "error": rng.choice([None, None, "failed"]), "created_at": DAY, "duration_ms": rng.choice([None, 0.3, 17.1]),
            "validation_score": score, "validation_passed": rng.choice([None, score == 1.0]), "validation_pending": rng.choice([None, True, False]),
        }
    elif op == changes.GRADE:
        score = rng.choice(SCORES[1:])
        row |= {"validation_score": score, "validation_passed": score == 1.0, "validation_pending": False}
    return tuple(row.values())


def test_random_batches_equal_computing_again(spark):
    """Seven batches one after the other for each of eight sets of executions: 56 in seven steps."""
    rng = random.Random(5)
    table, totals = empty_table(spark, TASK_RUNS), spark.createDataFrame([], run_totals(empty_table(spark, TASK_RUNS)).schema)
    ops = [changes.PUT, changes.PUT, changes.PUT, changes.GRADE, changes.GRADE, changes.DELETE]
    for step in range(7):
        rows = [
            an_entry(rng, rng.choice(ops), tuple(f"{lane}{part}" if at < 2 else part for at, part in enumerate(key)), place)
            for lane in range(8)
            for place in range(rng.randint(1, 2))
            for key in rng.sample([*IDS, ("unknown", "t9", "m")], rng.randint(1, 5))
        ]
        net = changes.net_changes(spark.createDataFrame(rows, ENTRY).coalesce(1), COLUMNS)
        pairs = changes.changed_runs(table, net, READ)
        totals = spark.createDataFrame(merge_totals(totals, changed_totals(pairs)).collect(), totals.schema)
        table = spark.createDataFrame(changes.apply_changes(table, net, COLUMNS).collect(), TASK_RUNS)
        assert rows_of(totals) == rows_of(run_totals(table)) != [], step


@pytest.fixture(scope="module")
def runs(make_runs, register, make_tasks):
    tasks = register(make_tasks(("/a/x", ["a", "x"], [("user", "1")]), ("/b/y", ["b", "y"], [("user", "2")])))
    first, second = (row[0] for row in tasks.select("task_id").orderBy("id_chain").collect())
    rows = [
        {"task_id": task, "model": f"p/{model}", "validation_score": score, "validation_passed": score == 1.0, "error": error,
         "validation_pending": score is None, "duration_ms": 0.5 * at}
        for at, (task, model, score, error) in enumerate([
            (first, "m", 1.0, None), (first, "n", None, None), (second, "m", 0.25, None), (second, "n", 0.5, "failed"), ("gone", "m", 0.5, None),
        ])
    ]
    return make_runs(*rows), tasks


def test_reports_equal_those_of_the_run_table(runs):
    table, tasks = runs
    totals = run_totals(table)
    for patterns, model in [((), None), (["a::*"], None), ((), "M"), (["b::*", "a::*"], "p/n")]:
        assert totals_by_model(totals, tasks, patterns, model).collect() == summaries.summary_by_model(table, tasks, patterns, model).collect()
        assert totals_by_task(totals, tasks, patterns, model).collect() == summaries.summary_by_task(table, tasks, patterns, model).collect()
    assert totals_per_model(totals).collect() == summaries.runs_per_model(table).collect()
    assert totals_counts(tasks, totals).collect() == summaries.store_counts(tasks, table).collect()
    with pytest.raises(ValueError, match="task table"):
        totals_by_model(totals, patterns=["a"])


def test_nothing_and_values_that_are_no_decimal(spark, make_runs, register, make_tasks):
    empty = run_totals(empty_table(spark, TASK_RUNS))
    assert empty.count() == 0 and totals_by_model(empty).count() == 0
    odd = make_runs(*[{"task_id": f"t{at}", "model": "m", "validation_score": value} for at, value in enumerate([math.nan, math.inf, 1e300, 0.5])])
    totals = run_totals(odd)
    assert math.isnan(totals_by_model(totals).collect()[0]["avg_score"])
    gone = changed_totals(odd.filter("validation_score <> 0.5").selectExpr(f"struct({', '.join(READ)}) AS old", f"CAST(NULL AS STRUCT<{', '.join(f'{n}: {TASK_RUNS[n].dataType.simpleString()}' for n in READ)}>) AS new"))
    left = merge_totals(totals, gone)
    assert rows_of(totals_by_model(left), "total_runs", "avg_score") == [(1, 0.5)]


def test_kept_totals_are_read_alone_and_follow_foldings(spark, make_attempts, tmp_path):
    store = str(tmp_path / "store")
    for number in range(2):
        changes.put_runs(make_attempts({"task_id": f"t{number}", "model": "m", "validation_score": 0.5}), ["at"], store, "s", number)
        changes.fold_store(spark, store)
    assert changes.last_pointer(spark, store, changes.TOTALS_POINTERS).base is None  # nobody asked for them yet
    first = changes.keep_totals(spark, store)
    assert changes.keep_totals(spark, store) == first
    plan = plan_of(changes.store_totals(spark, store))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan

    changes.put_runs(make_attempts({"task_id": "t1", "model": "m", "validation_score": 1.0}), ["at"], store, "s", 2)
    ask = lambda **how: rows_of(totals_by_model(changes.store_totals(spark, store, **how)), "total_runs", "avg_score")
    assert ask(current=False) == [(2, 0.5)] and ask() == [(2, 0.75)]
    changes.fold_store(spark, store)
    assert changes.last_pointer(spark, store, changes.TOTALS_POINTERS).position == {"s": 2}
    assert ask(current=False) == ask() == [(2, 0.75)]
    changes.put_runs(make_attempts({"task_id": "t2", "model": "m", "validation_score": 0.0}), ["at"], store, "s", 3)
    changes.fold_store(spark, store)
    assert changes.drop_folded(spark, store) > 0
    assert ask() == [(3, 0.5)]


def test_a_stop_before_the_pointer_of_the_totals_leaves_the_old_ones(spark, make_attempts, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    changes.put_runs(make_attempts({"task_id": "t", "model": "m"}), ["at"], store, "s", 0)
    changes.keep_totals(spark, store)
    changes.put_runs(make_attempts({"task_id": "u", "model": "m"}), ["at"], store, "s", 1)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(changes, "_point", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            changes.fold_store(spark, store)
    assert changes.last_pointer(spark, store, changes.TOTALS_POINTERS).position == {"s": 0}
    assert rows_of(changes.store_totals(spark, store)) == rows_of(run_totals(changes.store_runs(spark, store)))
