import random
from datetime import datetime

import pytest
from pyspark.sql import types as T

from evalspark.operators.cleanup import clean_errors, clean_runs, prune_runs
from evalspark.operators.grading import apply_grades
from evalspark.operators.upsert import upsert_runs
from evalspark.plans.totals import run_totals
from evalspark.schemas import TASK_RUNS
from evalspark.sources.tables import empty_table
from evalspark.streaming import changes
from evalspark.streaming.ingest import attempt_schema, read_attempts
from tests.conftest import plan_of, rows_of

TASK_IDS, MODELS = ["t0", "t1", "t2", "t3"], ["m", "n"]


def local(spark, df, schema=TASK_RUNS):
    """The rows as a table without a history, so that plans stay short."""
    return spark.createDataFrame(df.collect(), schema)


def some_attempts(make_attempts, rng, step):
    return make_attempts(
        *[
            {
                "task_id": rng.choice(TASK_IDS), "model": rng.choice(MODELS), "output": f"{step}/{i}", "at": rng.randrange(9) * 10 + i,
                "error": rng.choice([None, None, "failed"]), "validation_score": rng.choice([None, 0.5, 1.0]),
                "created_at": datetime(2024, 1, 1, step // 60, step % 60, i),
            }
            for i in range(rng.randint(1, 4))
        ]
    )


def some_grades(spark, table, rng):
    ids = [row[0] for row in table.select("execution_id").collect()] + ["unknown", None]
    rows = [(rng.choice(ids), rng.choice([0.0, 0.5, 1.0, 0.7]), f"r{i}", i) for i in range(3)]
    return spark.createDataFrame(rows, "execution_id string, score double, reason string, at int")


@pytest.mark.parametrize("seed", [2])
def test_any_interleaving_equals_the_steps_on_tables(spark, make_attempts, tmp_path, seed):
    rng, store = random.Random(seed), str(tmp_path / "store")
    table, numbers, last = empty_table(spark, TASK_RUNS), {}, None
    for step in range(12):
        kind = rng.choice(["put", "put", "put", "grade", "grade", "prune", "errors", "all"][: 7 if step % 8 else 8])
        stream = f"{kind}{rng.randrange(2)}"
        number = numbers[stream] = numbers.get(stream, -1) + 1
        where = (store, stream, number)
        if kind == "put":
            batch = some_attempts(make_attempts, rng, step)
            table, last = upsert_runs(table, batch, ["at"]), lambda b=batch, w=where: changes.put_runs(b, ["at"], *w)
        elif kind == "grade":
            grades = some_grades(spark, table, rng)
            table, last = apply_grades(table, grades, ["at"]), lambda g=grades, w=where: changes.put_grades(g, ["at"], *w)
        elif kind == "prune":
            current = spark.createDataFrame([(t,) for t in rng.sample(TASK_IDS, 3)], "task_id string")
            table, last = prune_runs(table, current), lambda c=current, w=where: changes.prune_store(c, *w)
        else:
            table = clean_errors(table) if kind == "errors" else clean_runs(table)
            last = lambda w=where, only=kind == "errors": changes.clean_store(spark, *w, only_errors=only)
        last()
        table = local(spark, table)
        if rng.random() < 0.3:
            last()  # a replay
        if step in (1, 6):
            changes.keep_totals(spark, store)  # foldings keep them from here on
        if rng.random() < 0.3:
            changes.fold_store(spark, store)
            last()  # a replay of a batch that is in the base
        if rng.random() < 0.3:
            changes.drop_folded(spark, store)
        if step % 4 == 3:
            assert rows_of(changes.store_runs(spark, store)) == rows_of(table), (seed, step)
            assert rows_of(changes.store_totals(spark, store)) == rows_of(run_totals(table)), (seed, step)
    assert rows_of(changes.store_runs(spark, store)) == rows_of(table)
    changes.fold_store(spark, store)
    assert rows_of(changes.store_runs(spark, store)) == rows_of(table)


def test_an_empty_store(spark, tmp_path):
    store = str(tmp_path / "store")
    assert changes.store_runs(spark, store).count() == 0
    assert changes.store_position(spark, store) == {}
    assert changes.fold_store(spark, store).fold == -1
    assert changes.drop_folded(spark, store) == 0


def states(spark, store):
    return rows_of(changes.store_runs(spark, store), "task_id", "output")


def test_a_stop_between_any_two_steps_leaves_a_readable_state(spark, make_attempts, make_runs, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    changes.begin_store(make_runs({"task_id": "t", "model": "m", "output": "base"}), store)
    with pytest.raises(ValueError, match="already"):
        changes.begin_store(make_runs({"task_id": "t", "model": "m"}), store)
    batch = make_attempts({"task_id": "t", "model": "m", "output": "new"}, {"task_id": "u", "model": "m", "output": "more"})

    real, stops = changes.F.current_timestamp, RuntimeError("stopped")

    def stop():
        raise stops

    with monkeypatch.context() as patch:  # rows are written, the commit is not
        patch.setattr(changes.F, "current_timestamp", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            changes.put_runs(batch, ["at"], store, "s", 0)
    assert changes.F.current_timestamp is real
    assert states(spark, store) == [("t", "base")] and changes.store_position(spark, store) == {}
    changes.put_runs(batch, ["at"], store, "s", 0)
    assert states(spark, store) == [("t", "new"), ("u", "more")]

    with monkeypatch.context() as patch:  # the base is written, the pointer is not
        patch.setattr(changes, "_point", lambda *_: stop())
        with pytest.raises(RuntimeError, match="stopped"):
            changes.fold_store(spark, store)
    assert changes.last_pointer(spark, store).fold == 0 and states(spark, store) == [("t", "new"), ("u", "more")]
    assert changes.fold_store(spark, store).position == {"s": 0}
    assert states(spark, store) == [("t", "new"), ("u", "more")]
    changes.put_runs(batch, ["at"], store, "s", 0)  # a replay behind the pointer
    assert changes.committed_entries(spark, store, {"s": 0}).count() == 0


def test_batches_behind_the_pointer_are_not_opened_and_go(spark, make_attempts, tmp_path):
    store = str(tmp_path / "store")
    for number in range(3):
        changes.put_runs(make_attempts({"task_id": f"t{number}", "model": "m"}), ["at"], store, "s", number)
        changes.fold_store(spark, store)
    changes.put_runs(make_attempts({"task_id": "t9", "model": "m"}), ["at"], store, "s", 3)
    pointer = changes.last_pointer(spark, store)
    beyond = changes.committed_entries(spark, store, pointer.position)
    assert pointer.position == {"s": 2} and beyond.count() == 1
    scans = [line for line in plan_of(beyond).splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [CASE WHEN" in line for line in scans)
    assert changes.drop_folded(spark, store) == 5  # a base, and two batches with their commits
    assert changes.store_runs(spark, store).count() == 4
    assert changes.drop_folded(spark, store) == 0


def test_deleted_executions_come_back_as_new_ones(spark, make_attempts, tmp_path):
    store = str(tmp_path / "store")
    first, second = datetime(2024, 1, 1), datetime(2024, 1, 2)
    changes.put_runs(make_attempts({"task_id": "t", "model": "m", "created_at": first}), ["at"], store, "s", 0)
    ids = changes.store_runs(spark, store, []).select("execution_id")
    grades = ids.selectExpr("execution_id", "1.0D AS score", "'good' AS reason")
    changes.delete_runs(local(spark, ids, "execution_id string"), store, "d", 0)
    changes.put_grades(grades, ["score"], store, "g", 0)
    assert changes.store_runs(spark, store).count() == 0
    changes.put_runs(make_attempts({"task_id": "t", "model": "m", "created_at": second}), ["at"], store, "s", 1)
    assert rows_of(changes.store_runs(spark, store), "created_at", "validation_score") == [(second, None)]


def test_streams_and_narrow_reports(spark, make_attempts, tmp_path):
    store, folder = str(tmp_path / "store"), str(tmp_path / "in")
    schema = attempt_schema(T.StructField("at", T.IntegerType()))
    for number in range(2):
        batch = make_attempts({"task_id": f"t{number}", "model": "m"}, {"task_id": "t", "model": "m", "output": str(number)})
        batch.select(schema.fieldNames()).coalesce(1).write.mode("append").parquet(folder)
        query = changes.ingest_changes(read_attempts(spark, folder, schema), store, ["at"])
        query.awaitTermination(120)
        assert query.exception() is None
    assert states(spark, store) == [("t", "1"), ("t0", "output"), ("t1", "output")]
    report = plan_of(changes.store_runs(spark, store, ["model", "duration_ms"]))
    assert "duration_ms" in report and "output:string" not in report
