from datetime import datetime

from pyspark.sql import types as T

from evalspark.operators.upsert import merge_runs, upsert_runs
from evalspark.schemas import TASK_RUNS
from evalspark.sources.tables import empty_table
from evalspark.streaming.ingest import (
    attempt_schema,
    current_runs,
    ingest_runs,
    log_position,
    read_attempts,
    read_log,
    write_batch,
)
from tests.conftest import plan_of, rows_of

SCHEMA = attempt_schema(T.StructField("at", T.IntegerType()))


def batches(make_attempts):
    def attempt(task, model, output, number):
        return {
            "task_id": task, "model": model, "output": output, "at": number,
            "created_at": datetime(2024, 1, 1, 0, 0, number),
        }

    return [
        make_attempts(attempt("t", "m", "one", 1), attempt("t", "m", "two", 2), attempt("u", "m", "three", 3)),
        make_attempts(attempt("t", "m", "four", 4), attempt("v", "m", "five", 5)),
        # A late record: an older attempt that arrives in a later batch is still the last one saved.
        make_attempts(attempt("v", "m", "late", 0), attempt("u", "n", "six", 6)),
    ]


def run_stream(spark, folder, log, checkpoint=None):
    query = ingest_runs(read_attempts(spark, folder, SCHEMA, max_files=1), log, ["at"], checkpoint)
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_equals_upserts_of_the_same_batches(spark, make_attempts, tmp_path):
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    expected = empty_table(spark, TASK_RUNS)
    for batch in batches(make_attempts):
        batch.select(SCHEMA.fieldNames()).coalesce(1).write.mode("append").parquet(folder)
        run_stream(spark, folder, log)  # progress is kept in the session's checkpoint folder
        expected = upsert_runs(expected, batch, ["at"])
        assert rows_of(read_log(spark, log)) == rows_of(expected)
    assert read_log(spark, log).count() == 4
    report = plan_of(read_log(spark, log).groupBy("model").avg("duration_ms"))
    assert "duration_ms" in report and "output:string" not in report


def test_a_replayed_batch_changes_nothing(spark, make_attempts, tmp_path):
    log = str(tmp_path / "log")
    for number, batch in enumerate(batches(make_attempts)):
        write_batch(batch, number, log, ["at"])
    before = rows_of(read_log(spark, log))
    write_batch(batches(make_attempts)[1], 1, log, ["at"])
    assert rows_of(read_log(spark, log)) == before


def test_the_log_lies_on_top_of_a_base(spark, make_attempts, make_runs, tmp_path):
    log = str(tmp_path / "log")
    base = make_runs({"task_id": "t", "model": "m", "output": "base"}, {"task_id": "w", "model": "m"})
    for number, batch in enumerate(batches(make_attempts)):
        write_batch(batch, number, log, ["at"])
    found = current_runs(base, log)
    assert rows_of(found) == rows_of(merge_runs(base, read_log(spark, log)))
    assert found.count() == 5
    assert rows_of(found.filter("task_id = 't'"), "output", "created_at") == [("four", datetime(2024, 5, 1))]


def test_folding_part_of_the_log_into_a_new_base(spark, make_attempts, make_runs, tmp_path):
    log = str(tmp_path / "log")
    base = make_runs({"task_id": "t", "model": "m", "output": "base"})
    for number, batch in enumerate(batches(make_attempts)):
        write_batch(batch, number, log, ["at"])
    folded = current_runs(base, log, through=1)
    assert rows_of(current_runs(folded, log, after=1)) == rows_of(current_runs(base, log))
    assert read_log(spark, log, after=1).count() == 2


def one(make_attempts, folder, task, output, number=1):
    batch = make_attempts({"task_id": task, "model": "m", "output": output, "at": number})
    batch.select(SCHEMA.fieldNames()).coalesce(1).write.mode("append").parquet(folder)


def test_logs_of_one_name_do_not_share_progress(spark, make_attempts, tmp_path):
    folder = str(tmp_path / "in")
    one(make_attempts, folder, "t", "x")
    for place in ("a", "b"):
        run_stream(spark, folder, str(tmp_path / place / "log"))
        assert read_log(spark, str(tmp_path / place / "log")).count() == 1


def test_sources_and_checkpoints_do_not_replace_each_other(spark, make_attempts, tmp_path):
    log = str(tmp_path / "log")
    one(make_attempts, str(tmp_path / "in1"), "t", "first")
    one(make_attempts, str(tmp_path / "in2"), "u", "second")
    one(make_attempts, str(tmp_path / "in2"), "t", "later", 0)
    run_stream(spark, str(tmp_path / "in1"), log, str(tmp_path / "c1"))
    run_stream(spark, str(tmp_path / "in2"), log, str(tmp_path / "c2"))
    assert rows_of(read_log(spark, log), "task_id", "output") == [("t", "later"), ("u", "second")]
    one(make_attempts, str(tmp_path / "in3"), "v", "third")
    run_stream(spark, str(tmp_path / "in3"), log, str(tmp_path / "c3"))
    assert read_log(spark, log).count() == 3
    position = log_position(spark, log)
    assert len(position) == 3
    assert read_log(spark, log, after=position).count() == 0
    assert read_log(spark, log, through=position).count() == 3


def test_reports_read_what_they_need(spark, make_attempts, make_runs, tmp_path):
    log = str(tmp_path / "log")
    base = str(tmp_path / "base")
    make_runs({"task_id": "w", "model": "m", "output": "base"}).write.parquet(base)
    for number, batch in enumerate(batches(make_attempts)):
        write_batch(batch, number, log, ["at"])
    found = current_runs(spark.read.parquet(base), log, columns=["model", "duration_ms"])
    assert found.count() == 5 and "output#" not in plan_of(found.groupBy("model").avg("duration_ms"))
    some = current_runs(spark.read.parquet(base), log, tasks=["t", "w"])
    assert rows_of(some, "task_id", "output") == [("t", "four"), ("w", "base")]
    assert all("task_id" in line for line in plan_of(some).splitlines() if "PushedFilters" in line)


def test_a_log_without_a_batch_is_empty(spark, make_runs, tmp_path):
    log = str(tmp_path / "log")
    base = make_runs({"task_id": "t", "model": "m"})
    assert log_position(spark, log) == {}
    assert read_log(spark, log).count() == 0
    assert rows_of(current_runs(base, log, after=3), "task_id", "model") == [("t", "m")]
