from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.functions.identity import execution_id
from evalspark.operators.upsert import (
    _possible_ends,
    flatten_validation,
    json_or_null,
    merge_runs,
    reduce_attempts,
    upsert_runs,
    upsert_tasks,
)
from evalspark.schemas import TASK_RUNS, TASKS, VALIDATION, SchemaError
from evalspark.sources.tables import empty_table
from tests.conftest import DAY, MESSAGE_PAIR, plan_of, rows_of

LATER = datetime(2024, 6, 1)


def at(moment):
    return F.lit(moment).cast("timestamp_ntz")


def test_insert_task(register, make_tasks):
    tasks = make_tasks(("/fake/path", ["test_category", "test_task"], MESSAGE_PAIR))
    found = register(tasks).collect()
    assert [(t.display_name, t.path) for t in found] == [("test_category / test_task", "/fake/path")]
    assert found[0].task_id == tasks.first().task_id


def test_same_task_again_updates_and_keeps_its_first_time(spark, make_tasks):
    first = make_tasks(("/path1", ["cat", "task"], MESSAGE_PAIR), ("/x", ["other"], MESSAGE_PAIR))
    second = make_tasks(("/path2", ["cat", "task"], MESSAGE_PAIR), ("/y", ["new"], MESSAGE_PAIR))
    table = upsert_tasks(empty_table(spark, TASKS), first, now=at(DAY))
    table = upsert_tasks(table, second, now=at(LATER))
    assert rows_of(table, "display_name", "path", "created_at", "updated_at") == [
        ("cat / task", "/path2", DAY, LATER),
        ("new", "/y", LATER, LATER),
        ("other", "/x", DAY, DAY),
    ]


def test_last_of_equal_tasks_in_one_batch_counts(spark, make_tasks):
    tasks = make_tasks(
        ("/a/b", ["t"], MESSAGE_PAIR), ("/a-b/c", ["t"], MESSAGE_PAIR), ("/a/a", ["t"], MESSAGE_PAIR)
    )
    table = upsert_tasks(empty_table(spark, TASKS), tasks)
    assert rows_of(table, "path") == [("/a-b/c",)]  # part by part "a" comes before "a-b"


def test_plain_run(make_runs):
    run = make_runs({"task_id": "t", "model": "test-model", "output": "Hello, world!", "duration_ms": 150.5}).first()
    assert (run.model, run.output, run.duration_ms, run.created_at) == ("test-model", "Hello, world!", 150.5, DAY)
    assert run.validation_passed is None and run.validation_pending is False


def test_error_run(make_runs):
    run = make_runs({"task_id": "t", "model": "m", "output": "", "error": "API timeout"}).first()
    assert run.error == "API timeout"


def test_last_attempt_counts_and_first_time_stays(spark, make_attempts):
    first = make_attempts(
        {"task_id": "t", "model": "m", "output": "late", "at": 2, "created_at": LATER},
        {"task_id": "t", "model": "m", "output": "early", "at": 1, "error": "boom"},
        {"task_id": "t", "model": "n", "output": "other", "at": 1},
    )
    table = upsert_runs(empty_table(spark, TASK_RUNS), first, ["at"])
    assert rows_of(table, "model", "output", "error", "created_at") == [
        ("m", "late", None, DAY),
        ("n", "other", None, DAY),
    ]
    second = make_attempts(
        {"task_id": "t", "model": "m", "output": "latest", "validation_score": 0.5, "created_at": LATER,
         "messages_hash": "changed"},
        {"task_id": "u", "model": "m", "output": "new", "created_at": LATER},
    )
    table = upsert_runs(table, second, ["at"])
    assert rows_of(table, "task_id", "model", "output", "validation_score", "created_at", "messages_hash") == [
        ("t", "m", "latest", 0.5, DAY, "hash"),
        ("t", "n", "other", None, DAY, "hash"),
        ("u", "m", "new", None, LATER, "hash"),
    ]


ATTEMPTS = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 99)), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches=st.lists(ATTEMPTS, min_size=1, max_size=3))
def test_batches_equal_one_by_one_upserts(spark, make_attempts, batches):
    table, expected, number = empty_table(spark, TASK_RUNS), {}, 0
    for batch in batches:
        attempts = []
        for task, model, output in batch:
            number += 1
            moment = datetime(2024, 1, 1, 0, number % 60, number // 60)
            attempts.append(
                {"task_id": f"t{task}", "model": f"m{model}", "output": str(output), "created_at": moment, "at": number}
            )
            key = (f"t{task}", f"m{model}")
            expected[key] = (str(output), expected.get(key, (None, moment))[1])
        if attempts:
            table = upsert_runs(table, make_attempts(*attempts), ["at"])
    found = {(r.task_id, r.model): (r.output, r.created_at) for r in table.collect()}
    assert found == expected
    assert table.count() == len(expected)


def test_an_order_is_required(spark, make_attempts):
    with pytest.raises(ValueError, match="order"):
        upsert_runs(empty_table(spark, TASK_RUNS), make_attempts({"task_id": "t", "model": "m"}), [])


def test_tables_are_checked(spark, make_attempts):
    attempts = make_attempts({"task_id": "t", "model": "m"})
    with pytest.raises(SchemaError, match="validation_rubric: expected string, got no column"):
        upsert_runs(empty_table(spark, TASK_RUNS).drop("validation_rubric"), attempts, ["at"])


def test_flattening(spark):
    schema = f"n int, run_config string, validation {VALIDATION.simpleString()}"
    rows = spark.createDataFrame(
        [
            (1, '{"temperature": 0.7, "max_tokens": 1000}', (True, 0.95, "Good answer", '{"key": "value"}', False, None)),
            (2, "{}", (None, 0.0, None, "{}", True, "look")),
            (3, None, None),
        ],
        schema,
    )
    found = flatten_validation(rows).collect()
    assert [tuple(row) for row in found] == [
        (1, '{"temperature": 0.7, "max_tokens": 1000}', True, 0.95, "Good answer", '{"key": "value"}', False, None),
        (2, None, None, 0.0, None, None, True, "look"),
        (3, None, None, None, None, None, False, None),
    ]


def test_empty_json(spark):
    texts = ["{}", " { } ", "", None, '{"a": 1}', "[]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(json_or_null(F.col("t"))).collect()] == [None, None, None, None, '{"a": 1}', "[]"]


def test_a_small_batch_does_not_shuffle_the_table(spark, make_attempts, tmp_path):
    """With a batch below the broadcast limit, the table is read and written in place."""
    stored = spark.range(2000).selectExpr(
        "concat('e', id) AS execution_id", "'t' AS task_id", "'h' AS messages_hash", "'m' AS model",
        "repeat('x', 1000) AS output", "1D AS duration_ms", "CAST(NULL AS STRING) AS error",
        "CAST(NULL AS BOOLEAN) AS validation_passed", "CAST(NULL AS DOUBLE) AS validation_score",
        "CAST(NULL AS STRING) AS validation_reason", "CAST(NULL AS STRING) AS validation_metadata",
        "false AS validation_pending", "CAST(NULL AS STRING) AS validation_rubric",
        "CAST(NULL AS STRING) AS run_config", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS created_at",
    )
    stored.write.parquet(str(tmp_path / "runs"))
    table = spark.read.parquet(str(tmp_path / "runs"))
    # one key that is known and one that is new, so that neither join is found empty as it runs
    batch = reduce_attempts(make_attempts({"task_id": "t", "model": "m", "output": "new"}), ["at"])
    known = batch.withColumn("execution_id", F.lit("e7"))
    batch.unionByName(known).coalesce(1).write.parquet(str(tmp_path / "batch"))
    setting = "spark.sql.maxMetadataStringLength"  # plans shorten paths to this
    before = spark.conf.get(setting)
    spark.conf.set(setting, "10000")
    try:
        merged = merge_runs(table, spark.read.parquet(str(tmp_path / "batch")))
        assert len(merged.collect()) == 2001
        lines = plan_of(merged).split("== Initial Plan ==")[0].splitlines()
    finally:
        spark.conf.set(setting, before)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scans = [at for at, line in enumerate(lines) if "FileScan" in line and "/runs]" in line]
    assert len(scans) == 2
    for at in scans:  # up from the table to the join with the batch
        above = []
        for line in reversed(lines[:at]):
            if depth(line) < depth(lines[at]) and (not above or depth(line) < depth(above[-1])):
                above.append(line)
        first_join = next(i for i, line in enumerate(above) if "Join" in line)
        assert "BroadcastHashJoin" in above[first_join] and "BuildRight" in above[first_join]
        assert not any("Exchange" in line for line in above[:first_join])


def test_a_large_batch_is_shuffled_once(spark, make_attempts, make_runs):
    """Without broadcasts, the second join reuses the shuffle of the reduced batch."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = make_runs({"task_id": "t", "model": "m"}, {"task_id": "u", "model": "m"})
        merged = upsert_runs(table, make_attempts({"task_id": "t", "model": "m"}), ["at"])
        assert merged.count() == 2
        merged.write.format("noop").mode("overwrite").save()
        rows = upsert_runs(table, make_attempts({"task_id": "t", "model": "m"}), ["at"])
        rows.collect()
        assert "ReusedExchange" in plan_of(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_key_is_combined_before_the_shuffle(spark, make_attempts):
    """A third of the attempts is one execution; it is reduced where it is read."""
    attempts = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('t', id)) AS task_id", "'h' AS messages_hash", "'m' AS model",
        "string(id) AS output", "1D AS duration_ms", "CAST(NULL AS STRING) AS error",
        "CAST(NULL AS BOOLEAN) AS validation_passed", "CAST(NULL AS DOUBLE) AS validation_score",
        "CAST(NULL AS STRING) AS validation_reason", "CAST(NULL AS STRING) AS validation_metadata",
        "false AS validation_pending", "CAST(NULL AS STRING) AS validation_rubric",
        "CAST(NULL AS STRING) AS run_config", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS created_at", "int(id) AS at",
    )
    reduced = reduce_attempts(attempts, ["at"])
    plan = plan_of(reduced)
    assert plan.index("Exchange") < plan.index("partial_max_by")
    assert reduced.count() == 2001
    assert rows_of(reduced.filter("task_id = 'hot'"), "output") == [("2997",)]


def test_only_the_ends_are_combined(spark):
    """Of repeated attempts the first and the last alone are sorted with their outputs, with the same result."""
    attempts = spark.range(3000).selectExpr(
        "concat('t', id % 40) AS task_id", "'h' AS messages_hash", "if(id % 40 < 2, NULL, 'm') AS model",
        "string(id) AS output", "1D AS duration_ms", "CAST(NULL AS STRING) AS error",
        "CAST(NULL AS BOOLEAN) AS validation_passed", "CAST(NULL AS DOUBLE) AS validation_score",
        "CAST(NULL AS STRING) AS validation_reason", "CAST(NULL AS STRING) AS validation_metadata",
        "false AS validation_pending", "CAST(NULL AS STRING) AS validation_rubric", "CAST(NULL AS STRING) AS run_config",
        "if(id % 40 = 7 OR id < 80, NULL, timestamp_seconds(1700000000 + id * 7919 % 3001)::timestamp_ntz) AS created_at", "id AS at",
    )
    order = ["created_at", F.col("at")]
    plain, ends = reduce_attempts(attempts, order), reduce_attempts(attempts, order, ends_first=True)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, ends.collect())) and ends.count() == 38
    keyed = attempts.withColumn("execution_id", execution_id(F.col("task_id"), F.col("model"))).filter("execution_id IS NOT NULL")
    assert 76 <= _possible_ends(keyed, F.struct(*order)).count() < 100  # of 2850


def test_records_without_a_key_are_no_runs(make_attempts):
    attempts = make_attempts({"task_id": None, "model": "m"}, {"task_id": "t", "model": None}, {"task_id": "t", "model": "m"})
    assert reduce_attempts(attempts, ["at"]).count() == 1


def test_execution_ids_of_runs(make_runs):
    runs = make_runs({"task_id": "t", "model": "m"})
    assert runs.filter(F.col("execution_id") == execution_id(F.lit("t"), F.lit("m"))).count() == 1
