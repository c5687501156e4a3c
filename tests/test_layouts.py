"""Exports as one file, bucketed runs, upgrade steps."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators import migrations
from evalspark.operators.migrations import Step
from evalspark.sources import tables
from tests.conftest import DAY, plan_of, rows_of


def put_together(folder):
    return b"".join(part.read_bytes() for part in sorted(Path(folder).glob("part-*")))


def copied(frame, order, tmp_path):
    """What COPY writes of the same rows."""
    source, target = str(tmp_path / "rows"), tmp_path / "copy.csv"
    frame.write.parquet(source)
    duckdb.sql(f"COPY (SELECT * FROM '{source}/*.parquet' ORDER BY {order}) TO '{target}' (HEADER, DELIMITER ',')")
    return target.read_bytes()


def test_the_parts_of_an_export_are_one_file(spark, tmp_path):
    rng = random.Random(3)
    odd = ["", None, "a,b", 'say "x"', "two\nlines", "cr\rx", "#c", " a ", "NULL", "tab\t", "\\x", "é", "plain"]
    scores = [None, 0.5, 1.0, 0.0, -0.0, 1e7, 12345678.9, 1e15, 1e16, 1.5e-5, 1e-4, 1e-3, 1e100, float("nan"), float("-inf")]
    rows = [(i, rng.choice(odd), rng.choice(odd), rng.choice([True, False, None]), rng.choice(scores), DAY if i % 3 else None) for i in range(500)]
    frame = spark.createDataFrame(rows, "n int, task string, `a b,c` string, passed boolean, score double, made timestamp_ntz")
    frame = frame.repartition(7)
    tables.write_one_csv(frame, str(tmp_path / "csv"), [F.col("task"), F.col("n")])
    assert put_together(tmp_path / "csv") == copied(frame, "task NULLS LAST, n", tmp_path)
    assert len(list((tmp_path / "csv").glob("part-*"))) >= 1


def test_many_doubles(spark, tmp_path):
    rng = random.Random(4)
    values = [(i, rng.choice([1, -1]) * round(rng.random(), rng.randint(1, 12)) * 10.0 ** rng.randint(-20, 20)) for i in range(300)]
    # what Java 17 prints is not always the shortest form; those are left to it
    values = [row for row in values if len(repr(row[1]).split("e")[0]) < 15]
    frame = spark.createDataFrame(values, "n int, v double")
    tables.write_one_csv(frame, str(tmp_path / "csv"), [F.col("n")])
    assert put_together(tmp_path / "csv") == copied(frame, "n", tmp_path)


def test_an_export_without_rows_is_a_header(spark, tmp_path):
    frame = tables.empty_table(spark, T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.DoubleType())]))
    tables.write_one_csv(frame, str(tmp_path / "csv"), [F.col("a")])
    assert put_together(tmp_path / "csv") == b"a,b\n"


def test_joins_on_buckets_move_nothing(spark, make_runs, tmp_path):
    runs = make_runs(*[{"task_id": f"t{i}", "model": "m"} for i in range(20)])
    for name in ("runs_a", "runs_b"):
        tables.write_run_buckets(runs, name, str(tmp_path / name), 4)
    try:
        left, right = spark.table("runs_a"), spark.table("runs_b")
        joined = left.hint("merge").join(right.select("execution_id", F.col("model").alias("other")), "execution_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 20 and "SortMergeJoin" in plan and "Exchange" not in plan
        grouped = left.groupBy("execution_id").agg(F.max("model").alias("model"))
        assert grouped.count() == 20 and "Exchange" not in plan_of(grouped)
        assert rows_of(left) == rows_of(runs)
        files = [str(path) for path in (tmp_path / "runs_a").glob("*.parquet")]
        assert len(files) == 4
        blooms = duckdb.sql(f"SELECT DISTINCT path_in_schema FROM parquet_metadata({files}) WHERE bloom_filter_offset IS NOT NULL").fetchall()
        assert {name for (name,) in blooms} == {"execution_id", "task_id"}
    finally:
        for name in ("runs_a", "runs_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


STEPS = [
    Step("0.10.0", "seconds", lambda runs: runs.withColumn("seconds", F.col("took") / 1000)),
    migrations.STEPS[0],
    Step("0.3.0", "shorter name", lambda runs: runs.withColumnRenamed("duration_ms", "took")),
]


def test_steps_from_any_version(spark, make_runs, tmp_path):
    new = make_runs({"task_id": "t", "model": "m", "duration_ms": 1500.0})
    old = new.drop("validation_pending", "validation_rubric")
    from_version = {None: old, "0.2.0": new, "0.3.0": new.withColumnRenamed("duration_ms", "took")}
    for at, (version, runs) in enumerate(from_version.items()):
        store = str(tmp_path / str(at))
        done = migrations.upgrade_table(runs, version, store, STEPS, F.lit(DAY))
        assert rows_of(done, "seconds", "took", "validation_pending") == [(1.5, 1500.0, False)]
        assert [row[0] for row in rows_of(migrations.upgrade_history(spark, store))] == ["0.10.0", "0.2.0", "0.3.0"][: 1] + ["0.2.0", "0.3.0"][at:]
    assert migrations.upgrade_table(new, "0.10.0", str(tmp_path / "none"), STEPS) is new
    with pytest.raises(ValueError, match="one version"):
        migrations.pending_steps(None, [*STEPS, STEPS[0]])


def test_a_stopped_upgrade_is_taken_up(spark, make_runs, tmp_path):
    store, calls = str(tmp_path / "store"), []
    runs = make_runs({"task_id": "t", "model": "m", "duration_ms": 1500.0})

    def count(version):
        def apply(table):
            calls.append(version)
            return table.withColumn("steps", F.concat(F.col("steps") if "steps" in table.columns else F.lit(""), F.lit(f"{version} ")))

        return Step(version, "", apply)

    def stop(table):
        table.write.parquet(f"{store}/tables/0.4.0")  # half-way: rows, but no history
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        migrations.upgrade_table(runs, "0.2.0", store, [count("0.3.0"), Step("0.4.0", "", stop), count("0.5.0")])
    steps = [count(version) for version in ("0.3.0", "0.4.0", "0.5.0")]
    done = migrations.upgrade_table(runs, "0.2.0", store, steps)
    assert rows_of(done, "steps") == [("0.3.0 0.4.0 0.5.0 ",)] and calls == ["0.3.0", "0.4.0", "0.5.0"]
    assert rows_of(migrations.upgrade_table(runs, "0.2.0", store, steps), "steps") == rows_of(done, "steps")
