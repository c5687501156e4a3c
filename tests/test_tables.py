from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evalspark.operators import migrations
from evalspark.operators.migrations import CURRENT_VERSION
from evalspark.schemas import SCHEMA_VERSION, TASK_RUNS, TASKS, SchemaError
from evalspark.session import shared_folder
from evalspark.sources import tables
from tests.conftest import DAY, rows_of

def now():
    return F.lit(DAY).cast("timestamp_ntz")


def test_new_store(spark):
    new = tables.empty_tables(spark)
    assert set(new) == {"tasks", "task_runs", "schema_version"}
    assert [new[name].schema.fieldNames() for name in ("tasks", "task_runs")] == [TASKS.fieldNames(), TASK_RUNS.fieldNames()]
    assert all(table.count() == 0 for table in new.values())


def test_version_of_new_old_and_marked_stores(spark, make_runs):
    versions, runs = tables.empty_table(spark, SCHEMA_VERSION), tables.empty_table(spark, TASK_RUNS)
    used = make_runs({"task_id": "t", "model": "m"})
    fresh = tables.initial_version(versions, runs, now())
    assert rows_of(fresh) == [(CURRENT_VERSION, DAY)]
    assert migrations.current_version(tables.initial_version(versions, used, now())) is None
    assert tables.initial_version(fresh, runs, now()).count() == 1
    assert migrations.current_version(None) is None


def test_latest_version_is_the_one_applied_last(spark):
    versions = tables.empty_table(spark, SCHEMA_VERSION)
    for version, day in (("0.3.0", 3), ("0.2.0", 5)):
        moment = F.lit(datetime(2024, 1, day)).cast("timestamp_ntz")
        versions = migrations.record_version(versions, version, moment)
    assert migrations.current_version(versions) == "0.2.0"


def test_pending_upgrades():
    added = {version: {f"new_{at}": "1"} for at, version in enumerate(("0.10.0", "0.2.0", "0.9.0rc1", "0.9.0"))}

    def pending(current, columns=None):
        return migrations.pending_upgrades(current, columns, added)

    assert pending(None) == ["0.2.0", "0.9.0rc1", "0.9.0", "0.10.0"]
    assert pending("0.9.0") == ["0.10.0"] and pending("0.9.0rc1") == ["0.9.0", "0.10.0"]
    assert pending("0.2") == ["0.9.0rc1", "0.9.0", "0.10.0"]
    assert pending("1.0.0") == []
    assert pending("1.0.0", ["new_0", "new_2", "new_3"]) == ["0.2.0"]
    assert migrations.pending_upgrades("0.1.0") == ["0.2.0"]
    assert migrations.pending_upgrades(CURRENT_VERSION) == []


def test_upgrade_of_old_runs(make_runs):
    old = make_runs({"task_id": "t", "model": "m"}).drop("validation_pending", "validation_rubric")
    upgraded = migrations.migrate_runs(old)
    assert rows_of(upgraded, "validation_pending", "validation_rubric") == [(False, None)]
    again = migrations.migrate_runs(upgraded.withColumn("validation_pending", F.lit(True)))
    assert rows_of(again, "validation_pending") == [(True,)]


def test_write_and_read(spark, make_runs, tmp_path):
    runs = make_runs({"task_id": "t", "model": "m"}, {"task_id": "u", "model": "m"})
    path = str(tmp_path / "runs")
    tables.write_table(runs, path, "task_runs")
    assert rows_of(tables.read_table(spark, path, "task_runs")) == rows_of(runs)
    with pytest.raises(Exception, match="(?i)already exists"):
        tables.write_table(runs, path, "task_runs")
    old = str(tmp_path / "old")
    runs.drop("validation_pending", "validation_rubric").write.parquet(old)
    assert tables.read_table(spark, old, "task_runs").columns == TASK_RUNS.fieldNames()
    with pytest.raises(SchemaError):
        tables.read_table(spark, old, "tasks")


def test_sizes_as_text(spark):
    sizes = [0, 1023, 1024, 1280, 1792, 1536, 1048575, 1048576, 5 * 1024 * 1024 + 300000]
    rows = spark.createDataFrame([(s,) for s in sizes], "s bigint")

    def expected(size):
        if size < 1024:
            return f"{size} B"
        return f"{size / 1024:.1f} KB" if size < 1024 * 1024 else f"{size / (1024 * 1024):.1f} MB"

    found = {r.s: r.t for r in rows.select("s", tables.size_text(F.col("s")).alias("t")).collect()}
    assert found == {size: expected(size) for size in sizes}


def test_storage_size(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a").write_bytes(b"x" * 1000)
    (tmp_path / "sub" / "b").write_bytes(b"x" * 536)
    assert rows_of(tables.storage_size(spark, str(tmp_path))) == [(1536, "1.5 KB")]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark, "x").startswith("file:") and shared_folder(spark, "x").endswith("/x")
