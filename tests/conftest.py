from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from evalspark.functions.identity import with_identity  # noqa: E402
from evalspark.operators.upsert import upsert_runs, upsert_tasks  # noqa: E402
from evalspark.schemas import MESSAGES, TASK_RUNS, TASKS  # noqa: E402
from evalspark.session import local_session  # noqa: E402
from evalspark.sources.tables import empty_table  # noqa: E402

MESSAGE_PAIR = [("system", "You are a helpful assistant."), ("user", "Hello, world!")]
DAY = datetime(2024, 5, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoint")
    session = local_session(4, 4, **{"spark.checkpoint.dir": f"file://{folder}"})
    session.sparkContext.setCheckpointDir(f"file://{folder}")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_tasks(spark):
    """Task sources from (path, id chain, messages) or (path, id chain, messages, has_validator)."""

    def make(*tasks):
        rows = [(*task, False) if len(task) == 3 else task for task in tasks]
        schema = "path string, id_chain array<string>, messages " + MESSAGES.simpleString()
        return with_identity(spark.createDataFrame(rows, schema + ", has_validator boolean"))

    return make


@pytest.fixture(scope="session")
def make_attempts(spark):
    """Attempts from dictionaries; whatever is not given is NULL or a plain default."""
    defaults = {
        "messages_hash": "hash",
        "output": "output",
        "duration_ms": 100.0,
        "validation_pending": False,
        "created_at": DAY,
        "at": 0,
    }
    names = [name for name in TASK_RUNS.fieldNames() if name != "execution_id"]
    fields = ", ".join(f"{name} {TASK_RUNS[name].dataType.simpleString()}" for name in names)

    def make(*attempts):
        rows = [
            tuple({**defaults, **attempt}.get(name) for name in [*names, "at"]) for attempt in attempts
        ]
        return spark.createDataFrame(rows, f"{fields}, at int")

    return make


@pytest.fixture(scope="session")
def make_runs(spark, make_attempts):
    def make(*attempts):
        return upsert_runs(empty_table(spark, TASK_RUNS), make_attempts(*attempts), ["at"])

    return make


@pytest.fixture(scope="session")
def register(spark):
    def make(tasks):
        return upsert_tasks(empty_table(spark, TASKS), tasks)

    return make


def rows_of(df, *columns):
    """The rows as a sorted list of tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in chosen.collect()), key=repr)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()

