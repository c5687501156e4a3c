"""Schema versions and upgrades of the run table."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENT_VERSION = "0.2.0"
UNVERSIONED = "0.1.0"  # what a store without a version row is
#: The columns that each version added to the run table, and what older rows have there.
ADDED = {"0.2.0": {"validation_pending": "false", "validation_rubric": "CAST(NULL AS STRING)"}}


def version_order(version: str) -> tuple:
    """Sorts versions: numbers as numbers, ``0.2`` as ``0.2.0``, a pre-release before its release."""
    release, pre = re.fullmatch(r"v?([0-9]+(?:\.[0-9]+)*)[-._]?((?:a|b|rc)[0-9]*)?.*", version.strip().lower()).groups()
    numbers = [int(part) for part in release.split(".")]
    while numbers and not numbers[-1]:
        del numbers[-1]
    stage, count = re.fullmatch(r"([a-z]*)([0-9]*)", pre or "z").groups()
    return tuple(numbers), stage, int(count or 0)


def pending_upgrades(
    current: str | None, columns: list[str] | None = None, added: dict[str, dict[str, str]] = ADDED
) -> list[str]:
    """The versions, oldest first, that a table has yet to be brought to.

    That are those above its version, and those whose columns it has not.
    """
    at = version_order(current or UNVERSIONED)
    have = set(columns) if columns is not None else None
    wanting = {v for v, new in added.items() if have is not None and not have.issuperset(new)}
    return sorted(wanting | {v for v in added if version_order(v) > at}, key=version_order)


def migrate_runs(runs: DataFrame, current: str | None = None) -> DataFrame:
    """Bring a run table up to date. Columns that are there stay, so repeating it is harmless."""
    for version in pending_upgrades(current, runs.columns):
        runs = add_columns(runs, version)
    return runs


def record_version(versions: DataFrame, version: str, now: Column) -> DataFrame:
    """The version table with one more row."""
    spark = versions.sparkSession
    added = spark.range(1).select(
        F.lit(version).alias("version"), now.cast("timestamp_ntz").alias("applied_at")
    )
    return versions.unionByName(added)


def latest_version(versions: DataFrame) -> DataFrame:
    """(version): one row, the version applied last; NULL when there is none."""
    return versions.agg(F.max_by("version", "applied_at").alias("version"))


def current_version(versions: DataFrame | None) -> str | None:
    """The version applied last; None for a store without a version table or row."""
    return None if versions is None else latest_version(versions).first()["version"]


# -- upgrade steps -----------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """What a version does to a table: new columns, renames, values computed from others, anything."""

    version: str
    description: str
    apply: Callable[[DataFrame], DataFrame]


def adding(version: str) -> Step:
    """The step that adds the columns a version added, where they are missing."""
    return Step(version, f"new columns of {version}", lambda runs: add_columns(runs, version))


def add_columns(runs: DataFrame, version: str) -> DataFrame:
    missing = {name: F.expr(value) for name, value in ADDED[version].items() if name not in runs.columns}
    return runs.withColumns(missing) if missing else runs


STEPS = tuple(adding(version) for version in sorted(ADDED, key=version_order))


def pending_steps(current: str | None, steps: Sequence[Step] = STEPS) -> list[Step]:
    """The steps above a version, oldest first; all of them for a store without a version."""
    at = version_order(current or UNVERSIONED)
    found = sorted((step for step in steps if version_order(step.version) > at), key=lambda step: version_order(step.version))
    if len({version_order(step.version) for step in found}) < len(found):
        raise ValueError("two steps have one version")
    return found


def upgrade_history(spark: SparkSession, store: str) -> DataFrame:
    """(version, applied_at, description): the steps that a store has been through."""
    schema = "version string, applied_at timestamp_ntz, description string"
    try:
        return spark.read.schema(schema).parquet(f"{store}/history/*")
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def upgrade_table(
    runs: DataFrame, current: str | None, store: str, steps: Sequence[Step] = STEPS, now: Column | None = None
) -> DataFrame:
    """Bring a table from a version through all later steps; ``store`` keeps what each one made.

    A step writes its table to a folder of its version and then its row of the history, one file. So
    a job that stopped is taken up by calling this again: finished steps are read, the unfinished
    one is written anew. Without a pending step the table is returned as it is.
    """
    spark, stamp = runs.sparkSession, F.current_timestamp() if now is None else now
    done = {row["version"] for row in upgrade_history(spark, store).select("version").collect()}
    for step in pending_steps(current, steps):
        place = f"{store}/tables/{step.version}"
        if step.version not in done:
            step.apply(runs).write.mode("overwrite").parquet(place)
            row = spark.range(1).select(
                F.lit(step.version).alias("version"), stamp.cast("timestamp_ntz").alias("applied_at"),
                F.lit(step.description).alias("description"),
            )
            row.coalesce(1).write.mode("overwrite").parquet(f"{store}/history/{step.version}")
        runs = spark.read.parquet(place)
    return runs
