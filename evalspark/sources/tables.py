"""Reading, writing and exporting the tables.

Tables are plain parquet folders. A changed table is a new DataFrame and goes to a fresh path
(Spark cannot overwrite what it is reading); swapping paths is left to the caller's catalogue.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators.migrations import CURRENT_VERSION, migrate_runs
from evalspark.schemas import SCHEMA_VERSION, TASK_RUNS, TASKS, conform

TABLES = {"tasks": TASKS, "task_runs": TASK_RUNS, "schema_version": SCHEMA_VERSION}


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows of a schema, in a form that Catalyst sees is empty and takes out of a plan."""
    nothing = [F.lit(None).cast(field.dataType).alias(field.name) for field in schema.fields]
    return spark.range(1).select(*nothing).filter(F.lit(False))


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables of a new store; its version row is added by ``initial_version``."""
    return {name: empty_table(spark, schema) for name, schema in TABLES.items()}


def initial_version(versions: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Mark a store as current when it has no version and no runs yet.

    Runs without a version belong to a store from before versioning: they stay unmarked, so
    that the upgrade is offered.
    """
    unmarked = versions.agg(F.count("*").alias("versions"))
    unused = runs.agg(F.count("*")).scalar()
    fresh = unmarked.filter((F.col("versions") == 0) & (unused == 0)).select(
        F.lit(CURRENT_VERSION).alias("version"), now.cast("timestamp_ntz").alias("applied_at")
    )
    return versions.unionByName(fresh)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read a table and check its columns; runs written before the last upgrade are upgraded."""
    table = spark.read.parquet(path)
    if name == "task_runs":
        table = migrate_runs(table)
    return conform(table, TABLES[name])


def write_table(table: DataFrame, path: str, name: str) -> None:
    """Write a table to a path that does not exist yet."""
    conform(table, TABLES[name]).write.mode("errorifexists").parquet(path)


def write_run_buckets(runs: DataFrame, name: str, path: str, buckets: int) -> None:
    """Save runs as the table ``name`` of the session's catalogue, in buckets of ``execution_id``.

    Joins and aggregates on ``execution_id`` with another table in as many buckets, and the
    aggregates of an upsert, then move no rows. Buckets are sorted by task, and files have
    Bloom filters on both ids, so a look-up by one of them skips row groups. A bucket is one file:
    choose their number so that one fits a task, and equal for the tables that are joined.
    """
    writer = conform(runs, TASK_RUNS).repartition(buckets, "execution_id").write.mode("errorifexists")
    for key in ("execution_id", "task_id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.bucketBy(buckets, "execution_id").sortBy("task_id").option("path", path).format("parquet").saveAsTable(name)


def write_csv(rows: DataFrame, path: str) -> None:
    """Write rows as CSV with a header; quotes are doubled, NULL is empty, ``''`` is quoted.

    Time stamps are written as their SQL text, that is, without trailing zeros. One file per
    partition, in the order of the rows.
    """
    plain = rows.select(
        *[
            F.col(field.name).cast("string").alias(field.name)
            if isinstance(field.dataType, T.TimestampNTZType)
            else F.col(field.name)
            for field in rows.schema.fields
        ]
    )
    plain.write.mode("errorifexists").csv(
        path, header=True, sep=",", quote='"', escape='"', emptyValue='""', nullValue=""
    )


def double_text(value: Column) -> Column:
    """A double in plain digits from 0.0001 up to 1e16, else as ``1.5e-05``; always with a point or exponent."""
    text, size = value.cast("string"), F.abs(value)
    digits = F.regexp_replace(value.cast("string").cast("decimal(38,20)").cast("string"), r"0+\z", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.regexp_extract(text, r"\A([^E]*)E", 1), r"\.0\z", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)\z", 1)
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    number = F.regexp_replace(power, "-", "")
    short = F.concat(mantissa, F.lit("e"), sign, F.lpad(number, F.greatest(F.lit(2), F.length(number)), F.lit("0")))
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((text == "0.0") | (text == "-0.0"), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(short)
    )


def _csv_field(value: Column, kind: T.DataType) -> Column:
    """A value as it stands in the file: NULL is nothing, ``''`` is quoted, and what could be misread."""
    text = double_text(value) if isinstance(kind, T.DoubleType) else value.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike(r'\A\z|[,"\r\n#]'), quoted).otherwise(text), F.lit(""))


def write_one_csv(rows: DataFrame, path: str, order_by: Sequence[Column]) -> None:
    """Write rows as one CSV file in parts: put together in the order of their names, they are the file.

    Keys sort upwards, NULLs last. The header is a row of its own that sorts before all others, so it opens the first part; the
    sort deals the rest out by ranges, and no part is large. Rows that tie in ``order_by`` stand in any order.
    """
    names = [F.lit(name) for name in rows.columns]
    line = lambda columns: F.concat_ws(",", *columns)
    values = [_csv_field(F.col(field.name), field.dataType) for field in rows.schema.fields]
    keys = [f"_key{at}" for at in range(len(order_by))]
    body = rows.select(F.lit(1).alias("_body"), line(values).alias("value"), *[key.alias(name) for key, name in zip(order_by, keys, strict=True)])
    head = rows.sparkSession.range(1).select(
        F.lit(0).alias("_body"), line([_csv_field(name, T.StringType()) for name in names]).alias("value"),
        *[F.lit(None).cast(body.schema[name].dataType).alias(name) for name in keys],
    )
    lines = head.unionByName(body).orderBy("_body", *[F.asc_nulls_last(name) for name in keys])
    lines.select("value").write.mode("errorifexists").text(path)


def size_text(size: Column) -> Column:
    """A size as text in B, KB or MB; halves go to the even digit."""
    kilo, mega = 1024.0, 1024.0 * 1024.0

    def scaled(unit: float, name: str) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(size / F.lit(unit), 1)), F.lit(f" {name}"))

    return (
        F.when(size < kilo, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mega, scaled(kilo, "KB"))
        .otherwise(scaled(mega, "MB"))
    )


def storage_size(spark: SparkSession, path: str) -> DataFrame:
    """(size_bytes, size): the bytes below a path. Lengths only, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))
    return total.withColumn("size", size_text(F.col("size_bytes")))
