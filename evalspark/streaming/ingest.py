"""Taking in run records as they arrive.

Each micro-batch is reduced to one row per execution and written to its own partition of a
log, named by the stream and the number of the batch in it. A batch that is replayed after a
failure overwrites its own partition, so nothing is counted twice; another stream, or a stream
with a new checkpoint, has another id and other partitions. The cost of a batch depends on the
batch, not on the table. Reading folds the log into the base table; now and then the fold is
written out as a new base.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evalspark.operators.upsert import KEPT, REPLACED, merge_runs, reduce_attempts
from evalspark.schemas import TASK_RUNS
from evalspark.session import shared_folder

STREAM, BATCH, ARRIVED = "stream", "batch_id", "arrived"
#: The id that Spark gives a stream and keeps in its checkpoint.
QUERY_ID = "sql.streaming.queryId"


def attempt_schema(*order: T.StructField) -> T.StructType:
    """The schema of incoming records: the run columns without the key, and the order columns."""
    fields = [field for field in TASK_RUNS.fields if field.name != "execution_id"]
    return T.StructType([*fields, *order])


def read_attempts(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    file_format: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    """A stream over the record files that appear in a folder."""
    reader = spark.readStream.format(file_format).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def write_batch(
    attempts: DataFrame, batch_id: int, log: str, order_by: Sequence[str | Column], stream: str = "single"
) -> None:
    """Write one reduced micro-batch to its partition of the log, replacing an earlier try.

    A replay keeps the time of arrival, and with it the order among all batches.
    """
    place = f"{log}/{STREAM}={stream}/{BATCH}={batch_id}"
    try:
        stored = attempts.sparkSession.read.schema(f"{ARRIVED} timestamp_ntz").parquet(place)
        arrived = stored.agg(F.min(ARRIVED)).first()[0]
    except AnalysisException:  # no earlier try
        arrived = None
    time = F.lit(arrived) if arrived else F.current_timestamp()
    reduced = reduce_attempts(attempts, order_by).withColumn(ARRIVED, time.cast("timestamp_ntz"))
    reduced.write.mode("overwrite").parquet(place)


def ingest_runs(
    attempts: DataFrame,
    log: str,
    order_by: Sequence[str | Column],
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start taking in a stream of attempts.

    Without ``checkpoint`` the progress is kept below the cluster's shared checkpoint folder.
    """

    def store(batch: DataFrame, batch_id: int, stream: str) -> None:
        write_batch(batch, batch_id, log, order_by, stream)

    return start_stream(attempts, store, log, checkpoint, available_now)


def start_stream(
    attempts: DataFrame,
    take: Callable[[DataFrame, int, str], None],
    log: str,
    checkpoint: str | None,
    available_now: bool,
) -> StreamingQuery:
    """Start a stream whose batches ``take`` gets with their number and the stream's id."""
    name = hashlib.sha256(log.rstrip("/").encode()).hexdigest()[:32]
    location = checkpoint or shared_folder(attempts.sparkSession, f"ingest/{name}")

    def store(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID)
        if not stream:
            raise RuntimeError("the stream's id is not known, so its batches cannot be told from others")
        take(batch, batch_id, stream)

    writer = attempts.writeStream.foreachBatch(store).option("checkpointLocation", location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


Position = int | Mapping[str, int]


def beyond(position: Position) -> Column:
    """Batches after a position: a number for all streams, or one per stream (others are beyond)."""
    if isinstance(position, int):
        return F.col(BATCH) > position
    beyond = F.lit(True)
    for stream, batch_id in position.items():
        beyond = F.when(F.col(STREAM) == stream, F.col(BATCH) > batch_id).otherwise(beyond)
    return beyond


def log_position(spark: SparkSession, log: str) -> dict[str, int]:
    """The last batch of every stream in a log, to fold up to and to go on from."""
    rows = _log_rows(spark, log).groupBy(STREAM).agg(F.max(BATCH).alias(BATCH)).collect()
    return {row[STREAM]: row[BATCH] for row in rows}


def _log_rows(spark: SparkSession, log: str) -> DataFrame:
    parts = [T.StructField(ARRIVED, T.TimestampNTZType()), T.StructField(STREAM, T.StringType()), T.StructField(BATCH, T.LongType())]
    schema = T.StructType([*TASK_RUNS.fields, *parts])
    try:
        return spark.read.schema(schema).parquet(log)
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # no batch has come yet


def read_log(
    spark: SparkSession,
    log: str,
    after: Position | None = None,
    through: Position | None = None,
    columns: Sequence[str] | None = None,
    tasks: Sequence[str] | None = None,
    models: Sequence[str] | None = None,
) -> DataFrame:
    """The log, one row per execution: the last batch has the values, the first the time stamp.

    The last is that which arrived last. ``after`` and ``through`` bound the batches; other
    partitions are not read. ``columns`` narrows the result, ``tasks`` and ``models`` keep those
    ids and names; both reach the files. The output is an aggregate of its own, so a report on the
    log does not read it.
    """
    rows = _log_rows(spark, log)
    if after is not None:
        rows = rows.filter(beyond(after))
    if through is not None:
        rows = rows.filter(~beyond(through))
    rows = _of(rows, tasks, models)
    wanted = TASK_RUNS.fieldNames() if columns is None else ["execution_id", *[n for n in columns if n != "execution_id"]]
    order = F.struct(ARRIVED, BATCH, STREAM)
    last = [name for name in REPLACED if name in wanted and name != "output"]
    first = [name for name in KEPT if name in wanted]
    values = [F.min_by(F.struct(*first), order).alias("first")] if first else []
    values += [F.max_by(F.struct(*last), order).alias("last")] if last else []
    values += [F.max_by("output", order).alias("output")] if "output" in wanted else []
    reduced = rows.groupBy("execution_id").agg(*(values or [F.count("*").alias("_n")]))
    spread = [name for name, have in (("first.*", first), ("last.*", last), ("output", "output" in wanted)) if have]
    return reduced.select("execution_id", *spread).select(*wanted)


def _of(rows: DataFrame, tasks: Sequence[str] | None, models: Sequence[str] | None) -> DataFrame:
    for name, values in (("task_id", tasks), ("model", models)):
        if values is not None:
            rows = rows.filter(F.col(name).isin(list(values)))
    return rows


def current_runs(
    base: DataFrame,
    log: str,
    after: Position | None = None,
    through: Position | None = None,
    columns: Sequence[str] | None = None,
    tasks: Sequence[str] | None = None,
    models: Sequence[str] | None = None,
) -> DataFrame:
    """The run table as of now: the base with the log on top of it.

    To keep the log short, write ``current_runs(base, log, after, through=n)`` to a fresh path
    from time to time; it is the new base for ``after=n``, and older batches can be dropped.
    ``n`` is what ``log_position`` says, or a number for a log of one stream. Task and model are
    parts of the key, so filters on them hold for base and log alike.
    """
    narrow = read_log(base.sparkSession, log, after, through, columns, tasks, models)
    return merge_runs(_of(base, tasks, models), narrow, columns)
