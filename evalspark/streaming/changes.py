"""A run store that takes results, grades and deletions as they come: a base table and a log of changes.

Every change is a batch of the log: results put, grades given, or executions deleted. A batch has
a stream and a number in it, and numbers of a stream rise. It is written in three steps: the rows, to a folder
of this try; then a commit of one row, which is one file and so appears whole. What
has no commit is not read. A batch that has its commit, or is behind the pointer, is not written again, so a
replay changes nothing.

Batches count in the order of their commits. The state of an execution follows from the log by one
aggregate: what comes after its last deletion gives the first put (which it keeps its time stamp
and ids from), the last put, and the last grade, if that came after the last put. Grades of an
execution that is not there are void. Any interleaving equals the same steps on tables.

Folding writes the state to a new base and then the pointer: base and position, again one file.
Readers take the last pointer and read the partitions beyond its position; whatever step a job dies after,
they find the old state or the new one. ``drop_folded`` removes what the pointer before the last covers, so
a reader has one folding's time to finish.

``keep_totals`` keeps counts and sums per task and model beside the base, with a pointer of their own; they
change by the old and the new row of every execution that batches touch.

Clocks of the drivers that write to a store have to agree, and one driver folds at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evalspark.operators.cleanup import orphan_task_ids
from evalspark.operators.grading import latest_grades
from evalspark.operators.runs import succeeded
from evalspark.operators.upsert import KEPT, REPLACED, reduce_attempts
from evalspark.plans.totals import READ, TOTALS, changed_totals, merge_totals, run_totals
from evalspark.schemas import TASK_RUNS, conform
from evalspark.sources.tables import empty_table
from evalspark.streaming.ingest import BATCH, STREAM, beyond, start_stream

PUT, GRADE, DELETE = "put", "grade", "delete"
TOTALS_POINTERS = "totals_pointers"
GRADED = ("validation_passed", "validation_score", "validation_reason", "validation_pending")

_BATCH_KEY = [T.StructField(STREAM, T.StringType()), T.StructField(BATCH, T.LongType())]
_TRY = T.StructField("try", T.StringType())
ENTRIES = T.StructType([*TASK_RUNS.fields, T.StructField("op", T.StringType()), *_BATCH_KEY, _TRY])
COMMITS = T.StructType([_TRY, T.StructField("committed", T.TimestampNTZType()), *_BATCH_KEY])
_POINTER = [T.StructField("base", T.StringType()), T.StructField("position", T.MapType(T.StringType(), T.LongType()))]
POINTERS = T.StructType([*_POINTER, T.StructField("fold", T.LongType())])


class Pointer(NamedTuple):
    """The base that readers start from, and the last batch of every stream that is in it."""

    fold: int
    base: str | None
    position: Mapping[str, int]


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A folder of partitions; no rows before the first of them."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_table(spark, schema)


def last_pointer(spark: SparkSession, store: str, kind: str = "pointers") -> Pointer:
    """The pointer written last; before the first one, no base and all batches beyond."""
    rows = _read(spark, f"{store}/{kind}", POINTERS)
    row = rows.agg(F.max_by(F.struct("fold", "base", "position"), "fold").alias("last")).first()["last"]
    return Pointer(row["fold"], row["base"], dict(row["position"] or {})) if row else Pointer(-1, None, {})


def _point(spark: SparkSession, store: str, pointer: Pointer, kind: str = "pointers") -> None:
    row = spark.createDataFrame([(pointer.base, dict(pointer.position))], T.StructType(_POINTER))
    row.coalesce(1).write.mode("overwrite").parquet(f"{store}/{kind}/fold={pointer.fold}")


def begin_store(runs: DataFrame, store: str) -> None:
    """Make a store of a run table; a store may also begin with no more than its first batch."""
    spark = runs.sparkSession
    if last_pointer(spark, store).fold >= 0:
        raise ValueError(f"{store} has a base already")
    base = uuid.uuid4().hex
    conform(runs, TASK_RUNS).write.parquet(f"{store}/bases/{base}")
    _point(spark, store, Pointer(0, base, {}))


# -- writing -----------------------------------------------------------------------------


def is_committed(spark: SparkSession, store: str, stream: str, batch_id: int) -> bool:
    if batch_id <= last_pointer(spark, store).position.get(stream, -1):
        return True
    same = (F.col(STREAM) == stream) & (F.col(BATCH) == batch_id)
    return not _read(spark, f"{store}/commits", COMMITS).filter(same).isEmpty()


def _append(changes: DataFrame, op: str, store: str, stream: str, batch_id: int) -> None:
    """Write the rows of a batch, then its commit. The caller has seen that it has none."""
    spark, attempt, place = changes.sparkSession, uuid.uuid4().hex, f"{STREAM}={stream}/{BATCH}={batch_id}"
    rows = changes.select(
        *[
            F.col(field.name) if field.name in changes.columns else F.lit(None).cast(field.dataType).alias(field.name)
            for field in TASK_RUNS.fields
        ],
        F.lit(op).alias("op"),
    )
    rows.write.parquet(f"{store}/entries/{place}/try={attempt}")
    commit = spark.range(1).select(F.lit(attempt).alias("try"), F.current_timestamp().cast("timestamp_ntz").alias("committed"))
    commit.coalesce(1).write.mode("overwrite").parquet(f"{store}/commits/{place}")


def put_runs(attempts: DataFrame, order_by: Sequence[str | Column], store: str, stream: str, batch_id: int) -> None:
    """Add attempts: a repeated execution replaces its result and keeps its first time stamp."""
    if not is_committed(attempts.sparkSession, store, stream, batch_id):
        _append(reduce_attempts(attempts, order_by), PUT, store, stream, batch_id)


def put_grades(
    grades: DataFrame, order_by: Sequence[str | Column], store: str, stream: str, batch_id: int, strict: bool = False
) -> None:
    """Add grades (execution_id, score, reason), as ``apply_grades`` takes them."""
    if is_committed(grades.sparkSession, store, stream, batch_id):
        return
    latest = latest_grades(grades, order_by, strict).filter("_key IS NOT NULL")
    values = latest.select(
        F.col("_key").alias("execution_id"),
        (F.col("_grade.score") == 1.0).alias("validation_passed"),
        F.col("_grade.score").alias("validation_score"),
        F.col("_grade.reason").alias("validation_reason"),
        F.lit(False).alias("validation_pending"),
    )
    _append(values, GRADE, store, stream, batch_id)


def delete_runs(executions: DataFrame, store: str, stream: str, batch_id: int) -> None:
    """Delete the executions of the given ids; a later put brings an execution back as a new one."""
    if not is_committed(executions.sparkSession, store, stream, batch_id):
        ids = executions.select("execution_id").filter("execution_id IS NOT NULL").distinct()
        _append(ids, DELETE, store, stream, batch_id)


def prune_store(current: DataFrame, store: str, stream: str, batch_id: int) -> None:
    """Delete the runs of tasks that are not among the current ones."""
    state = store_runs(current.sparkSession, store, ["task_id"])
    orphans = orphan_task_ids(state, current)
    delete_runs(state.join(orphans, "task_id", "left_semi"), store, stream, batch_id)


def clean_store(spark: SparkSession, store: str, stream: str, batch_id: int, only_errors: bool = False) -> None:
    """Delete all runs there are now, or the failed ones."""
    state = store_runs(spark, store, ["error"] if only_errors else [])
    delete_runs(state.filter(~succeeded()) if only_errors else state, store, stream, batch_id)


def ingest_changes(
    attempts: DataFrame,
    store: str,
    order_by: Sequence[str | Column],
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start putting a stream of attempts into a store, a batch of the log for each micro-batch."""

    def put(batch: DataFrame, batch_id: int, stream: str) -> None:
        put_runs(batch, order_by, store, stream, batch_id)

    return start_stream(attempts, put, store, checkpoint, available_now)


# -- reading -----------------------------------------------------------------------------


def store_position(spark: SparkSession, store: str) -> dict[str, int]:
    """The last committed batch of every stream."""
    pointer = last_pointer(spark, store)
    rows = _read(spark, f"{store}/commits", COMMITS).groupBy(STREAM).agg(F.max(BATCH).alias(BATCH)).collect()
    found = {row[STREAM]: row[BATCH] for row in rows}
    return {stream: max(found.get(stream, -1), pointer.position.get(stream, -1)) for stream in {*found, *pointer.position}}


def committed_entries(
    spark: SparkSession, store: str, after: Mapping[str, int], through: Mapping[str, int] | None = None
) -> DataFrame:
    """The rows of committed batches between two positions, with ``at``, their place in the order.

    The bounds are on partition columns, so other batches are not opened.
    """
    def between(rows: DataFrame) -> DataFrame:
        rows = rows.filter(beyond(after))
        return rows if through is None else rows.filter(~beyond(through))

    commits = between(_read(spark, f"{store}/commits", COMMITS))
    entries = between(_read(spark, f"{store}/entries", ENTRIES))
    order = F.struct("committed", STREAM, BATCH).alias("at")
    return entries.join(commits, [STREAM, BATCH, "try"]).select(*TASK_RUNS.fieldNames(), "op", order)


def net_changes(entries: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per execution: _key, deleted, put, graded, and what the first and last put and the grade say.

    Deletions are brought to one row per execution before they are joined. A batch has at most one row
    of an execution, so none has more rows than there are batches since the last folding.
    """
    last_delete = entries.filter(F.col("op") == DELETE).groupBy(F.col("execution_id").alias("_key"))
    marked = entries.join(last_delete.agg(F.max("at").alias("deleted_at")), F.col("execution_id") == F.col("_key"), "left")
    counts = F.col("deleted_at").isNull() | (F.col("at") > F.col("deleted_at"))
    put_at, grade_at = (F.when(counts & (F.col("op") == op), F.col("at")) for op in (PUT, GRADE))

    def pick(take, names: Sequence[str], order: Column, name: str) -> list[Column]:
        wanted = [column for column in names if column in columns]
        return [take(F.struct(*wanted), order).alias(name)] if wanted else []

    rest = [name for name in REPLACED if name != "output"]
    net = marked.groupBy(F.col("execution_id").alias("_id")).agg(
        F.max("deleted_at").isNotNull().alias("deleted"),
        F.max(put_at).alias("put_at"),
        F.max(grade_at).alias("grade_at"),
        *pick(F.min_by, KEPT, put_at, "first"),
        *pick(F.max_by, rest, put_at, "last"),
        *pick(F.max_by, ["output"], put_at, "text"),  # an aggregate of its own: reports do without it
        *pick(F.max_by, GRADED, grade_at, "grade"),
    )
    graded = F.col("grade_at").isNotNull() & (F.col("put_at").isNull() | (F.col("grade_at") > F.col("put_at")))
    return net.withColumnsRenamed({"_id": "_key"}).withColumns(
        {"put": F.col("put_at").isNotNull(), "graded": graded}
    ).drop("put_at", "grade_at")


def _after(name: str, old: Column) -> Column:
    """The value of a column after the net change of its row; ``execution_id`` is NULL where there was none."""
    changed, put, graded = (F.coalesce(flag, F.lit(False)) for flag in ("deleted", "put", "graded"))
    if name in KEPT:
        return F.when(put & (changed | F.col("execution_id").isNull()), F.col(f"first.{name}")).otherwise(old)
    new = F.when(put, F.col(f"{'text' if name == 'output' else 'last'}.{name}"))
    if name in GRADED:
        new = F.when(graded, F.col(f"grade.{name}")).when(put, F.col(f"last.{name}"))
    return new.otherwise(old)


def apply_changes(base: DataFrame, net: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The base after the net changes; ``columns`` (besides the key) are those that both have.

    As in an upsert, the changes stand on the right of two joins with the base, so few changes do
    not move it.
    """
    changed, put = (F.coalesce(flag, F.lit(False)) for flag in ("deleted", "put"))
    joined = base.join(net, F.col("execution_id") == F.col("_key"), "left").filter(~changed | put)
    kept = joined.select("execution_id", *[_after(name, F.col(name)).alias(name) for name in columns])
    known = base.select("execution_id").join(net.select(F.col("_key").alias("execution_id")), "execution_id", "left_semi")
    new = net.filter("put").join(known, F.col("_key") == F.col("execution_id"), "left_anti")
    new = new.withColumn("execution_id", F.lit(None).cast("string"))
    nothing = {name: F.lit(None).cast(base.schema[name].dataType) for name in columns}
    added = new.select(F.col("_key").alias("execution_id"), *[_after(name, nothing[name]).alias(name) for name in columns])
    return kept.unionByName(added)


def changed_runs(base: DataFrame, net: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(old, new) of every execution that net changes touch, as structs of ``columns``, NULL where there is none.

    A semi join leaves the touched executions of the base, and only these meet the changes in the full join.
    """
    keys = net.select(F.col("_key").alias("execution_id"))
    touched = base.select("execution_id", *columns).join(keys, "execution_id", "left_semi")
    there, put = F.col("execution_id").isNotNull(), F.coalesce("put", F.lit(False))
    stays = put | (there & ~F.coalesce("deleted", F.lit(False)))
    return touched.join(net, F.col("execution_id") == F.col("_key"), "full").select(
        F.when(there, F.struct(*columns)).alias("old"),
        F.when(stays, F.struct(*[_after(name, F.col(name)).alias(name) for name in columns])).alias("new"),
    )


def store_runs(
    spark: SparkSession,
    store: str,
    columns: Sequence[str] | None = None,
    through: Mapping[str, int] | None = None,
) -> DataFrame:
    """The run table as of now, or through a position; ``columns`` narrows what is read, besides the key."""
    wanted = [name for name in TASK_RUNS.fieldNames() if name != "execution_id" and (columns is None or name in columns)]
    pointer = last_pointer(spark, store)
    base = spark.read.parquet(f"{store}/bases/{pointer.base}") if pointer.base else empty_table(spark, TASK_RUNS)
    net = net_changes(committed_entries(spark, store, pointer.position, through), wanted)
    return apply_changes(base.select("execution_id", *wanted), net, wanted)


# -- totals ------------------------------------------------------------------------------


def _beyond_totals(spark: SparkSession, store: str, at: Pointer, through: Mapping[str, int] | None) -> DataFrame:
    """What batches beyond the totals' position add to them."""
    net = net_changes(committed_entries(spark, store, at.position, through), READ)
    return changed_totals(changed_runs(store_runs(spark, store, READ, at.position), net, READ))


def store_totals(spark: SparkSession, store: str, current: bool = True) -> DataFrame:
    """Totals per task and model, for the reports of ``plans/totals.py``.

    If no batch came since they were last kept, only the kept totals are read. Otherwise, what came is
    added to them, or with ``current=False`` left out.
    """
    at = last_pointer(spark, store, TOTALS_POINTERS)
    if at.base is None:
        return run_totals(store_runs(spark, store, READ))
    kept = spark.read.schema(TOTALS).parquet(f"{store}/totals/{at.base}")
    if not current or store_position(spark, store) == at.position:
        return kept
    return merge_totals(kept, _beyond_totals(spark, store, at, None))


def keep_totals(spark: SparkSession, store: str) -> Pointer:
    """Bring the kept totals to the last committed batch: write them anew, then point to them.

    The first call makes them from all runs, later ones from the old and new rows of what has changed.
    From then on every folding keeps them as well, so the base is never ahead of them.
    """
    at, position = last_pointer(spark, store, TOTALS_POINTERS), store_position(spark, store)
    if at.base is not None and position == at.position:
        return at
    if at.base is None:
        totals = run_totals(store_runs(spark, store, READ, position))
    else:
        kept = spark.read.schema(TOTALS).parquet(f"{store}/totals/{at.base}")
        totals = merge_totals(kept, _beyond_totals(spark, store, at, position))
    name = uuid.uuid4().hex
    totals.write.parquet(f"{store}/totals/{name}")
    pointer = Pointer(at.fold + 1, name, position)
    _point(spark, store, pointer, TOTALS_POINTERS)
    return pointer


# -- folding -----------------------------------------------------------------------------


def fold_store(spark: SparkSession, store: str) -> Pointer:
    """Write the state as the new base, then point to it; nothing is done if nothing has come."""
    pointer, position = last_pointer(spark, store), store_position(spark, store)
    if position == pointer.position:
        return pointer
    if last_pointer(spark, store, TOTALS_POINTERS).base is not None:
        keep_totals(spark, store)  # first: their next change starts from rows that the base must not be ahead of
    base = uuid.uuid4().hex
    store_runs(spark, store, through=position).write.parquet(f"{store}/bases/{base}")
    folded = Pointer(pointer.fold + 1, base, position)
    _point(spark, store, folded)
    return folded


def drop_folded(spark: SparkSession, store: str) -> int:
    """Remove batches that the pointer before the last covers, and bases that none of the two names.

    Totals that the last two of their pointers do not name go too. Returns how many folders went. Entries go before their commits, so a stop half-way leaves commits
    without rows that are behind the pointer. Only names of folders are listed. A folding must not run meanwhile.
    """
    last, kept = last_pointer(spark, store), last_pointer(spark, store, TOTALS_POINTERS)
    rows = _read(spark, f"{store}/pointers", POINTERS).filter(F.col("fold") == last.fold - 1).collect()
    if not rows:
        return 0
    before = Pointer(rows[0]["fold"], rows[0]["base"], dict(rows[0]["position"] or {}))
    named = {row["base"] for row in _read(spark, f"{store}/{TOTALS_POINTERS}", POINTERS).filter(F.col("fold") >= kept.fold - 1).collect()}
    files, root = fs.FileSystem.from_uri(store) if "://" in store or store.startswith("file:") else (fs.LocalFileSystem(), store)

    def folders(path: str) -> list[str]:
        return [info.path for info in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if info.type == fs.FileType.Directory]

    gone = [path for path in folders(f"{root}/bases") if path.rsplit("/", 1)[-1] not in (before.base, last.base)]
    gone += [path for path in folders(f"{root}/totals") if path.rsplit("/", 1)[-1] not in named]
    for kind in ("entries", "commits"):
        for stream in folders(f"{root}/{kind}"):
            bound = before.position.get(stream.rsplit(f"{STREAM}=", 1)[-1], -1)
            gone += [path for path in folders(stream) if int(path.rsplit(f"{BATCH}=", 1)[-1]) <= bound]
    for path in gone:
        files.delete_dir(path)
    return len(gone)
