"""Evaluation tables derived from the given parquet tables, so that queries have real input.

The given data has no prompts, runs or grades. These views make them out of conversations
(prompts), events (attempts), documents (outputs) and labels (verdicts); every row of those
tables takes part. FIXTURES.md lists the rules, ``conformance/oracle.py`` states them in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.identity import execution_id, with_identity
from evalspark.operators.upsert import reduce_attempts
from evalspark.schemas import TASKS
from evalspark.sources.catalogue import model_catalogue

MODEL_COUNT = 10
TRIED_MODELS = 8  # the others have no runs
STAMP = "2024-06-01 00:00:00"
REGISTERED_AT = "2024-01-01 00:00:00"
RUBRIC = "Is the answer right?"
ATTEMPT_ORDER = ("created_at", "event_id")


# Schemas of the given tables that are used.
GIVEN = {
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def model_name(index: int) -> str:
    return f"prov{index % 3}/org{index % 4}/{'Model_' if index % 2 else 'model-'}{index}"


MODEL_NAMES = [model_name(index) for index in range(MODEL_COUNT)]


def stamp(text: str = STAMP) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(value) for value in values]), index + 1)


class Fixtures:
    """The views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """A given table; stating its schema saves a job that would read it from the files."""
        return self.spark.read.schema(GIVEN[name]).parquet(f"{self.folder}/{name}.parquet")

    # -- tasks ---------------------------------------------------------------------------

    @cached_property
    def conversations(self) -> DataFrame:
        """One row per conversation with its chain and messages. One conversation is one prompt,
        that is, one value of the data model: its turns have to come together."""
        turns = self.table("conversations").groupBy("conv_id").agg(
            F.expr("array_sort(collect_list(struct(turn, role, text)))").alias("turns")
        )
        return turns.selectExpr(
            "conv_id",
            """CASE WHEN conv_id % 2 = 0
                    THEN array(concat('cat_', conv_id % 3), concat('grp_', conv_id % 5), concat('conv_', conv_id))
                    ELSE array(concat('cat_', conv_id % 3), concat('conv_', conv_id)) END AS id_chain""",
            "transform(turns, t -> named_struct('role', t.role, 'content', t.text)) AS messages",
        )

    @cached_property
    def tasks(self) -> DataFrame:
        """Task sources, with ``registered`` (known today) and ``known`` (known at some time):
        conversations that open with a system prompt are not registered, and of these only
        those that end with an answer ever were."""
        tasks = self.conversations.selectExpr(
            "conv_id",
            "concat('/tasks/', array_join(id_chain, '/')) AS path",
            "id_chain",
            "messages",
            "conv_id % 4 <> 3 AS has_validator",
            "messages[0].role <> 'system' AS registered",
            "messages[0].role <> 'system' OR element_at(messages, -1).role = 'assistant' AS known",
        )
        return with_identity(tasks)

    def _as_table(self, tasks: DataFrame) -> DataFrame:
        at = stamp(REGISTERED_AT)
        return tasks.withColumn("created_at", at).withColumn("updated_at", at).select(*TASKS.fieldNames())

    @cached_property
    def registry(self) -> DataFrame:
        """The task table: the registered tasks."""
        return self._as_table(self.tasks.filter("registered"))

    @cached_property
    def old_registry(self) -> DataFrame:
        """The task table before some prompts were deleted."""
        return self._as_table(self.tasks.filter("known"))

    @cached_property
    def models(self) -> DataFrame:
        return model_catalogue(self.spark, [(f"M{at}_OR", name) for at, name in enumerate(MODEL_NAMES)])

    # -- runs ----------------------------------------------------------------------------

    def attempts(self, with_output: bool = True) -> DataFrame:
        """Run records: one per event. Pairs with (conv_id + model) % 6 = 5 are never tried:
        such an event is an attempt of the next model instead."""
        conv_count = self.table("conversations").agg(F.count_distinct("conv_id")).scalar()
        doc_count = self.table("documents").agg(F.count("*")).scalar()
        events = self.table("events").select(
            "event_id",
            "props",
            F.col("ts").alias("created_at"),
            F.expr("event_type = 'error'").alias("failed"),
            F.expr("round(value * 100)").alias("duration_ms"),  # whole numbers: sums are exact
            (F.expr("user_id * 7 + event_id") % conv_count).alias("conv_id"),
            (F.col("event_id") % doc_count).alias("doc_id"),
        )
        names = ", ".join(f"'{name}'" for name in MODEL_NAMES)
        drawn = events.selectExpr("*", f"bigint(get_json_object(props, '$.k')) % {TRIED_MODELS} AS drawn").selectExpr(
            "* EXCEPT (drawn)", f"if((conv_id + drawn) % 6 = 5, (drawn + 1) % {TRIED_MODELS}, drawn) AS tried"
        )
        rows = drawn.join(self.table("labels"), "doc_id", "left").join(
            self.tasks.select("conv_id", "task_id", "messages_hash"), "conv_id"
        )
        output = "CAST(NULL AS STRING)"
        if with_output:
            rows = rows.join(self.table("documents").select("doc_id", "text"), "doc_id")
            output = "if(failed, '', text)"
        kinds = rows.selectExpr(
            "*",
            """CASE WHEN failed THEN 'none' WHEN quality IS NOT NULL THEN 'scored'
                    WHEN doc_id % 3 = 0 THEN 'none' ELSE 'pending' END AS kind""",
        )
        return kinds.selectExpr(
            "event_id",
            "task_id",
            "messages_hash",
            f"array({names})[int(tried)] AS model",
            f"{output} AS output",
            "duration_ms",
            "if(failed, 'API timeout', NULL) AS error",
            "if(kind = 'scored', quality = 1 AND toxic = 0, NULL) AS validation_passed",
            """CASE WHEN kind = 'pending' OR (kind = 'scored' AND quality = 0) THEN 0D
                    WHEN kind = 'scored' THEN if(toxic = 1, 0.5D, 1D) END AS validation_score""",
            "if(kind = 'scored' AND quality = 0, 'low quality', NULL) AS validation_reason",
            "CAST(NULL AS STRING) AS validation_metadata",
            "kind = 'pending' AS validation_pending",
            f"if(kind = 'pending', '{RUBRIC}', NULL) AS validation_rubric",
            """'{"temperature": 0.0}' AS run_config""",
            "created_at",
        )

    def runs(self, with_output: bool = False) -> DataFrame:
        """The run table: what storing the attempts into an empty table gives.

        Outputs are joined to the last attempts only, not to all of them.
        """
        narrow = reduce_attempts(self.attempts(with_output=False), ATTEMPT_ORDER)
        if not with_output:
            return narrow
        doc_count = self.table("documents").agg(F.count("*")).scalar()
        last = self.last_events().select("execution_id", (F.col("event_id") % doc_count).alias("doc_id"))
        texts = last.join(self.table("documents").select("doc_id", "text"), "doc_id").select("execution_id", "text")
        output = F.when(F.col("error").isNotNull(), "").otherwise(F.col("text"))
        return narrow.join(texts, "execution_id").withColumn("output", output).select(*narrow.columns)

    def old_runs(self) -> DataFrame:
        """The run table as it was before manual grading."""
        return self.runs().drop("validation_pending", "validation_rubric", "output")

    def last_events(self) -> DataFrame:
        """(execution_id, event_id): the event of the last attempt of each run."""
        keyed = self.attempts(with_output=False).select(
            execution_id(F.col("task_id"), F.col("model")).alias("execution_id"), *ATTEMPT_ORDER
        )
        return keyed.groupBy("execution_id").agg(F.max_by("event_id", F.struct(*ATTEMPT_ORDER)).alias("event_id"))

    def grades(self) -> DataFrame:
        """A grade file: one token per run, some of them skips or mistakes."""
        event = F.col("event_id")
        token = _pick((event % 6).cast("int"), ["p", "half", "F", "s", " 1 ", "zzz"])
        reason = F.when(event % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" see event "), event.cast("string")))
        return self.last_events().select(
            "execution_id", "event_id", token.alias("token"), reason.alias("reason")
        )

    def judge_scores(self) -> DataFrame:
        """(execution_id, score): a judge's score per run."""
        return self.last_events().select(
            "execution_id", ((F.col("event_id") % 11).cast("double") / F.lit(10.0)).alias("score")
        )

    def requests(self) -> DataFrame:
        """(name): what people typed to choose a model, one per event."""
        key = F.col("event_id")
        model = (key % MODEL_COUNT).cast("int")
        full = _pick(model, MODEL_NAMES)
        short = F.substring_index(full, "/", -1)
        index = model.cast("string")
        names = [
            short,
            F.upper(full),
            F.concat(F.lit("m"), index, F.lit("_or")),
            F.concat(F.lit("M"), index),
            F.lit("model-"),
            F.regexp_replace(full, "/[^/]*$", ""),
            F.concat(F.lit("nope-"), index),
        ]
        return self.table("events").select(
            F.element_at(F.array(*names), (key % len(names)).cast("int") + 1).alias("name")
        )

    @cached_property
    def rules(self) -> DataFrame:
        """A rule table: one rule for every fourth conversation by its whole chain, one per group by a
        segment inside, and one for a category; some tasks have none."""
        own = self.conversations.filter("conv_id % 4 = 0").selectExpr(
            "conv_id AS rule", "array_join(id_chain, '::') AS pattern", "'contains' AS kind",
            "element_at(array('the', 'an', 'of'), int(conv_id % 3) + 1) AS argument", "CAST(NULL AS STRING) AS reason",
        )
        groups = self.conversations.filter("size(id_chain) = 3").selectExpr("id_chain[1] AS name").distinct().selectExpr(
            "1000000000000 + bigint(substring(name, 5)) AS rule", "concat('**::', name, '::**') AS pattern", "'contains' AS kind",
            "'the' AS argument", "'not found' AS reason",
        )
        category = self.conversations.selectExpr("id_chain[0] AS name").distinct().filter("name = 'cat_1'").selectExpr(
            "2000000000000 AS rule", "concat(name, '::conv_*') AS pattern", "'manual' AS kind", f"'{RUBRIC}' AS argument", "CAST(NULL AS STRING) AS reason"
        )
        return own.unionByName(groups).unionByName(category)

    # -- prompt documents ----------------------------------------------------------------

    @cached_property
    def prompts(self) -> DataFrame:
        """(conv_id, directory, text): the conversations written as prompt documents."""
        sections = F.transform(
            "messages",
            lambda m: F.concat(F.lit("# "), F.initcap(m["role"]), F.lit("\n"), m["content"], F.lit("\n\n")),
        )
        head = F.concat(F.lit("---\nid: "), F.element_at("id_chain", -1), F.lit("\n---\n\n"))
        return self.conversations.select(
            "conv_id",
            F.array_join("id_chain", "/").alias("directory"),
            F.concat(head, F.array_join(sections, "")).alias("text"),
        )

    @cached_property
    def bad_prompts(self) -> DataFrame:
        """(conv_id, text, defect): the documents, each broken in one of five ways or left whole."""
        text, defect = F.col("text"), F.col("conv_id") % 6
        broken = (
            F.when(defect == 0, F.concat(text, F.lit("# Tool\nx\n")))
            .when(defect == 1, F.concat(text, F.lit("# User \nx\n")))
            .when(defect == 2, F.regexp_replace(text, r"\A---\nid: [^\n]*", "---\nid: 123"))
            .when(defect == 3, F.regexp_replace(text, r"\A(---\nid: [^\n]*\n)---\n", "$1"))
            .when(defect == 4, F.regexp_replace(text, r"\A---\nid: ", "---\nid: &anchor "))
            .otherwise(text)
        )
        return self.prompts.select("conv_id", broken.alias("text"), defect.alias("defect"))

    def node_documents(self, with_groups: bool = True) -> DataFrame:
        """(directory, text): a whole tree. Containers have only an id, and each leaf has a
        folder below it, which does not count. Without groups, their documents are missing."""
        leaves = self.prompts.select("directory", "text")
        below = leaves.select(
            F.concat("directory", F.lit("/notes")).alias("directory"), F.lit("not read").alias("text")
        )
        chain = F.col("id_chain")
        depths = F.sequence(F.lit(1), F.size(chain) - 1) if with_groups else F.array(F.lit(1))
        containers = (
            self.conversations.select(
                F.explode(F.transform(depths, lambda n: F.slice(chain, F.lit(1), n))).alias("node")
            )
            .distinct()
            .select(
                F.array_join("node", "/").alias("directory"),
                F.concat(F.lit("---\nid: "), F.element_at("node", -1), F.lit("\n---\n")).alias("text"),
            )
        )
        return leaves.union(containers).union(below)
