"""The registered queries: every operator of the library over the fixture views.

Arrays, time stamps and three-valued flags are shown as text, so that both engines give plain
values however they are fetched.
Averages need no rounding: scores and durations are such that their sums are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conformance.fixtures import ATTEMPT_ORDER, MODEL_NAMES, RUBRIC, Fixtures, stamp
from evalspark.functions.globs import matches
from evalspark.functions.identity import chain_text, execution_id, messages_hash, name_or_id, short_model
from evalspark.operators import cleanup, grading, migrations, models, rules, runs, upsert, validators
from evalspark.operators.migrations import migrate_runs
from evalspark.plans import summaries, totals
from evalspark.sources import prompts, tree
from evalspark.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Text that a substring validator looks for, and patterns and filters that the queries use.
EXPECTED = "the"
SINGLE_GLOB = "cat_1::*"
DOUBLE_STAR_GLOB = "cat_0::**::conv_*[02468]"
SEVERAL_GLOBS = ("cat_2::conv_?", "**::grp_[1-3]::*", "cat_[!012]::*")
MODEL_TEXT = "MODEL_"  # the underscore is a wildcard: it also finds "model-"
ODD_IDS = ("a b", "a, b", "c'd", 'say "x"', " a", "a ", "", "null", "x[0]", "k: v", "a=b", "back\\slash", "(p)", "{q}")
GRADE_MODEL_TEXT = "ORG1/model_"  # here it is plain text


def query(build: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    """Register a query under the name of its function."""
    QUERIES[build.__name__] = lambda spark, folder: three_states(build(Fixtures(spark, folder)))
    return build


def three_states(rows: DataFrame) -> DataFrame:
    """``validation_passed`` as text: true, false or NULL."""
    if "validation_passed" not in rows.columns:
        return rows
    return rows.withColumn("validation_passed", F.col("validation_passed").cast("string"))


def time_text(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def chain(name: str = "id_chain") -> Column:
    return chain_text(F.col(name)).alias(name)


# -- identity ----------------------------------------------------------------------------


@query
def messages_hashes(fx: Fixtures) -> DataFrame:
    return fx.conversations.select("conv_id", messages_hash(F.col("messages")).alias("messages_hash"))


@query
def task_ids(fx: Fixtures) -> DataFrame:
    return fx.tasks.select("conv_id", "task_id", "display_name")


@query
def execution_ids(fx: Fixtures) -> DataFrame:
    return runs.planned_executions(fx.tasks, MODEL_NAMES).select("task_id", "model", "execution_id")


# -- tasks -------------------------------------------------------------------------------


@query
def task_list(fx: Fixtures) -> DataFrame:
    return summaries.task_list(fx.tasks).select("chain", "has_validator", "messages")


@query
def task_tree(fx: Fixtures) -> DataFrame:
    return summaries.task_tree(fx.tasks).drop("node")


@query
def glob_single(fx: Fixtures) -> DataFrame:
    return summaries.task_list(fx.tasks, [SINGLE_GLOB]).select("chain")


@query
def glob_double_star(fx: Fixtures) -> DataFrame:
    return fx.tasks.select(
        chain(),
        matches(F.col("id_chain"), DOUBLE_STAR_GLOB).alias("even"),
        matches(F.col("id_chain"), "**").alias("everything"),
        matches(F.col("id_chain"), "**::grp_2::**").alias("in_group"),
    )


@query
def glob_any(fx: Fixtures) -> DataFrame:
    return runs.filter_tasks(fx.tasks, SEVERAL_GLOBS).select("task_id", chain())


@query
def upsert_tasks(fx: Fixtures) -> DataFrame:
    """Tasks registered before meet all tasks of today, which have moved to another folder."""
    moved = fx.tasks.withColumn("path", F.concat(F.lit("/moved"), "path"))
    changed = upsert.upsert_tasks(fx.old_registry, moved, now=stamp())
    return changed.select(
        "task_id", chain(), "display_name", "path", "messages_hash", time_text("created_at"), time_text("updated_at")
    )


# -- prompts and trees -------------------------------------------------------------------


@query
def parse_prompts(fx: Fixtures) -> DataFrame:
    parsed = prompts.parse_prompts(fx.prompts.select("conv_id", "text"))
    return parsed.select("conv_id", "id", F.posexplode("messages").alias("turn", "message")).select(
        "conv_id", "id", F.col("turn").cast("bigint").alias("turn"), "message.role", "message.content"
    )


@query
def parse_errors(fx: Fixtures) -> DataFrame:
    parsed = prompts.parse_prompts(fx.bad_prompts.select("conv_id", "text"))
    return parsed.select("conv_id", "id", "parse_error", F.coalesce(F.size("messages"), F.lit(0)).cast("bigint").alias("messages"))


@query
def discover_tasks(fx: Fixtures) -> DataFrame:
    nodes = prompts.parse_prompts(fx.node_documents())
    marks = fx.tasks.filter("has_validator").select(F.array_join("id_chain", "/").alias("directory"))
    found = tree.build_tasks(nodes, marks, root="/tasks")
    return found.select("path", chain(), "has_validator", "task_id", F.size("messages").alias("messages"))


@query
def tree_problems(fx: Fixtures) -> DataFrame:
    documents = fx.node_documents(with_groups=False)
    files = documents.select(F.concat("directory", F.lit("/description.md")).alias("path"))
    return tree.tree_problems(prompts.parse_prompts(documents), tree.list_directories(files))


# -- what is to be run -------------------------------------------------------------------


@query
def existing_executions(fx: Fixtures) -> DataFrame:
    return runs.existing_executions(fx.runs(), runs.planned_executions(fx.registry, MODEL_NAMES))


@query
def missing_executions(fx: Fixtures) -> DataFrame:
    work = runs.missing_executions(fx.tasks, MODEL_NAMES, fx.runs())
    return work.select(
        "task_id",
        "model",
        "execution_id",
        chain(),
        F.size("messages").alias("messages"),
        F.element_at("messages", -1)["content"].alias("last_message"),
    )


@query
def cache_counts(fx: Fixtures) -> DataFrame:
    return runs.cache_counts(fx.tasks, MODEL_NAMES, fx.runs())


@query
def resolve_models(fx: Fixtures) -> DataFrame:
    resolved = models.resolve_models(fx.requests(), fx.models)
    return resolved.groupBy("name", "model").agg(F.count("*").alias("requests"))


@query
def unresolved_models(fx: Fixtures) -> DataFrame:
    unclear = models.unresolved_models(fx.requests(), fx.models)
    return unclear.select("name", F.array_join("available", ",").alias("available"))


# -- run table ---------------------------------------------------------------------------


@query
def upsert_runs(fx: Fixtures) -> DataFrame:
    """Attempts of January up to the 15th are stored first, the later ones on top of them."""
    attempts = fx.attempts()
    later = F.col("created_at") >= stamp("2024-01-15 00:00:00")
    stored = upsert.reduce_attempts(attempts.filter(~later), ATTEMPT_ORDER, ends_first=True)
    return full_run_rows(upsert.upsert_runs(stored, attempts.filter(later), ATTEMPT_ORDER, ends_first=True))


def full_run_rows(table: DataFrame) -> DataFrame:
    return table.withColumn("created_at", time_text("created_at"))


@query
def migrate_old_runs(fx: Fixtures) -> DataFrame:
    migrated = migrate_runs(fx.old_runs())
    return migrated.select(
        "execution_id", "validation_passed", "validation_score", "validation_pending", "validation_rubric"
    )


@query
def task_runs_by_model_eq(fx: Fixtures) -> DataFrame:
    return full_run_rows(runs.task_runs(fx.runs(with_output=True), model=MODEL_NAMES[3]))


@query
def task_runs_by_task_eq(fx: Fixtures) -> DataFrame:
    """The runs of the task that has the smallest id of all."""
    smallest = fx.tasks.agg(F.min("task_id")).scalar()
    table = fx.runs(with_output=True)
    return full_run_rows(runs.task_runs(table.filter(F.col("task_id") == smallest)))


@query
def model_like(fx: Fixtures) -> DataFrame:
    found = fx.runs().filter(runs.model_like(F.col("model"), MODEL_TEXT))
    return found.groupBy("model").agg(F.count("*").alias("runs"))


# -- summaries ---------------------------------------------------------------------------


@query
def summary_by_model(fx: Fixtures) -> DataFrame:
    return summaries.summary_by_model(fx.runs())


@query
def summary_by_model_filtered(fx: Fixtures) -> DataFrame:
    return summaries.summary_by_model(fx.runs(), fx.registry, [SINGLE_GLOB, "**::grp_0::*"], MODEL_TEXT)


@query
def summary_by_task(fx: Fixtures) -> DataFrame:
    return summaries.summary_by_task(fx.runs(), fx.registry)


@query
def summary_by_task_filtered(fx: Fixtures) -> DataFrame:
    return summaries.summary_by_task(fx.runs(), fx.registry, [DOUBLE_STAR_GLOB], "model-")


def maintained(fx: Fixtures) -> DataFrame:
    """Totals of the attempts up to the 15th, changed by the later ones, then by grades, then by a prune."""
    later = F.col("created_at") >= stamp("2024-01-15 00:00:00")
    attempts = fx.attempts(with_output=False)
    base = upsert.reduce_attempts(attempts.filter(~later), ATTEMPT_ORDER)
    puts = upsert.reduce_attempts(attempts.filter(later), ATTEMPT_ORDER).withColumns({"op": F.lit(changes.PUT), "at": F.lit(1)})
    graded = grading.read_grades(fx.grades()).filter(F.col("outcome") == grading.GRADED)
    grades = graded.selectExpr(
        "execution_id", "score = 1D AS validation_passed", "score AS validation_score", "reason AS validation_reason",
        "FALSE AS validation_pending", f"'{changes.GRADE}' AS op", "2 AS at",
    )
    orphans = cleanup.orphan_task_ids(attempts, fx.registry)
    pruned = attempts.join(orphans, "task_id", "left_semi").select(execution_id(F.col("task_id"), F.col("model")).alias("execution_id")).distinct()
    deletes = pruned.withColumns({"op": F.lit(changes.DELETE), "at": F.lit(3)})
    entries = puts.unionByName(grades, allowMissingColumns=True).unionByName(deletes, allowMissingColumns=True)
    pairs = changes.changed_runs(base, changes.net_changes(entries, totals.READ), totals.READ)
    return totals.merge_totals(totals.run_totals(base), totals.changed_totals(pairs))


@query
def maintained_by_model(fx: Fixtures) -> DataFrame:
    return totals.totals_by_model(maintained(fx))


@query
def maintained_by_task(fx: Fixtures) -> DataFrame:
    return totals.totals_by_task(maintained(fx), fx.registry, [DOUBLE_STAR_GLOB], "model-")


@query
def maintained_counts(fx: Fixtures) -> DataFrame:
    return totals.totals_counts(fx.registry, maintained(fx))


@query
def runs_display(fx: Fixtures) -> DataFrame:
    rows = runs.runs_for_display(fx.runs(), fx.registry)
    return rows.select(
        name_or_id(F.col("display_name"), F.col("task_id"), 8).alias("name"),
        short_model(F.col("model")).alias("model_name"),
        *rows.drop("id_chain").columns,
        chain(),
    )


@query
def runs_display_filtered(fx: Fixtures) -> DataFrame:
    rows = runs.runs_for_display(fx.runs(), fx.registry, SEVERAL_GLOBS, MODEL_TEXT)
    return rows.withColumn("id_chain", chain())


@query
def export_rows(fx: Fixtures) -> DataFrame:
    return full_run_rows(summaries.export_rows(fx.runs(), fx.registry))


@query
def db_stats(fx: Fixtures) -> DataFrame:
    return summaries.store_counts(fx.registry, fx.runs())


@query
def runs_per_model(fx: Fixtures) -> DataFrame:
    return summaries.runs_per_model(fx.runs())


@query
def outcome_tally(fx: Fixtures) -> DataFrame:
    return summaries.outcome_tally(fx.attempts(with_output=False))


# -- grading -----------------------------------------------------------------------------


@query
def pending_grades(fx: Fixtures) -> DataFrame:
    queue = runs.pending_grades(fx.runs(with_output=True), fx.registry)
    return queue.select(
        *[name for name in queue.columns if name not in ("created_at", "id_chain")], time_text("created_at"), chain()
    )


@query
def pending_by_model(fx: Fixtures) -> DataFrame:
    queue = runs.pending_grades(fx.runs(), fx.registry, GRADE_MODEL_TEXT)
    return queue.select("execution_id", "model", "display_name")


@query
def grade_tokens(fx: Fixtures) -> DataFrame:
    return grading.read_grades(fx.grades()).drop("event_id")


@query
def apply_grades(fx: Fixtures) -> DataFrame:
    """Every run may be graded, pending or not."""
    given = grading.read_grades(fx.grades()).filter(F.col("outcome") == grading.GRADED)
    graded = grading.apply_grades(fx.runs(), given, ["event_id"])
    return graded.select(
        "execution_id", "validation_passed", "validation_score", "validation_reason", "validation_pending"
    )


@query
def grading_tally(fx: Fixtures) -> DataFrame:
    queue = runs.pending_grades(fx.runs(), fx.registry, ordered=False)
    return grading.grading_tally(queue, grading.read_grades(fx.grades()))


# -- clean-up ----------------------------------------------------------------------------


@query
def orphan_task_ids(fx: Fixtures) -> DataFrame:
    return cleanup.orphan_task_ids(fx.runs(), fx.registry)


@query
def orphan_report(fx: Fixtures) -> DataFrame:
    return cleanup.orphan_report(fx.runs(), fx.old_registry, fx.registry)


@query
def orphan_totals(fx: Fixtures) -> DataFrame:
    return cleanup.orphan_totals(fx.runs(), fx.registry)


@query
def prune_runs(fx: Fixtures) -> DataFrame:
    return cleanup.prune_runs(fx.runs(), fx.registry).select("execution_id", "task_id", "model")


@query
def prune_tasks(fx: Fixtures) -> DataFrame:
    return cleanup.prune_tasks(fx.old_registry, fx.runs(), fx.registry).select("task_id", "display_name")


@query
def clean_errors(fx: Fixtures) -> DataFrame:
    return cleanup.clean_errors(fx.runs()).select("execution_id", "task_id", "model")


@query
def clean_counts(fx: Fixtures) -> DataFrame:
    return cleanup.clean_counts(fx.runs())


# -- validators --------------------------------------------------------------------------


def validation_rows(checked: DataFrame) -> DataFrame:
    flat = upsert.flatten_validation(checked)
    return flat.select(
        "execution_id",
        "error",
        "validation_passed",
        "validation_score",
        "validation_reason",
        "validation_pending",
        "validation_rubric",
    )


@query
def validate_contains(fx: Fixtures) -> DataFrame:
    outputs = fx.runs(with_output=True).select("execution_id", "task_id", "output", "error")
    rules = [validators.Rule("**", validators.contains(EXPECTED))]
    return validation_rows(validators.validate_outputs(outputs, fx.tasks, rules))


@query
def validate_manual(fx: Fixtures) -> DataFrame:
    """Tasks in groups are checked for a text, all others are left for a person."""
    outputs = fx.runs(with_output=True).select("execution_id", "task_id", "output", "error")
    rules = [
        validators.Rule("*::grp_*::*", validators.contains(EXPECTED, "not found")),
        validators.Rule("**", validators.manual(RUBRIC)),
    ]
    return validation_rows(validators.validate_outputs(outputs, fx.tasks, rules))


@query
def validate_judge(fx: Fixtures) -> DataFrame:
    outputs = fx.runs().select("execution_id", "task_id", "error")
    return validation_rows(validators.judge_outputs(outputs, fx.judge_scores()))


def checked_by_length(output: str) -> dict:
    """A check in Python that passes, leaves to a person, or raises, by the length of a text."""
    if not output:
        return {"score": 0.0, "pending": True, "rubric": RUBRIC}
    if len(output) % 7 == 0:
        raise ValueError(f"bad length {len(output)}")
    return {"passed": len(output) % 2 == 0}


@query
def validate_python(fx: Fixtures) -> DataFrame:
    """Some outputs are NULL, some checks raise, most fields are left to their defaults."""
    outputs = fx.runs(with_output=True).select(
        "execution_id", "task_id", F.when(F.length("output") % 5 != 0, F.col("output")).alias("output"), "error"
    )
    rules = [
        validators.Rule("*::grp_*::*", validators.contains(EXPECTED, "not found")),
        validators.Rule("**", validators.python(checked_by_length)),
    ]
    return validation_rows(validators.validate_outputs(outputs, fx.tasks, rules))


@query
def validate_rule_table(fx: Fixtures) -> DataFrame:
    """Rules that grow with the tasks, as rows."""
    outputs = fx.runs(with_output=True).select("execution_id", "task_id", "output", "error")
    return validation_rows(rules.validate_by_rules(outputs, fx.tasks, fx.rules))


@query
def match_rule_table(fx: Fixtures) -> DataFrame:
    """Every task with every rule whose pattern matches it."""
    return rules.match_patterns(fx.tasks, fx.rules.select("rule", "pattern"))


# -- the store itself --------------------------------------------------------------------


@query
def clean_runs(fx: Fixtures) -> DataFrame:
    return cleanup.clean_runs(fx.runs()).select("execution_id", "task_id", "model")


@query
def schema_versions(fx: Fixtures) -> DataFrame:
    """The version a store is at, before and after another one is recorded."""
    event = F.col("event_id")
    versions = fx.table("events").select(
        F.concat(F.lit("0."), (event % 12).cast("string"), F.lit("."), (event % 5).cast("string")).alias("version"),
        F.timestamp_seconds(1_600_000_000 + event).cast("timestamp_ntz").alias("applied_at"),
    )
    later = migrations.record_version(versions, migrations.CURRENT_VERSION, F.timestamp_seconds(F.lit(4_000_000_000)))
    states = [("before", versions), ("after", later)]
    found = [migrations.latest_version(table).select(F.lit(name).alias("state"), "version") for name, table in states]
    return found[0].unionByName(found[1])


@query
def export_chains(fx: Fixtures) -> DataFrame:
    """Id chains as the export writes them, with ids that need quotes."""
    ids = F.array(*[F.lit(text) for text in ODD_IDS])
    odd = F.get(ids, (F.col("conv_id") % len(ODD_IDS)).cast("int"))
    return fx.tasks.select("conv_id", summaries.list_text(F.concat("id_chain", F.array(odd))).alias("id_chain"))
