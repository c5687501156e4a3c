"""Rules and patterns as data: tables of globs that are matched by joins.

``validators`` and ``globs`` take patterns that a user typed; each becomes a branch of an expression.
Where every task has a rule of its own, patterns grow with the tasks, so here they are rows. A
pattern is filed under a part of it that has no wildcard, its anchor, and a task is looked up under
all the anchors it could have:

* ``whole``: the pattern has no wildcard and equals the text of the chain;
* ``head``: the segments before the first wildcard, a path from the root of the trie of segments;
* ``tail``: in a pattern with ``**``, the segments after the last wildcard;
* ``inner``: in a pattern with ``**`` and neither, its longest segment without a wildcard;
* ``free``: nothing to go by, so every task is tried.

Both sides meet in one equi-join on (kind, anchor), so a task is tried with the patterns that share an
anchor, and what meets is decided by the pattern's regular expression. The plan is the same for ten
rules and for ten million. Anchors other than whole chains are spread over ``SPREAD`` salts, as a
category may hold a third of all tasks: a pattern is repeated, a task is not.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.columns import bind, compute_once
from evalspark.functions.globs import ANY_DEPTH, segment_regex, whole_text_regex
from evalspark.functions.identity import chain_text
from evalspark.operators.validators import OUTCOME, _run_checks, outcome
from evalspark.schemas import CHAIN_SEPARATOR

#: A rule table: ``rule`` is its rank (the smallest that matches counts), ``kind`` one of those below,
#: ``argument`` the expected text, the rubric or the name of a check, ``reason`` that of a failure.
RULES = "rule bigint, pattern string, kind string, argument string, reason string"
CONTAINS, MANUAL, PYTHON = "contains", "manual", "python"

WHOLE, HEAD, TAIL, INNER, FREE = "whole", "head", "tail", "inner", "free"
SPREAD = 16
_WILD = frozenset("*?[")
ANCHOR = T.StructType([T.StructField(name, T.StringType()) for name in ("anchor_kind", "anchor", "form", "regex")])


def anchor_of(pattern: str) -> tuple[str, str, str, str]:
    """(anchor kind, anchor, form, regex); the form says what the regex is matched against."""
    form, regex = ("text", whole_text_regex(pattern)) if ANY_DEPTH not in pattern else ("segments", segment_regex(pattern))
    segments = pattern.split(CHAIN_SEPARATOR)
    wild = [at for at, segment in enumerate(segments) if _WILD & set(segment)]
    if not wild:
        return WHOLE, pattern, form, regex
    if wild[0]:
        return HEAD, CHAIN_SEPARATOR.join(segments[: wild[0]]), form, regex
    if form == "segments":
        if wild[-1] + 1 < len(segments):
            return TAIL, CHAIN_SEPARATOR.join(segments[wild[-1] + 1 :]), form, regex
        literal = [segment for at, segment in enumerate(segments) if at not in wild]
        if literal:
            return INNER, max(literal, key=len), form, regex
    return FREE, "", form, regex


@F.pandas_udf(ANCHOR)
def _anchors(patterns: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 4 if pattern is None else anchor_of(pattern) for pattern in patterns]
    return pd.DataFrame(rows, columns=ANCHOR.fieldNames(), dtype=object)


def _filed(patterns: DataFrame) -> DataFrame:
    """Patterns under their anchors, once per salt."""
    filed = patterns.filter(F.col("pattern").isNotNull()).withColumn("_filed", _anchors("pattern"))
    salts = F.when(F.col("_filed.anchor_kind") == WHOLE, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    return filed.select(*patterns.columns, "_filed.*", F.explode(salts).alias("salt"))


def _lookups(tasks: DataFrame) -> DataFrame:
    """(task_id, text, anchor_kind, anchor, salt): the anchors a task is looked up under.

    Segments are those of the text, split from the left, as patterns are, whatever the ids contain.
    """
    text = chain_text(F.col("id_chain"))
    rows = compute_once(tasks.select("task_id", "id_chain"), {"text": text}, drop=("id_chain",))
    rows = compute_once(rows, {"segments": F.split("text", CHAIN_SEPARATOR, -1)})
    segments, count = F.col("segments"), F.size("segments")
    joined = lambda part: F.array_join(part, CHAIN_SEPARATOR)

    def entry(kind: str, anchor: Column) -> Column:
        return F.struct(F.lit(kind).alias("anchor_kind"), anchor.alias("anchor"))

    lengths = F.sequence(F.lit(1), count)
    places = F.concat(
        F.array(entry(WHOLE, F.col("text")), entry(FREE, F.lit(""))),
        F.transform(lengths, lambda n: entry(HEAD, joined(F.slice(segments, F.lit(1), n)))),
        F.transform(lengths, lambda n: entry(TAIL, joined(F.slice(segments, count - n + 1, n)))),
        F.transform(F.array_distinct(segments), lambda segment: entry(INNER, segment)),
    )
    spread = rows.select("task_id", "text", F.pmod(F.xxhash64("task_id"), F.lit(SPREAD)).cast("int").alias("_salt"), F.inline(places))
    return spread.withColumn("salt", F.when(F.col("anchor_kind") == WHOLE, 0).otherwise(F.col("_salt"))).drop("_salt")


def match_patterns(tasks: DataFrame, patterns: DataFrame) -> DataFrame:
    """(task_id, *columns of ``patterns``): each task with every pattern that matches its id chain.

    ``patterns`` has a ``pattern`` column; a NULL pattern matches nothing. Duplicate rows of
    either side are matched as often as they occur.
    """
    met = _lookups(tasks).join(_filed(patterns), ["anchor_kind", "anchor", "salt"])
    ended = F.concat(F.replace("text", F.lit(CHAIN_SEPARATOR), F.lit("\0")), F.lit("\0"))
    subject = F.when(F.col("form") == "segments", ended).otherwise(F.col("text"))
    return met.filter(F.rlike(subject, F.col("regex"))).select("task_id", *patterns.columns)


def filter_by_patterns(tasks: DataFrame, patterns: DataFrame) -> DataFrame:
    """The tasks that match any of the patterns; of an empty table of patterns, none."""
    return tasks.join(match_patterns(tasks, patterns.select("pattern")).select("task_id").distinct(), "task_id", "left_semi").select(*tasks.columns)


def first_rules(tasks: DataFrame, rules: DataFrame) -> DataFrame:
    """(task_id, rule, kind, argument, reason): the first rule of every task that has a validator and a rule.

    The first is found with its values in one aggregate, which combines on the map side.
    """
    matched = match_patterns(tasks.filter("has_validator").select("task_id", "id_chain"), rules)
    first = matched.groupBy("task_id").agg(F.min(F.struct("rule", "kind", "argument", "reason")).alias("first"))
    return first.select("task_id", "first.*")


def validate_by_rules(
    outputs: DataFrame,
    tasks: DataFrame,
    rules: DataFrame,
    checks: Mapping[str, Callable[[str], Any]] | None = None,
    at_once: int = 64,
) -> DataFrame:
    """Add ``validation`` to (task_id, output, error, ...) rows, by a table of rules (``RULES``).

    As ``validate_outputs``, with expected texts, rubrics and names of checks from the table; a rule of a
    kind, or with a check, that is not known fails validation with that as its reason and error.
    """
    others = [name for name in outputs.columns if name not in ("output", "error")]
    found = first_rules(tasks, rules).select(
        "task_id", F.col("kind").alias("_kind"), F.col("argument").alias("_argument"), F.col("reason").alias("_reason")
    )
    ruled = outputs.join(found, "task_id", "left").select(
        *others, F.coalesce("output", F.lit("")).alias("output"), "error", "_kind", "_argument", "_reason"
    )
    runs = F.col("error").isNull() & F.col("_kind").isNotNull()
    why = F.coalesce("_reason", F.concat(F.lit("Missing '"), F.col("_argument"), F.lit("'")))
    has = bind(
        F.col("output").contains(F.col("_argument")),
        lambda hit: outcome(hit, F.when(hit, 1.0).otherwise(0.0), F.when(~hit, why)),
    )
    unknown = F.concat(F.lit("no such rule: "), F.col("_kind"), F.lit(" "), F.coalesce("_argument", F.lit("")))
    failed = F.struct(
        *[(unknown if name == "failure" else outcome(False, 0.0, F.concat(F.lit("Validation error: "), unknown))[name]).alias(name) for name in OUTCOME.fieldNames()]
    )
    chosen = F.when(F.col("_kind") == CONTAINS, has).when(F.col("_kind") == MANUAL, outcome(None, 0.0, pending=True, rubric=F.col("_argument")))
    if checks:
        names = list(checks)
        number = F.array_position(F.array(*map(F.lit, names)), F.col("_argument")) - 1
        in_python = runs & (F.col("_kind") == PYTHON) & F.col("_argument").isin(names)
        made = _run_checks(dict(enumerate(checks.values())), at_once)(F.when(in_python, number), F.when(in_python, F.col("output")))
        ruled = ruled.withColumn("_found", made)
        chosen = chosen.when(in_python, F.col("_found"))
    checked = ruled.withColumn("_outcome", F.when(runs, chosen.otherwise(failed)))
    return checked.select(
        *others, "output", F.coalesce("error", F.col("_outcome.failure")).alias("error"),
        F.col("_outcome").dropFields("failure").alias("validation"),
    )
