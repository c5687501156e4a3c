"""Validators: column expressions that turn an output into a validation.

A validator is a function from the output column to a struct; rules bind validators to task
patterns, and a task gets the first rule that matches it. Substring checks and manual review
are plain expressions. Python functions run in one Arrow-batched UDF in the same pass; of rows with
another kind of rule it gets a NULL.
"""

from __future__ import annotations

import asyncio
import inspect
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.columns import bind
from evalspark.functions.globs import matches
from evalspark.schemas import VALIDATION

# What a validator returns: a validation, and the text of its own failure if it failed.
OUTCOME = T.StructType([*VALIDATION.fields, T.StructField("failure", T.StringType())])

Validator = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """Apply ``validator`` to the tasks whose id chain matches ``pattern``."""

    pattern: str
    validator: Validator | PythonCheck


@dataclass(frozen=True)
class PythonCheck:
    """A Python function, plain or async, from output text to a mapping of validation fields."""

    check: Callable[[str], Any]


#: What a field is that a validator does not set; all others are NULL.
UNSET = {"score": 1.0, "pending": False}


def outcome(
    passed: Column | bool | None,
    score: Column | float | None = None,
    reason: Column | str | None = None,
    metadata: Column | str | None = None,
    pending: Column | bool | None = None,
    rubric: Column | str | None = None,
) -> Column:
    """Build a validator's result; fields that are not given, or NULL, are as ``UNSET`` has them."""
    given = {
        "passed": passed, "score": score, "reason": reason,
        "metadata": metadata, "pending": pending, "rubric": rubric,
    }
    fields = []
    for name, value in given.items():
        value = (value if isinstance(value, Column) else F.lit(value)).cast(OUTCOME[name].dataType)
        fields.append((F.coalesce(value, F.lit(UNSET[name])) if name in UNSET else value).alias(name))
    return F.struct(*fields, F.lit(None).cast("string").alias("failure"))


def contains(expected: str, reason: str | None = None) -> Validator:
    """Pass with 1.0 when the output contains a text, fail with 0.0 and a reason otherwise."""
    why = f"Missing {expected!r}" if reason is None else reason

    def result(found: Column) -> Column:
        return outcome(found, F.when(found, 1.0).otherwise(0.0), F.when(~found, why))

    return lambda output: bind(output.contains(expected), result)


def manual(rubric: str | None = None) -> Validator:
    """Leave the output for a person to grade."""
    return lambda output: outcome(None, 0.0, pending=True, rubric=rubric)


def python(check: Callable[[str], Any]) -> PythonCheck:
    """Validate with a Python function that maps output text to any of the validation's fields.

    ``{"passed": True}`` is enough; metadata is a dictionary. An exception, or a field that a
    validation does not have, becomes a failed validation and the run's error; it does not fail
    the job.
    """
    return PythonCheck(check)


async def _outcome(check: Callable[[str], Any], output: str) -> tuple:
    try:
        made = check(output)
        if inspect.isawaitable(made):
            made = await made
        if unknown := set(made) - set(VALIDATION.fieldNames()):
            raise ValueError(f"a validation has no {', '.join(sorted(unknown))}")
        found = UNSET | {name: value for name, value in made.items() if value is not None}
        found["score"] = float(found["score"])
        found["metadata"] = json.dumps(found["metadata"]) if found.get("metadata") else None
        return (*(found.get(name) for name in VALIDATION.fieldNames()), None)
    except Exception as failure:  # any failure of user code is a result here
        failed = UNSET | {"passed": False, "score": 0.0, "reason": f"Validation error: {failure}"}
        return (*(failed.get(name) for name in VALIDATION.fieldNames()), str(failure))


def _run_checks(checks: dict[int, Callable[[str], Any]], at_once: int):
    """One UDF for all Python rules: the checks of an Arrow batch share an event loop."""

    async def all_of(rules: pd.Series, outputs: pd.Series) -> list[tuple]:
        free = asyncio.Semaphore(at_once)

        async def one(rule: float | None, output: str | None) -> tuple:
            if output is None:  # a row with another kind of rule
                return (None,) * len(OUTCOME)
            async with free:
                return await _outcome(checks[int(rule)], output)

        return await asyncio.gather(*map(one, rules, outputs))

    @F.pandas_udf(OUTCOME)
    def run(rules: pd.Series, outputs: pd.Series) -> pd.DataFrame:
        rows = asyncio.run(all_of(rules, outputs))
        return pd.DataFrame(rows, columns=OUTCOME.fieldNames(), dtype=object)

    return run


def assign_rules(tasks: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(task_id, rule): the number of the first rule that matches each task with a validator."""
    number = F.coalesce(
        *[F.when(matches(F.col("id_chain"), rule.pattern), F.lit(at)) for at, rule in enumerate(rules)]
    )
    # a task may lie in several folders; it is one task, with the first of their rules
    ruled = tasks.filter("has_validator").select("task_id", number.alias("rule")).filter("rule IS NOT NULL")
    return ruled.groupBy("task_id").agg(F.min("rule").alias("rule"))


def validate_outputs(
    outputs: DataFrame, tasks: DataFrame, rules: Sequence[Rule], at_once: int = 64
) -> DataFrame:
    """Add ``validation`` to (task_id, output, error, ...) rows.

    A NULL output counts as empty text. A failed run, and a task without a rule, get no
    validation; a failing validator also sets ``error``. Patterns are matched on the tasks, so
    only a rule number is joined to the outputs. Only outputs with a Python rule go to Python, once;
    ``at_once`` of the checks of an Arrow batch may wait for something at a time.
    """
    others = [name for name in outputs.columns if name not in ("output", "error")]
    ruled = outputs.join(assign_rules(tasks, rules), "task_id", "left").select(
        *others, F.coalesce("output", F.lit("")).alias("output"), "error", "rule"
    )
    checks = {at: rule.validator.check for at, rule in enumerate(rules) if isinstance(rule.validator, PythonCheck)}
    chosen = F.lit(None).cast(OUTCOME)
    for at, rule in enumerate(rules):
        if at not in checks:
            applies = F.col("error").isNull() & (F.col("rule") == at)
            chosen = F.when(applies, rule.validator(F.when(applies, F.col("output")))).otherwise(chosen)
    if checks:
        in_python = F.col("error").isNull() & F.col("rule").isin(list(checks))
        found = _run_checks(checks, at_once)(F.when(in_python, F.col("rule")), F.when(in_python, F.col("output")))
        ruled = ruled.withColumn("_found", found)
        chosen = F.when(in_python, F.col("_found")).otherwise(chosen)
    checked = ruled.withColumn("_outcome", chosen)
    return checked.select(
        *others,
        "output",
        F.coalesce("error", F.col("_outcome.failure")).alias("error"),
        F.col("_outcome").dropFields("failure").alias("validation"),
    )


def judge_outputs(
    outputs: DataFrame,
    scores: DataFrame,
    key: str = "execution_id",
    threshold: float = 0.5,
    order_by: Sequence[str | Column] = (),
) -> DataFrame:
    """Add ``validation`` from a table of judge scores (key, score): passed above the threshold.

    The judging itself happens elsewhere; rows without a score get no validation. Of several
    scores of one key the last in ``order_by`` counts, without an order the highest.
    """
    order = F.struct(*order_by, "score") if order_by else F.col("score")
    last = scores.groupBy(key).agg(F.max_by("score", order).alias("_score"))
    judged = outputs.join(last, key, "left")
    verdict = outcome(F.col("_score") > F.lit(threshold), F.col("_score")).dropFields("failure")
    return judged.withColumn(
        "validation", F.when(F.col("_score").isNotNull() & F.col("error").isNull(), verdict)
    ).drop("_score")
