"""Manual grading in batches: a table of grade tokens instead of an interactive prompt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import strip
from evalspark.schemas import SCORES, TASK_RUNS, conform

# The tokens of a grade file.
GRADE_TOKENS = {
    1.0: ("p", "pass", "1"),
    0.5: ("h", "half", "partial", "0.5"),
    0.0: ("f", "fail", "0"),
}
SKIP_TOKENS = ("s",)

GRADED, SKIPPED, INVALID = "graded", "skipped", "invalid"


def _normal(token: Column) -> Column:
    return F.lower(strip(token))


def token_score(token: Column) -> Column:
    """The score a token stands for; NULL for a skip or anything unknown."""
    normal, result = _normal(token), F.lit(None).cast("double")
    for score, tokens in GRADE_TOKENS.items():
        result = F.when(normal.isin(*tokens), F.lit(score)).otherwise(result)
    return result


def token_outcome(token: Column) -> Column:
    """graded, skipped or invalid."""
    return (
        F.when(token_score(token).isNotNull(), GRADED)
        .when(_normal(token).isin(*SKIP_TOKENS), SKIPPED)
        .otherwise(INVALID)
    )


def read_grades(grades: DataFrame) -> DataFrame:
    """Turn ``token`` and ``reason`` into ``outcome``, ``score`` and ``reason`` (blank is NULL)."""
    return grades.withColumns(
        {
            "outcome": token_outcome(F.col("token")),
            "score": token_score(F.col("token")),
            "reason": F.nullif(strip(F.col("reason")), F.lit("")),
        }
    )


def rejected_grades(grades: DataFrame) -> DataFrame:
    """The grades whose score is not one of the three."""
    return grades.filter(~F.coalesce(F.col("score").isin(*SCORES), F.lit(False)))


def latest_grades(grades: DataFrame, order_by: Sequence[str | Column], strict: bool = False) -> DataFrame:
    """(_key, _grade): the last grade of each run, with its score and reason; see ``apply_grades``."""
    allowed = F.coalesce(F.col("score").isin(*SCORES), F.lit(False))
    if strict:
        given = F.coalesce(F.col("score").cast("string"), F.lit("none"))
        failure = F.raise_error(F.concat(F.lit("no such score: "), given)).cast("double")
        grades = grades.withColumn("score", F.when(allowed, F.col("score")).otherwise(failure))
    else:
        grades = grades.filter(allowed)
    order = F.struct(*order_by)
    return grades.groupBy(F.col("execution_id").alias("_key")).agg(
        F.max_by(F.struct("score", "reason"), order).alias("_grade")
    )


def apply_grades(
    runs: DataFrame, grades: DataFrame, order_by: Sequence[str | Column], strict: bool = False
) -> DataFrame:
    """Set passed, score and reason of the graded runs and end their pending state.

    ``grades`` has execution_id, score, reason; the last one per run counts. Any run can be
    graded, not only a pending one. A score outside the three fails the job when ``strict``;
    otherwise the grade is left out (see ``rejected_grades``).
    """
    latest = latest_grades(grades, order_by, strict)
    graded = F.col("_key").isNotNull()
    new_values = {
        "validation_passed": F.col("_grade.score") == F.lit(1.0),
        "validation_score": F.col("_grade.score"),
        "validation_reason": F.col("_grade.reason"),
        "validation_pending": F.lit(False),
    }
    joined = conform(runs, TASK_RUNS).join(latest, F.col("execution_id") == F.col("_key"), "left")
    return joined.select(
        *[
            F.when(graded, new_values[name]).otherwise(F.col(name)).alias(name)
            if name in new_values
            else F.col(name)
            for name in TASK_RUNS.fieldNames()
        ]
    )


def grading_tally(pending: DataFrame, grades: DataFrame) -> DataFrame:
    """(total, graded, skipped, remaining) of a queue after a grade file (see ``read_grades``).

    Grades of other runs do not count, nor does a second grade of the same run.
    """
    first_answer = (F.col("outcome") == GRADED, F.col("outcome") == SKIPPED)
    outcomes = grades.groupBy("execution_id").agg(
        F.bool_or(first_answer[0]).alias("was_graded"), F.bool_or(first_answer[1]).alias("was_skipped")
    )
    marked = pending.select("execution_id").join(outcomes, "execution_id", "left")
    counts = marked.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("was_graded")).alias("graded"),
        F.count_if(F.col("was_skipped") & ~F.col("was_graded")).alias("skipped"),
    )
    return counts.withColumn("remaining", F.col("total") - F.col("graded") - F.col("skipped"))
