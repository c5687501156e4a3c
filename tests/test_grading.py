import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalspark.operators import grading
from tests.conftest import rows_of

TOKENS = {
    "p": 1.0, "pass": 1.0, "1": 1.0, " PASS\n": 1.0, "h": 0.5, "half": 0.5, "partial": 0.5, "0.5": 0.5,
    "f": 0.0, "fail": 0.0, "0": 0.0, "F": 0.0, "s": None, "x": None, "": None, "v": None, "q": None, "1.0": None,
}


def test_tokens(spark):
    rows = spark.createDataFrame([(t, " why ") for t in TOKENS] + [(None, "\t")], "token string, reason string")
    found = grading.read_grades(rows).collect()
    assert {r.token: r.score for r in found} == {**TOKENS, None: None}
    outcomes = {r.token: r.outcome for r in found}
    assert outcomes["p"] == "graded" and outcomes["s"] == "skipped"
    assert {t for t, o in outcomes.items() if o == "invalid"} == {"x", "", "v", "q", "1.0", None}
    assert {r.reason for r in found} == {"why", None}


@pytest.fixture
def runs(make_runs):
    return make_runs(
        {"task_id": "1", "model": "m", "validation_pending": True, "validation_score": 0.0},
        {"task_id": "2", "model": "m", "validation_pending": True, "validation_score": 0.0, "validation_reason": "old"},
        {"task_id": "3", "model": "m", "validation_passed": True, "validation_score": 1.0},
        {"task_id": "4", "model": "m", "validation_pending": True, "validation_score": 0.0},
    )


def grades_for(spark, runs, *grades):
    keys = {r.task_id: r.execution_id for r in runs.collect()}
    rows = [(keys.get(task, task), score, reason, at) for task, score, reason, at in grades]
    return spark.createDataFrame(rows, "execution_id string, score double, reason string, at int")


def test_apply_grades(spark, runs):
    grades = grades_for(
        spark, runs, ("1", 0.0, "first", 1), ("1", 1.0, "second", 2), ("2", 0.5, None, 1), ("3", 0.0, "regraded", 1), ("gone", 1.0, None, 1)
    )
    graded = grading.apply_grades(runs, grades, ["at"])
    columns = ("task_id", "validation_passed", "validation_score", "validation_reason", "validation_pending")
    assert rows_of(graded, *columns) == [
        ("1", True, 1.0, "second", False),
        ("2", False, 0.5, None, False),
        ("3", False, 0.0, "regraded", False),
        ("4", None, 0.0, None, True),
    ]


def test_other_scores_are_rejected(spark, runs):
    grades = grades_for(spark, runs, ("1", 0.7, None, 1), ("2", None, None, 1), ("3", 1.0, None, 1))
    assert grading.rejected_grades(grades).count() == 2
    assert grading.apply_grades(runs, grades, ["at"]).filter("validation_pending").count() == 3
    with pytest.raises(PySparkException, match="no such score"):
        grading.apply_grades(runs, grades, ["at"], strict=True).collect()


def test_tally(spark, runs):
    pending = runs.filter(F.col("validation_pending"))
    keys = {r.task_id: r.execution_id for r in runs.collect()}
    answers = [("1", "p"), ("1", "f"), ("2", "s"), ("3", "p"), ("4", "?")]
    grades = spark.createDataFrame([(keys[t], a, "") for t, a in answers], "execution_id string, token string, reason string")
    assert rows_of(grading.grading_tally(pending, grading.read_grades(grades))) == [(3, 1, 1, 1)]
    assert rows_of(grading.grading_tally(pending, grading.read_grades(grades.limit(0)))) == [(3, 0, 0, 3)]
