import pytest

from evalspark.operators.upsert import flatten_validation
from evalspark.operators.validators import (
    Rule,
    assign_rules,
    contains,
    judge_outputs,
    manual,
    python,
    validate_outputs,
)
from tests.conftest import MESSAGE_PAIR, plan_of, rows_of


@pytest.fixture
def tasks(make_tasks):
    return make_tasks(
        ("/1", ["math", "sum"], MESSAGE_PAIR, True),
        ("/2", ["essay", "one"], MESSAGE_PAIR, True),
        ("/3", ["math", "none"], MESSAGE_PAIR, False),
    )


@pytest.fixture
def outputs(spark, tasks):
    ids = {r.path: r.task_id for r in tasks.collect()}
    rows = [
        (1, ids["/1"], "it is 4", None),
        (2, ids["/1"], "it is 5", None),
        (3, ids["/1"], None, None),
        (4, ids["/1"], "", "API timeout"),
        (5, ids["/2"], "an essay", None),
        (6, ids["/3"], "4", None),
        (7, "unregistered", "4", None),
    ]
    return spark.createDataFrame(rows, "n int, task_id string, output string, error string")


def results(df):
    return {row.n: (row.error, None if row.validation is None else tuple(row.validation)) for row in df.collect()}


def test_native_validators(tasks, outputs):
    rules = [Rule("math::*", contains("4")), Rule("**", manual("Is it good?"))]
    checked = validate_outputs(outputs, tasks, rules)
    missing = (False, 0.0, "Missing '4'", None, False, None)
    assert results(checked) == {
        1: (None, (True, 1.0, None, None, False, None)),
        2: (None, missing),
        3: (None, missing),
        4: ("API timeout", None),
        5: (None, (None, 0.0, None, None, True, "Is it good?")),
        6: (None, None),
        7: (None, None),
    }
    assert {r.n: r.output for r in checked.collect()}[3] == ""
    assert "Python" not in plan_of(checked)


def test_first_matching_rule_counts(tasks):
    found = assign_rules(tasks, [Rule("essay::x", contains("")), Rule("essay::*", contains("")), Rule("**", contains(""))])
    assert sorted(r.rule for r in found.collect()) == [1, 2]


def test_python_validators(tasks, outputs):
    def check(output):
        if output == "it is 5":
            raise ValueError("five!")
        if output == "":
            return {"score": 0.0, "pending": True, "rubric": "see it"}
        return {"passed": True, "metadata": {"length": len(output)}}

    async def later(output):
        return {"passed": False, "score": 0.5, "reason": output}

    rules = [Rule("math::*", python(check)), Rule("essay::*", python(later))]
    checked = validate_outputs(outputs, tasks, rules)
    assert results(checked) == {
        1: (None, (True, 1.0, None, '{"length": 7}', False, None)),
        2: ("five!", (False, 0.0, "Validation error: five!", None, False, None)),
        3: (None, (None, 0.0, None, None, True, "see it")),
        4: ("API timeout", None),
        5: (None, (False, 0.5, "an essay", None, False, None)),
        6: (None, None),
        7: (None, None),
    }


def test_judge_scores(spark, outputs):
    scores = spark.createDataFrame([(1, 0.51), (2, 0.5), (4, 1.0)], "n int, score double")
    found = results(judge_outputs(outputs, scores, key="n"))
    assert found[1] == (None, (True, 0.51, None, None, False, None))
    assert found[2] == (None, (False, 0.5, None, None, False, None))
    assert found[4] == ("API timeout", None) and found[5] == (None, None)


def test_validations_flatten_into_run_columns(tasks, outputs):
    flat = flatten_validation(validate_outputs(outputs, tasks, [Rule("math::*", contains("4"))]))
    assert rows_of(flat.filter("n IN (1, 6)"), "n", "validation_passed", "validation_pending") == [
        (1, True, False),
        (6, None, False),
    ]


def test_one_row_per_output(spark, make_tasks):
    """A task in two folders, and two scores of one run, do not multiply rows."""
    tasks = make_tasks(("/a", ["x", "y"], MESSAGE_PAIR, True), ("/b", ["x", "y"], MESSAGE_PAIR, True))
    task_id = tasks.first().task_id
    outputs = spark.createDataFrame([("e", task_id, "text", None)], "execution_id string, task_id string, output string, error string")
    assert validate_outputs(outputs, tasks, [Rule("**", contains("t"))]).count() == 1
    scores = spark.createDataFrame([("e", 0.9, 1), ("e", 0.2, 2)], "execution_id string, score double, at int")
    assert [r.validation.score for r in judge_outputs(outputs, scores, order_by=["at"]).collect()] == [0.2]
    assert [r.validation.score for r in judge_outputs(outputs, scores).collect()] == [0.9]


def test_checks_that_wait_do_so_together(spark, make_tasks):
    import asyncio
    import time

    async def slow(output):
        await asyncio.sleep(0.3)
        return {"passed": output == "1", "wrong": 1} if output == "2" else {"passed": output == "1"}

    tasks = make_tasks(("/a", ["x"], MESSAGE_PAIR, True))
    task_id = tasks.first().task_id
    rows = [(task_id, str(i), None) for i in range(100)]
    outputs = spark.createDataFrame(rows, "task_id string, output string, error string").coalesce(1)
    start = time.perf_counter()
    found = {r.output: r for r in validate_outputs(outputs, tasks, [Rule("**", python(slow))], at_once=200).collect()}
    assert time.perf_counter() - start < 20 and len(found) == 100
    assert found["1"].validation.passed and not found["3"].validation.passed
    assert "no wrong" in found["2"].error
