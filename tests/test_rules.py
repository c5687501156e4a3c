"""Rules as a table: matched like single patterns, whatever their number."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evalspark.functions.globs import matches
from evalspark.operators.rules import RULES, anchor_of, filter_by_patterns, match_patterns, validate_by_rules
from evalspark.operators.validators import Rule, contains, manual, python, validate_outputs
from tests.conftest import MESSAGE_PAIR, plan_of

PATTERNS = [
    "**", "*", "a::*", "a::**", "**::c", "**::b::**", "a::b", "a::b::c", "a*", "*::c", "?::b::c", "**::[ab]::*", "a::**::c", "**::x*::c",
    "a::b*", "[!a]::**", "", "a:::b", "a::", "::a", "**::", "b::c::**::d", "*::*", "a::?::**", "**::b", "**::c::d", "[a", "a::[b",
]
CHAINS = [
    ["a"], ["a", "b"], ["a", "b", "c"], ["b", "c"], ["x", "b", "c"], ["a", "xy", "c"], ["a:", "b"], ["a", ":b"], [""], ["a", ""], ["", "a"],
    ["a::b", "c"], ["b", "c", "d"], ["b", "c", "q", "d"], ["[a"], ["a", "[b"], ["*"], ["a", "b", "c", "d"],
]


def test_every_pattern_matches_as_it_does_alone(spark, make_tasks):
    tasks = make_tasks(*[(f"/{at}", chain, MESSAGE_PAIR) for at, chain in enumerate(CHAINS)])
    table = spark.createDataFrame([(at, pattern) for at, pattern in enumerate(PATTERNS)] + [(99, None)], "n int, pattern string")
    got = sorted((r.task_id, r.n) for r in match_patterns(tasks, table).collect())
    flags = tasks.select("task_id", *[matches(F.col("id_chain"), pattern).alias(f"p{at}") for at, pattern in enumerate(PATTERNS)]).collect()
    assert got == sorted((r.task_id, at) for r in flags for at in range(len(PATTERNS)) if r[f"p{at}"])
    some = filter_by_patterns(tasks, table.filter("n IN (4, 6)"))
    assert some.columns == tasks.columns
    assert {r.task_id for r in some.collect()} == {r.task_id for r in flags if r.p4 or r.p6}
    assert filter_by_patterns(tasks, table.limit(0)).count() == 0


def test_anchors():
    assert [anchor_of(p)[:2] for p in ("a::b", "a::b*", "**::c", "**::bb::**::c?", "*", "*::c")] == [
        ("whole", "a::b"), ("head", "a"), ("tail", "c"), ("inner", "bb"), ("free", ""), ("free", ""),
    ]


def by_length(output):
    if output == "bad":
        raise ValueError("bad!")
    return {"passed": len(output) > 3}


def test_rule_table_validates_like_the_list(spark, make_tasks):
    tasks = make_tasks(*[(f"/{at}", chain, MESSAGE_PAIR, at % 5 != 4) for at, chain in enumerate(CHAINS)])
    ids = [row.task_id for row in tasks.collect()]
    outputs = spark.createDataFrame(
        [(n, task, text, "failed" if n % 7 == 6 else None) for n, (task, text) in enumerate((t, x) for t in ids for x in ("the end", "bad", None))],
        "n int, task_id string, output string, error string",
    )
    rows = [(3, "a::b::c", "contains", "end", None), (5, "**::c", "manual", "see it", None), (8, "a::*", "contains", "the", "not there"), (9, "*", "python", "length", None)]
    listed = [Rule("a::b::c", contains("end")), Rule("**::c", manual("see it")), Rule("a::*", contains("the", "not there")), Rule("*", python(by_length))]
    table = spark.createDataFrame(random.Random(1).sample(rows, 4), RULES)
    result = lambda df: sorted(map(str, df.select("n", "output", "error", "validation").collect()))
    assert result(validate_by_rules(outputs, tasks, table, {"length": by_length})) == result(validate_outputs(outputs, tasks, listed))


def test_unknown_kinds_and_checks_fail_validation(spark, make_tasks):
    tasks = make_tasks(("/a", ["a"], MESSAGE_PAIR, True), ("/b", ["b"], MESSAGE_PAIR, True))
    table = spark.createDataFrame([(1, "a", "odd", None, None), (2, "b", "python", "gone", None)], RULES)
    outputs = tasks.select("task_id", F.lit("x").alias("output"), F.lit(None).cast("string").alias("error"))
    found = validate_by_rules(outputs, tasks, table, {"length": by_length}).collect()
    assert {r.error for r in found} == {"no such rule: odd ", "no such rule: python gone"}
    assert all(r.validation.passed is False and r.validation.reason.startswith("Validation error") for r in found)


@pytest.mark.parametrize("count", [10, 10_000])
def test_the_plan_does_not_grow_with_the_rules(spark, make_tasks, tmp_path, count):
    tasks = make_tasks(*[(f"/{at}", ["t", str(at)], MESSAGE_PAIR, True) for at in range(40)])
    rules = spark.range(count).selectExpr("id AS rule", "concat('t::', id) AS pattern", "'contains' AS kind", "concat('w', id) AS argument", "CAST(NULL AS STRING) AS reason")
    outputs = tasks.select("task_id", "id_chain", F.concat(F.lit("w"), F.element_at("id_chain", -1)).alias("output"), F.lit(None).cast("string").alias("error"))
    checked = validate_by_rules(outputs, tasks, rules)
    assert len(plan_of(checked).splitlines()) < 80
    passed = {r.id_chain[1]: r.validation and r.validation.passed for r in checked.collect()}
    assert passed == {str(at): True if at < count else None for at in range(40)}
