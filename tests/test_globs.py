import fnmatch

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows_of
from evalspark.functions.globs import matches, matches_any, segment_regex, whole_text_regex
from evalspark.operators.runs import filter_tasks, matching_task_ids

GLOB = st.text(alphabet="ab*?[]!-^&|~\\.", max_size=7)
PART = st.text(alphabet="ab-[]!^\\&.\n", max_size=4)


def brute_force(parts, pattern):
    """Segment matching by trying every number of segments for each ``**``."""
    if not pattern:
        return not parts
    if pattern[0] == "**":
        return any(brute_force(parts[n:], pattern[1:]) for n in range(len(parts) + 1))
    return bool(parts) and fnmatch.fnmatchcase(parts[0], pattern[0]) and brute_force(parts[1:], pattern[1:])


def spark_matches(spark, pairs):
    """Which (text, regular expression) pairs match, in one job."""
    rows = spark.createDataFrame([(at, t, r) for at, (t, r) in enumerate(pairs)], "at int, t string, r string")
    return [row.m for row in sorted(rows.select("at", F.expr("t RLIKE r AS m")).collect())]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(globs=st.lists(GLOB, min_size=1, max_size=20), texts=st.lists(PART, min_size=1, max_size=20))
def test_whole_text_globs(spark, globs, texts):
    cases = [(text, glob) for glob in globs for text in texts]
    found = spark_matches(spark, [(text, whole_text_regex(glob)) for text, glob in cases])
    assert found == [fnmatch.fnmatchcase(text, glob) for text, glob in cases]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    globs=st.lists(st.lists(GLOB.filter(lambda g: g != "**") | st.just("**"), min_size=1, max_size=4), min_size=1, max_size=15),
    chains=st.lists(st.lists(PART, min_size=1, max_size=4), min_size=1, max_size=15),
)
def test_segment_globs(spark, globs, chains):
    cases = [(chain, glob) for glob in globs for chain in chains]
    found = spark_matches(
        spark, [("".join(part + "\0" for part in chain), segment_regex("::".join(glob))) for chain, glob in cases]
    )
    assert found == [brute_force(chain, glob) for chain, glob in cases]


CHAINS = [["a"], ["a", "b"], ["a", "b", "c"], ["x", "b"], ["a::b", "c"], []]


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [
        ("a::*", {"a::b", "a::b::c"}),  # without ``**`` a star also crosses segments
        ("*", {"a", "a::b", "a::b::c", "x::b", ""}),
        ("*::b", {"a::b", "x::b"}),
        ("a::b", {"a::b"}),
        ("A::b", set()),
        ("[!x]::?", {"a::b"}),
        ("**", {"a", "a::b", "a::b::c", "x::b", ""}),
        ("a::**", {"a", "a::b", "a::b::c"}),
        ("**::c", {"a::b::c"}),
        ("a::**::*", {"a::b", "a::b::c"}),
        ("**::*::**", {"a", "a::b", "a::b::c", "x::b", ""}),
        ("a**", {"a"}),  # inside a segment, two stars are one
    ],
)
def test_patterns(spark, pattern, expected):
    rows = spark.createDataFrame([(c,) for c in CHAINS], "c array<string>")
    found = rows.filter(matches(F.col("c"), pattern)).select(F.array_join("c", "::"))
    assert {row[0] for row in found.collect()} == expected


def test_several_patterns_and_none(spark):
    rows = spark.createDataFrame([(c,) for c in CHAINS], "c array<string>")
    assert rows.filter(matches_any(F.col("c"), ["a", "x::*"])).count() == 2
    assert rows.filter(matches_any(F.col("c"), [])).count() == len(CHAINS)


def test_task_filters(spark):
    tasks = spark.createDataFrame([(str(at), c) for at, c in enumerate(CHAINS)], "task_id string, id_chain array<string>")
    assert filter_tasks(tasks, ["**"]).count() == len(CHAINS)
    assert rows_of(matching_task_ids(tasks, ["*"])) == [("0",), ("1",), ("2",), ("3",), ("4",)]
