import hashlib
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import MESSAGE_PAIR, plan_of, rows_of
from evalspark.functions import identity
from evalspark.functions.text import strip, unix_lines
from evalspark.schemas import MESSAGES

TEXT = st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40)
SPECIAL = st.text(alphabet='ab"\\/\n\r\t\b\f\x00\x1f\x7f\x80é漢😀 ', max_size=40)
LISTS = st.lists(
    st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), TEXT | SPECIAL), max_size=4),
    min_size=1,
    max_size=60,
)


def expected_hash(messages):
    text = json.dumps([{"role": role, "content": content} for role, content in messages], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def hashes(spark, lists):
    frame = spark.createDataFrame(
        [(at, messages) for at, messages in enumerate(lists)], "at int, messages " + MESSAGES.simpleString()
    )
    found = frame.select("at", identity.messages_hash(F.col("messages")).alias("h")).collect()
    return [row.h for row in sorted(found)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lists=LISTS)
def test_hash_equals_that_of_the_json_module(spark, lists):
    assert hashes(spark, lists) == [expected_hash(messages) for messages in lists]


def test_hash_depends_on_content_role_and_order(spark):
    variants = [
        [("user", "Hello")],
        [("user", "Goodbye")],
        [("system", "Hello")],
        [("user", "First"), ("user", "Second")],
        [("user", "Second"), ("user", "First")],
        [],
    ]
    first, again = hashes(spark, variants), hashes(spark, variants)
    assert first == again
    assert len(set(first)) == len(variants)


def test_hash_needs_complete_messages(spark):
    assert hashes(spark, [[("user", None)], [(None, "x"), ("user", "y")]]) == [None, None]


def test_task_and_execution_ids(spark):
    rows = spark.createDataFrame(
        [(["cat", "task"], "h1"), (["cat2", "task"], "h1"), (["cat", "task"], "h2"), ([], "h1")],
        "c array<string>, h string",
    )
    ids = [r[0] for r in rows.select(identity.task_id(F.col("c"), F.col("h"))).collect()]
    assert ids[0] == hashlib.sha256(b"cat::task::h1").hexdigest()
    assert ids[3] == hashlib.sha256(b"::h1").hexdigest()
    assert len(set(ids)) == 4
    run = spark.range(1).select(identity.execution_id(F.lit("t"), F.lit("m"))).first()[0]
    assert run == hashlib.sha256(b"t::m").hexdigest()
    absent = spark.range(1).select(identity.execution_id(F.lit(None).cast("string"), F.lit("m"))).first()[0]
    assert absent is None


def test_names(spark):
    rows = spark.createDataFrame(
        [(["a", "b"], "x/y/z", None), (["a"], "plain", ""), (["a"], "p/q", "named")],
        "c array<string>, m string, n string",
    )
    found = rows.select(
        identity.display_name(F.col("c")),
        identity.chain_text(F.col("c")),
        identity.short_model(F.col("m")),
        identity.name_or_id(F.col("n"), F.lit("0123456789abcdef0123"), 8),
        identity.name_or_id(F.col("n"), F.lit("0123456789abcdef0123"), 16),
    ).collect()
    assert [tuple(r) for r in found] == [
        ("a / b", "a::b", "z", "01234567", "0123456789abcdef"),
        ("a", "a", "plain", "01234567", "0123456789abcdef"),
        ("a", "a", "q", "named", "named"),
    ]


def test_the_hash_is_computed_once_and_without_python(make_tasks):
    tasks = make_tasks(("/p", ["a", "b"], MESSAGE_PAIR))
    plan = plan_of(tasks.filter(F.col("task_id").isNotNull() & (F.col("messages_hash") != "x")))
    assert "Python" not in plan
    assert plan.count("UTF-16BE") == 1
    assert rows_of(tasks, "messages_hash") == [(expected_hash(MESSAGE_PAIR),)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab \t\n\x0b\x1c\x85\xa0 　​\r", max_size=12), min_size=1, max_size=60))
def test_strip_and_line_ends(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "at int, t string")
    found = rows.select("at", strip(F.col("t")), unix_lines(F.col("t"))).collect()
    expected = [(t.strip(), t.replace("\r\n", "\n").replace("\r", "\n")) for t in texts]
    assert [tuple(r)[1:] for r in sorted(found)] == expected
