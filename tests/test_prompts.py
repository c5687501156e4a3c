import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from tests.conftest import plan_of
from evalspark.sources.prompts import (
    INVALID_ID,
    UNKNOWN_HEADER,
    UNSUPPORTED_FRONTMATTER,
    parse_errors,
    parse_prompts,
)

yaml = pytest.importorskip("yaml")


def parse(spark, *texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "at int, text string")
    found = sorted(parse_prompts(rows, **options).collect(), key=lambda row: row.at)
    return [
        (row.id, None if row.messages is None else [tuple(m) for m in row.messages], row.parse_error)
        for row in found
    ]


def document(head, body=""):
    return f"---\n{head}\n---\n{body}"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("---\nid: t\n---\n---\n\n# System\nLorem ipsum.\n", ("t", [("system", "Lorem ipsum.")], None)),
        (document("id: t"), ("t", [], None)),
        (document("id: t", "no header\n"), ("t", [], None)),
        (
            document("id: t", "dropped\n# User\n a \n\n## kept\n# Assistant\n# SYSTEM\n　x\x85\n"),
            ("t", [("user", "a \n\n## kept"), ("assistant", ""), ("system", "x")], None),
        ),
        (document("id: t", "# User\r\na\rb\r\n"), ("t", [("user", "a\nb")], None)),
        (document("id: t", "# Tool\nx"), (None, None, UNKNOWN_HEADER)),
        (document("id: t", "# User \nx"), (None, None, UNKNOWN_HEADER)),
        (document("id: t", "# User\n# a comment\n"), (None, None, UNKNOWN_HEADER)),
        (document("other: x"), (None, None, INVALID_ID)),
        (document(""), (None, None, INVALID_ID)),
        ("text before ---\nid: t\n---\n# User\nx", ("t", [("user", "x")], None)),
        ("---\nid: t\n# User", ("t", [("user", "")], None)),  # no closing fence
        ("---\nid: [a]\n---\n", (None, None, UNSUPPORTED_FRONTMATTER)),
        (document("id: |\n  a\n  b"), (None, None, UNSUPPORTED_FRONTMATTER)),
        (document("id: a\n  b"), (None, None, UNSUPPORTED_FRONTMATTER)),
        (document("id: a\nno key here"), (None, None, UNSUPPORTED_FRONTMATTER)),
        (document("nested:\n  id: inner\nid: outer\nlist:\n  - a"), ("outer", [], None)),
        (document("id: a\nid: b"), ("b", [], None)),
    ],
)
def test_documents(spark, text, expected):
    assert parse(spark, text) == [expected]


VALUES = [
    "plain", "two words", "a#b", "a # comment", "# comment", "", "~", "null", "Null", "yes", "No", "ON", "y", "true1",
    "123", "-7", "+1", "1_000", "0b11", "0o7", "017", "0x1F", "1:30", "12e3", "1.5", ".5", "1.", "1e5", "1.0e+5", ".inf",
    "-.INF", ".nan", "2024-01-02", "2024-1-2", "2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024-01-02x",
    "'it''s'", "'123'", "'a' # c", '"quoted"', '"yes"', '"a # b"', "a:b", "http://x/y", "-a", "?a", ":a", "a-b_c.d",
    "1.2.3", "é", "a'b", 'a"b', "=x", "<<x", "@x", "`x", "%x", "&a", "*a", "!t x", "a: b", "a:", "- a", "'open", "{}",
]


def test_ids_are_read_as_yaml_reads_them(spark):
    """Where a value is decided at all, it is what a YAML parser makes of it."""
    found = parse(spark, *[document(f"id: {value}") for value in VALUES])
    decided = 0
    for value, (identifier, _, reason) in zip(VALUES, found, strict=True):
        if reason == UNSUPPORTED_FRONTMATTER:
            continue
        decided += 1
        read = yaml.safe_load(f"id: {value}".strip())["id"]
        assert identifier == (read if isinstance(read, str) else None), value
        assert reason == (None if isinstance(read, str) else INVALID_ID), value
    assert decided >= 50


def restated(text):
    """The body rule written as a loop over lines."""
    messages, role, lines = [], None, []
    for line in [*text.split("\n"), None]:
        header = line is None or line.startswith("# ")
        if header and role is not None:
            messages.append((role, "\n".join(lines).strip()))
        if header and line is not None:
            role, lines = line[2:].lower(), []
            if role not in ("system", "assistant", "user"):
                return None
        elif line is not None:
            lines.append(line)
    return messages


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    bodies=st.lists(
        st.lists(st.sampled_from(["# User", "# SYSTEM", "# assistant", "# x", "a", "", " ", "## b", "#c", " d\t"]), max_size=8),
        min_size=1,
        max_size=40,
    )
)
def test_bodies(spark, bodies):
    texts = ["\n".join(lines) for lines in bodies]
    found = parse(spark, *[document("id: t", text) for text in texts])
    assert [messages for _, messages, _ in found] == [restated(text) for text in texts]


def test_strict_mode_fails_the_job(spark):
    with pytest.raises(PySparkException, match="cannot parse a prompt: unknown header"):
        parse(spark, document("id: t", "# Tool\n"), strict=True)
    assert parse(spark, document("id: t"), strict=True) == [("t", [], None)]


def test_errors_are_reported(spark):
    rows = spark.createDataFrame([(1, document("id: 5")), (2, document("id: t"))], "at int, text string")
    assert [tuple(r) for r in parse_errors(parse_prompts(rows)).collect()] == [(1, INVALID_ID)]


def test_filters_do_not_repeat_the_parse(spark):
    rows = spark.createDataFrame([(1, document("id: t"))], "at int, text string")
    plan = plan_of(parse_prompts(rows).filter("size(messages) > 0 AND id <> 'x'"))
    assert len(re.findall(r"split\(", plan)) <= 2
    assert "Python" not in plan


def random_head(rng):
    """Frontmatter with an id in some form, among other keys in others."""
    ids = [
        "plain", "two words", "'single ''quoted'''", '"double"', '"esc\\u00e9 \\"q\\" \\n"', "&a anchored", "!!str 5", "!!str tagged", "5", "null",
        "2024-01-01", "yes", "|\n  block\n  text", ">-\n  folded\n  text", "[a, b]", "{a: b}", "goes\n  on", "x # note", "a: b", "'open", "*a", "@x", "1_000", "0x1F", ".5", "~", "",
    ]
    others = [
        "title: A name", "tags: [a, b,\n  c]", "tags:\n- a\n- b", "tags:\n  - a\n  - b", "'quoted key': 1", '"k": v', "text: |\n  id: not this\n\n  more",
        "map: {id: inner, x: 1}", "nested:\n  id: inner", "# a note", "", "anchor: &x 1", "note: 'a\n  id: b'",
    ]
    key = rng.choice(["id", "id", "id", "id", '"id"', "'id'", "id ", "Id"])
    lines = [rng.choice(others) for _ in range(rng.randint(0, 3))] + [f"{key}: {rng.choice(ids)}"]
    rng.shuffle(lines)
    return "\n".join(lines)


def test_heads_agree_with_a_yaml_library(spark):
    """500 generated heads: the library decides what expressions cannot; where they can, they agree with it."""
    import random

    from evalspark.sources.prompts import UNSUPPORTED_FRONTMATTER, head_id

    rng = random.Random(11)
    heads = [random_head(rng).strip() for _ in range(500)]
    table = spark.createDataFrame([(at, f"---\n{head}\n---\n# User\nhi\n") for at, head in enumerate(heads)], "n int, text string")
    native = {row.n: row for row in parse_prompts(table).collect()}
    whole = {row.n: row for row in parse_prompts(table, yaml=True).collect()}
    plain = 0
    for at, head in enumerate(heads):
        found, reason = head_id(head)
        assert (whole[at].id, whole[at].parse_error is None) == (found, reason is None), head
        if native[at].parse_error != UNSUPPORTED_FRONTMATTER:
            assert (native[at].id, native[at].parse_error is None) == (found, reason is None), head
            plain += 1
    assert 100 < plain < 450
