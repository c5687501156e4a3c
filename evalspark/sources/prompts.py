"""Parsing prompt documents: frontmatter with an ``id``, then one section per message.

Everything is built from column expressions, so a table of billions of prompts is parsed by
the scan that reads it. The YAML of the frontmatter is read only as far as it is needed: the
top-level scalar ``id``. What cannot be decided that way (quoted keys, escapes, block and flow values,
anchors) is reported, not guessed; with ``yaml`` such frontmatter, and no other, is read by PyYAML
in an Arrow-batched function, where that is installed.
"""

from __future__ import annotations

from importlib.util import find_spec

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.columns import compute_once
from evalspark.functions.text import strip, unix_lines
from evalspark.schemas import known_roles

FENCE = "---\n"
SECTION = "\n# "

# Values of ``parse_error``.
INVALID_ID = "invalid id"
UNSUPPORTED_FRONTMATTER = "unsupported frontmatter"
UNKNOWN_HEADER = "unknown header"
INVALID_FRONTMATTER = "invalid frontmatter"

# Plain scalars that YAML 1.1 reads as something other than text.
_NOT_TEXT = (
    r"|~|null|Null|NULL",
    r"yes|Yes|YES|no|No|NO|true|True|TRUE|false|False|FALSE|on|On|ON|off|Off|OFF",
    r"[-+]?0b[0-1_]+|[-+]?0[0-7_]+|[-+]?(?:0|[1-9][0-9_]*)|[-+]?0x[0-9a-fA-F_]+",
    r"[-+]?[1-9][0-9_]*(?::[0-5]?[0-9])+(?:\.[0-9_]*)?",
    r"[-+]?[0-9][0-9_]*\.[0-9_]*(?:[eE][-+][0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?",
    r"[-+]?[0-9][0-9_]*(?::[0-5]?[0-9])+\.[0-9_]*",
    r"[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[Tt]|[ \t]+)[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]*)?"
    r"(?:[ \t]*(?:Z|[-+][0-9]{1,2}(?::?[0-9]{2})?))?",
)
_NOT_TEXT_REGEX = rf"\A(?:{'|'.join(_NOT_TEXT)})\z"
_SINGLE_QUOTED = r"\A'((?:[^']|'')*)'(?:[ \t]+#.*)?\z"
_DOUBLE_QUOTED = r'\A"([^"\\]*)"(?:[ \t]+#.*)?\z'
_NEEDS_YAML = r"\A(?:[\[\]{},&*!|>%@`]|[-?:](?:[ \t]|\z)|<<\z|=\z)|:(?:[ \t]|\z)"
_ID_LINE = r"(?md)^id[ \t]*:(?:[ \t]+(.*))?$"
_ID_GOES_ON = r"(?md)^id[ \t]*:[^\n]*\n(?:[ \t]*\n)*[ \t]+[^ \t\n#]"
_ODD_KEY = r"""(?md)^["'?{\[&!*<%|>]"""
_NOT_A_KEY = r"(?md)^(?![ \t#]|$)(?!.*:(?:[ \t]|$))"


def split_documents(documents: DataFrame, text: str) -> DataFrame:
    """Replace the text by ``_frontmatter`` (stripped) and ``_body``.

    The fences may stand anywhere, also inside a line. Without a second fence the frontmatter
    runs to the last character but one, and the body starts at the fourth character.
    """
    # ``locate`` takes no column as its start, so look in the rest after the first fence.
    source = unix_lines(F.col(text))
    opened = compute_once(documents, {"_text": source, "_first": F.locate(FENCE, source)}, drop=(text,))
    rest = F.substring(F.col("_text"), F.col("_first") + 4, F.length("_text"))
    closed = compute_once(opened, {"_rest": rest, "_second": F.locate(FENCE, rest)}, drop=("_first",))
    found = F.col("_second") > 0
    head_length = F.when(found, F.col("_second")).otherwise(F.length("_rest")) - 1
    body = F.when(found, F.substring(F.col("_rest"), F.col("_second") + 4, F.length("_rest"))).otherwise(
        F.substring(F.col("_text"), F.lit(4), F.length("_text"))
    )
    head = strip(F.substring(F.col("_rest"), F.lit(1), head_length))
    return compute_once(closed, {"_frontmatter": head, "_body": body}, drop=("_text", "_rest", "_second"))


def head_id(head: str) -> tuple[str | None, str | None]:
    """(id, reason) of frontmatter as PyYAML reads it; the id has to be text."""
    import yaml

    try:
        read = yaml.safe_load(head)
    except (yaml.YAMLError, ValueError, RecursionError):
        return None, INVALID_FRONTMATTER
    found = read.get("id") if isinstance(read, dict) else None
    return (found, None) if isinstance(found, str) else (None, INVALID_ID)


@F.pandas_udf(T.StructType([T.StructField("id", T.StringType()), T.StructField("reason", T.StringType())]))
def _head_ids(heads: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if head is None else head_id(head) for head in heads]
    return pd.DataFrame(rows, columns=["id", "reason"], dtype=object)


def _with_yaml(documents: DataFrame) -> DataFrame:
    """``read_ids``, and what that leaves undecided by PyYAML."""
    clear = read_ids(documents.withColumn("_head", F.col("_frontmatter")))
    unclear = F.col("_reason") == UNSUPPORTED_FRONTMATTER
    read = clear.withColumn("_yaml", _head_ids(F.when(unclear, F.col("_head"))))
    decided = {"_id": F.when(unclear, F.col("_yaml.id")).otherwise(F.col("_id")), "_reason": F.when(unclear, F.col("_yaml.reason")).otherwise(F.col("_reason"))}
    return compute_once(read, decided, drop=("_id", "_reason", "_head", "_yaml"))


def read_ids(documents: DataFrame) -> DataFrame:
    """Replace ``_frontmatter`` by ``_id`` and, where there is none, ``_reason``."""
    head = F.col("_frontmatter")
    lines = F.regexp_extract_all(head, F.lit(_ID_LINE), F.lit(1))
    value = F.btrim(F.try_element_at(lines, F.lit(-1)), F.lit(" \t"))  # the last duplicate counts
    unclear = head.rlike(_ID_GOES_ON) | head.rlike(_NOT_A_KEY)
    odd = head.rlike(_ODD_KEY)  # the id may have been given in another way
    valued = compute_once(documents, {"_value": value, "_odd": odd, "_unclear": unclear}, drop=("_frontmatter",))

    value = F.col("_value")
    plain = F.rtrim(F.regexp_replace(value, r"(?:\A|[ \t])#.*\z", ""), F.lit(" \t"))
    form = F.when(value.rlike(_SINGLE_QUOTED), "single").when(value.rlike(_DOUBLE_QUOTED), "double")
    form = form.when(~value.rlike("\\A['\"]"), "plain")
    formed = compute_once(valued, {"_plain": plain, "_form": form})

    plain, form = F.col("_plain"), F.col("_form")
    reason = (
        F.when(F.col("_odd"), UNSUPPORTED_FRONTMATTER)
        .when(value.isNull(), INVALID_ID)
        .when(F.col("_unclear") | form.isNull(), UNSUPPORTED_FRONTMATTER)
        .when((form == "plain") & plain.rlike(_NEEDS_YAML), UNSUPPORTED_FRONTMATTER)
        .when((form == "plain") & plain.rlike(_NOT_TEXT_REGEX), INVALID_ID)
    )
    found = (
        F.when(form == "single", F.replace(F.regexp_extract(value, _SINGLE_QUOTED, 1), F.lit("''"), F.lit("'")))
        .when(form == "double", F.regexp_extract(value, _DOUBLE_QUOTED, 1))
        .otherwise(plain)
    )
    return compute_once(formed, {"_id": found, "_reason": reason}, drop=("_value", "_odd", "_unclear", "_plain", "_form"))


def body_messages(body: Column) -> Column:
    """The sections of a body as messages; text before the first header is dropped."""
    sections = F.split(F.concat(F.lit("\n"), body), SECTION, -1)
    return F.transform(
        F.slice(sections, F.lit(2), F.size(sections)),
        lambda section: F.struct(
            F.lower(F.substring_index(section, "\n", 1)).alias("role"),
            strip(
                F.substring(
                    section,
                    F.length(F.substring_index(section, "\n", 1)) + 2,
                    F.length(section),
                )
            ).alias("content"),
        ),
    )


def parse_prompts(prompts: DataFrame, text: str = "text", strict: bool = False, yaml: bool = False) -> DataFrame:
    """Replace the ``text`` column by ``id``, ``messages`` and ``parse_error``.

    A document that cannot be read has NULL ``id`` and ``messages`` and a reason. An empty
    ``messages`` list means a container. With ``strict`` the first unreadable document that a
    task meets fails the job; nothing is run ahead of time for that. ``yaml`` lets PyYAML decide
    where the column expressions cannot, if it is there.
    """
    others = [name for name in prompts.columns if name != text]
    read = _with_yaml if yaml and find_spec("yaml") else read_ids
    documents = read(split_documents(prompts, text))
    cut = compute_once(documents, {"_messages": body_messages(F.col("_body"))}, drop=("_body",))
    bad_header = F.when(~known_roles(F.col("_messages")), UNKNOWN_HEADER)
    problem = F.coalesce(F.col("_reason"), bad_header)
    parsed = compute_once(cut, {"parse_error": problem}, drop=("_reason",))
    if strict:
        failure = F.raise_error(F.concat(F.lit("cannot parse a prompt: "), F.col("parse_error")))
        parsed = parsed.withColumn(
            "parse_error", F.when(F.col("parse_error").isNotNull(), failure.cast("string"))
        )
    readable = F.col("parse_error").isNull()
    return compute_once(
        parsed,
        {
            "id": F.when(readable, F.col("_id")),
            "messages": F.when(readable, F.col("_messages")),
        },
        drop=("_id", "_messages"),
    ).select(*others, "id", "messages", "parse_error")


def parse_errors(parsed: DataFrame) -> DataFrame:
    """The documents that could not be read."""
    return parsed.filter(F.col("parse_error").isNotNull()).drop("id", "messages")
