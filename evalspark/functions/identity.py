"""Content-hash identities and the columns derived from an id chain or a model name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import compute_once
from evalspark.functions.text import short_escapes, unicode_escapes
from evalspark.schemas import CHAIN_SEPARATOR


def messages_json(messages: Column) -> Column:
    """Messages as JSON text: keys in order, ``", "`` and ``": "`` between, ASCII only.

    Two passes, so that the escaped text is computed once per message and then reused.
    NULL when a message lacks its role or content, as no hash of it would be meaningful.
    """
    escaped = F.transform(
        messages,
        lambda m: F.struct(short_escapes(m["content"]).alias("content"), m["role"].alias("role")),
    )
    records = F.transform(
        escaped,
        lambda m: F.concat(
            F.lit('{"content": "'),
            unicode_escapes(m["content"]),
            F.lit('", "role": "'),
            m["role"],
            F.lit('"}'),
        ),
    )
    incomplete = F.exists(messages, lambda m: m["content"].isNull() | m["role"].isNull())
    return F.when(~incomplete, F.concat(F.lit("["), F.array_join(records, ", "), F.lit("]")))


def messages_hash(messages: Column) -> Column:
    """SHA-256 (hex) of the messages; equal prompts get equal hashes on any engine."""
    return F.sha2(messages_json(messages), 256)


def chain_text(id_chain: Column) -> Column:
    """``[a, b]`` as ``a::b``."""
    return F.array_join(id_chain, CHAIN_SEPARATOR)


def task_id(id_chain: Column, content_hash: Column) -> Column:
    """Identity of a task: where it is and what it says. An edited prompt is a new task."""
    return F.sha2(F.concat(chain_text(id_chain), F.lit(CHAIN_SEPARATOR), content_hash), 256)


def execution_id(task: Column, model: Column) -> Column:
    """Identity of one task run by one model; run settings are not part of it."""
    return F.sha2(F.concat(task, F.lit(CHAIN_SEPARATOR), model), 256)


def display_name(id_chain: Column) -> Column:
    """``[a, b]`` as ``a / b``."""
    return F.array_join(id_chain, " / ")


def short_model(model: Column) -> Column:
    """The part of a model name after its last slash."""
    return F.substring_index(model, "/", -1)


def name_or_id(name: Column, task: Column, length: int) -> Column:
    """The display name, or the first ``length`` characters of the id when it is missing or empty."""
    return F.coalesce(F.nullif(name, F.lit("")), F.left(task, F.lit(length)))


def message_count(messages: Column) -> Column:
    return F.size(messages)


def with_identity(tasks: DataFrame) -> DataFrame:
    """Add ``messages_hash``, ``task_id`` and ``display_name`` to (id_chain, messages) rows.

    The hash reads the whole prompt, so it is computed once and then only passed on.
    """
    hashed = compute_once(tasks, {"messages_hash": messages_hash(F.col("messages"))})
    return hashed.select(
        "*",
        task_id(F.col("id_chain"), F.col("messages_hash")).alias("task_id"),
        display_name(F.col("id_chain")).alias("display_name"),
    )
