"""Schemas of the four tables, and the fixed vocabularies used with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Message roles, manual-grade scores, the separator of id chains.
ROLES = ("system", "assistant", "user")
SCORES = (0.0, 0.5, 1.0)
CHAIN_SEPARATOR = "::"


def _fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_TEXT, _FLAG, _NUMBER, _TIME = T.StringType(), T.BooleanType(), T.DoubleType(), T.TimestampNTZType()

MESSAGE = _fields(role=_TEXT, content=_TEXT)
MESSAGES = T.ArrayType(MESSAGE)

# JSON travels as text: its values have mixed types.
VALIDATION = _fields(
    passed=_FLAG, score=_NUMBER, reason=_TEXT, metadata=_TEXT, pending=_FLAG, rubric=_TEXT
)

TASK_SOURCE = _fields(
    path=_TEXT,
    id_chain=T.ArrayType(_TEXT),
    messages=MESSAGES,
    has_validator=_FLAG,
    messages_hash=_TEXT,
    task_id=_TEXT,
    display_name=_TEXT,
)

TASKS = _fields(
    task_id=_TEXT,
    id_chain=T.ArrayType(_TEXT),
    display_name=_TEXT,
    path=_TEXT,
    messages_hash=_TEXT,
    created_at=_TIME,
    updated_at=_TIME,
)

TASK_RUNS = _fields(
    execution_id=_TEXT,
    task_id=_TEXT,
    messages_hash=_TEXT,
    model=_TEXT,
    output=_TEXT,
    duration_ms=_NUMBER,
    error=_TEXT,
    validation_passed=_FLAG,
    validation_score=_NUMBER,
    validation_reason=_TEXT,
    validation_metadata=_TEXT,
    validation_pending=_FLAG,
    validation_rubric=_TEXT,
    run_config=_TEXT,
    created_at=_TIME,
)

SCHEMA_VERSION = _fields(version=_TEXT, applied_at=_TIME)

# ``position`` is the catalogue order; a later entry wins a shared alias.
MODELS = _fields(position=T.IntegerType(), model=_TEXT, enum_name=_TEXT)


class SchemaError(ValueError):
    """A DataFrame lacks a column of the table it is used as, or has another type there."""


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``: same columns, same order, same types, or SchemaError."""
    actual = {field.name: field.dataType for field in df.schema.fields}
    problems = [
        f"{field.name}: expected {field.dataType.simpleString()}, "
        f"got {actual[field.name].simpleString() if field.name in actual else 'no column'}"
        for field in schema.fields
        if field.name not in actual or not _same_type(actual[field.name], field.dataType)
    ]
    if problems:
        raise SchemaError("; ".join(problems))
    return df.select(*schema.fieldNames())


def _same_type(left: T.DataType, right: T.DataType) -> bool:
    """Type equality that ignores nullability."""
    return left.simpleString() == right.simpleString()


def known_roles(messages: Column) -> Column:
    """True when every message has one of the allowed roles."""
    return F.forall(messages, lambda m: m["role"].isin(*ROLES))
