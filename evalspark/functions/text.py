"""Text helpers on columns: trimming, line ends, JSON string escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that Python counts as white space (Spark's own trim takes blanks only).
WHITESPACE = "".join(chr(point) for point in range(0x3001) if chr(point).isspace())

# The two-character escapes of JSON, backslash first.
SHORT_ESCAPES = (
    ("\\", "\\\\"),
    ('"', '\\"'),
    ("\n", "\\n"),
    ("\r", "\\r"),
    ("\t", "\\t"),
    ("\b", "\\b"),
    ("\f", "\\f"),
)

_PRINTABLE = r"^[ -~]*\z"
_RUNS = "[ -~]+|[^ -~]+"


def strip(text: Column) -> Column:
    """Remove white space, Unicode included, at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def unix_lines(text: Column) -> Column:
    """Turn ``\\r\\n`` and lone ``\\r`` into ``\\n``."""
    return F.regexp_replace(text, "\r\n?", "\n")


def short_escapes(text: Column) -> Column:
    """Apply the two-character JSON escapes."""
    for raw, escaped in SHORT_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def unicode_escapes(text: Column) -> Column:
    """Write what is left outside printable ASCII as ``\\uXXXX``, in UTF-16 units.

    Works on runs, not on characters: the text is cut into stretches of printable ASCII and
    of anything else, and a whole stretch is turned into hex digits at once. Text without
    anything else takes the first branch.
    """
    runs = F.regexp_extract_all(text, F.lit(_RUNS), F.lit(0))
    written = F.transform(
        runs,
        lambda run: F.when(F.ascii(run).between(32, 126), run).otherwise(
            F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(.{4})", r"\\u$1")
        ),
    )
    return F.when(text.rlike(_PRINTABLE), text).otherwise(F.array_join(written, ""))
