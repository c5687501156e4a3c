"""Glob patterns on id chains, compiled once on the driver into one regular expression.

Without ``**`` a pattern is matched against the whole ``a::b::c`` text, so ``*`` also runs
across ``::``. With ``**`` it is matched segment by segment, ``**`` standing for any number
of segments and ``*`` staying inside one. Matching is case-sensitive. Both forms end up as
a single ``rlike``, which stays inside generated code and can be pushed around by Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.identity import chain_text
from evalspark.schemas import CHAIN_SEPARATOR

ANY_DEPTH = "**"
_END = "\0"  # ends a segment; cannot occur in an id


def _point(char: str) -> str:
    """One literal character, written so that no regex syntax can be meant by it."""
    return char if char.isalnum() and char.isascii() else f"\\x{{{ord(char):x}}}"


def _members(body: str) -> list[tuple[str, str]]:
    """The ranges of a bracket expression; a reversed range has no members and is left out."""
    ranges, at = [], 0
    while at < len(body):
        is_range = body[at + 1 : at + 2] == "-" and at + 2 < len(body)
        low, high = body[at], body[at + 2] if is_range else body[at]
        if low <= high:
            ranges.append((low, high))
        at += 3 if is_range else 1
    return ranges


def _bracket(body: str, wildcard: str) -> str:
    negated = body.startswith("!")
    ranges = _members(body[1:] if negated else body)
    if not ranges:
        return wildcard if negated else "(?!)"
    listed = "".join(_point(a) if a == b else f"{_point(a)}-{_point(b)}" for a, b in ranges)
    if not negated:
        return f"[{listed}]"
    return f"(?:(?=[^{listed}]){wildcard})"


def _pieces(glob: str, wildcard: str) -> Iterator[str]:
    at = 0
    while at < len(glob):
        char, at = glob[at], at + 1
        if char == "*":
            yield f"{wildcard}*"
        elif char == "?":
            yield wildcard
        elif char == "[":
            # A closing bracket right after the opening one (or after "!") is a member.
            first = at + 1 if glob[at : at + 1] == "!" else at
            close = glob.find("]", first + 1)
            if close < 0:
                yield _point("[")
            else:
                yield _bracket(glob[at:close], wildcard)
                at = close + 1
        else:
            yield _point(char)


def glob_regex(glob: str, wildcard: str = ".") -> str:
    """The regular expression of one glob; ``wildcard`` is what ``?`` may stand for."""
    return "".join(_pieces(glob, wildcard))


def whole_text_regex(pattern: str) -> str:
    return rf"(?s)\A{glob_regex(pattern)}\z"


def segment_regex(pattern: str) -> str:
    inside = r"[^\x00]"
    steps = (
        rf"(?:{inside}*\x00)*" if part == ANY_DEPTH else rf"{glob_regex(part, inside)}\x00"
        for part in pattern.split(CHAIN_SEPARATOR)
    )
    return rf"(?s)\A{''.join(steps)}\z"


def matches(id_chain: Column, pattern: str) -> Column:
    """True where the id chain matches the pattern."""
    text = chain_text(id_chain)
    if pattern == ANY_DEPTH:
        return F.lit(True)
    if ANY_DEPTH not in pattern:
        return text.rlike(whole_text_regex(pattern))
    segments = F.concat(F.replace(text, F.lit(CHAIN_SEPARATOR), F.lit(_END)), F.lit(_END))
    return segments.rlike(segment_regex(pattern))


def matches_any(id_chain: Column, patterns: Sequence[str]) -> Column:
    """True where any pattern matches; with no patterns, everywhere."""
    if not patterns:
        return F.lit(True)
    return reduce(Column.__or__, (matches(id_chain, pattern) for pattern in patterns))
