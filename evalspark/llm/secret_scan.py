"""Secret scans through an inverted index of trigrams.

Every rule is a regular expression. From its syntax tree a Boolean query of trigrams that any
match must contain is derived: an OR of clauses, each an AND of trigrams, over text with A-Z in
lower case. The postings (trigram, document) of all queried trigrams are intersected per clause
by grouping; the documents left are candidates, and only for them the rule's expression runs. A
rule without a mandatory trigram (plain hexadecimal runs) scans every text. The index only spares
work; what is found is decided by the expressions, over whole texts. DataFrame functions only.

Rules are fixed before the run, so clauses and trigrams are bounded by them; postings have at
most one row per document and queried trigram and are never grouped by trigram, so that a
trigram of all documents is no hot key.

Null texts are empty, without spans. Repeated rows of a doc_id are scanned each for itself; null
ids are kept.
"""

from __future__ import annotations

from itertools import product
from re import _constants as sre  # the syntax tree of Python's own expressions
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.columns import compute_once
from evalspark.llm.common import ascii_lower, read, stored


class Rule(NamedTuple):
    """A kind of secret; a match counts if the text of ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed by the contract, in this order.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    # runs are taken whole by + already, so a least length can stand in the expression
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Public formats of well-known credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("address", r"(?:https?|ftp|postgres|mysql|redis|amqp)://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
RULES = BASE + MORE
#: Sets of strings or clauses that grow beyond this are given up, which only weakens a query.
MOST = 64
Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])


def _least(clauses: Clauses) -> Clauses:
    """Without clauses that need all that another needs."""
    return frozenset(c for c in clauses if not any(other < c for other in clauses))


def _both(left: Clauses, right: Clauses) -> Clauses:
    merged = _least(frozenset(a | b for a, b in product(left, right)))
    return merged if len(merged) <= MOST else left


def _of_strings(strings: set[str]) -> Clauses:
    cut = lambda text: frozenset(text[i : i + 3] for i in range(len(text) - 2))
    return _least(frozenset(cut(text) for text in strings))


def _node(op, value) -> tuple[set[str] | None, Clauses]:
    """(all strings the node can be, or None; what a match of it needs)."""
    if op is sre.LITERAL:
        return {chr(value).lower()}, ANY
    if op is sre.IN and all(kind is sre.LITERAL for kind, _ in value) and len(value) <= 8:
        return {chr(code).lower() for _, code in value}, ANY
    if op is sre.SUBPATTERN:
        return _sequence(value[3])
    if op is sre.BRANCH:
        parts = [_sequence(part) for part in value[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*(strings for strings, _ in parts)), ANY
        needs = frozenset().union(*(_of_strings(s) if s is not None else n for s, n in parts))
        return None, _least(needs)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, item = value
        strings, needs = _sequence(item)
        if low == 0:
            return (strings | {""} if high == 1 and strings is not None else None), ANY
        if low == high == 1:
            return strings, needs
        return None, needs if strings is None else _of_strings(strings)
    return None, ANY


def _sequence(nodes) -> tuple[set[str] | None, Clauses]:
    run, needs, exact = {""}, ANY, True
    for op, value in nodes:
        strings, own = _node(op, value)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a, b in product(run, strings)}
            continue
        exact = False
        needs = _both(_both(needs, _of_strings(run)), own)
        run = {""} if strings is None else strings
    return (run, ANY) if exact else (None, _both(needs, _of_strings(run)))


def trigram_query(pattern: str) -> list[list[str]]:
    """An OR of ANDs of trigrams; empty if some match may have no mandatory trigram."""
    strings, needs = _sequence(_parser.parse(pattern))
    clauses = _least(_of_strings(strings) if strings is not None else needs)
    return [] if frozenset() in clauses else sorted(sorted(clause) for clause in clauses)


def _clauses(spark: SparkSession, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(clause, kind, trigram, size); one row per trigram of a clause."""
    rows, number = [], 0
    for kind, clauses in queries.items():
        for clause in clauses:
            number += 1
            rows += [
                F.struct(F.lit(number).alias("clause"), F.lit(kind).alias("kind"), F.lit(gram).alias("trigram"), F.lit(len(clause)).alias("size"))
                for gram in clause
            ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(trigram, doc_id): which of the trigrams each text has, in lower case."""
    lower = compute_once(docs.select("doc_id", "text"), {"lower": ascii_lower(F.col("text"))}, ("text",))
    has = F.filter(F.array(*[F.lit(gram) for gram in grams]), lambda gram: F.contains("lower", gram))
    return lower.select("doc_id", F.explode(has).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query a document satisfies."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    grams = sorted({gram for clauses in queries.values() for clause in clauses for gram in clause})
    if not grams:
        return docs.select("doc_id", F.array().cast("array<string>").alias("kinds")).limit(0)
    clauses = _clauses(docs.sparkSession, queries)  # as many rows as the rules have trigrams
    met = postings(docs, grams).distinct().join(F.broadcast(clauses), "trigram")
    met = met.groupBy("doc_id", "clause").agg(
        F.count("*").alias("n"), F.first("size").alias("size"), F.first("kind").alias("kind")
    )
    return met.where("n = size").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _pieces(rule: Rule, place: int, wanted: Column) -> dict[str, Column]:
    """What lies between the matches, the matches, and the texts that are measured."""
    find = lambda group: F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(group))
    none = F.array().cast("array<string>")
    return {
        f"between{place}": F.when(wanted, F.split("text", rule.pattern, -1)).otherwise(none),
        f"match{place}": F.when(wanted, find(0)).otherwise(none),
        f"value{place}": F.when(wanted, find(rule.group)).otherwise(none) if rule.group else none,
    }


def _spans(rule: Rule, place: int) -> Column:
    """(start, place, end) of the matches that count, in code points from 0."""
    between, match, value = f"between{place}", f"match{place}", f"value{place}"
    kind = "struct<at:int,spans:array<struct<start:int,place:int,end:int,size:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,place:int,end:int,size:int>>").alias("spans"))

    def add(done: Column, i: Column) -> Column:
        begin = done["at"] + F.length(F.get(between, i))
        end = begin + F.length(F.get(match, i))
        size = F.length(F.get(value if rule.group else match, i))
        span = F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"), size.alias("size"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans")).cast(kind)

    steps = F.when(F.size(match) > 0, F.sequence(F.lit(0), F.size(match) - 1)).otherwise(F.array().cast("array<int>"))
    spans = F.aggregate(steps, start.cast(kind), add, lambda done: done["spans"])
    counted = F.filter(spans, lambda span: span["size"] >= rule.least)
    return F.transform(counted, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end")))


def scan(docs: DataFrame, *kept: Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text, *kept, spans): per row of ``docs`` its (start, place of the rule, end), sorted."""
    found = stored(candidates(docs, rules), "candidates").select(F.col("doc_id").alias("candidate"), "kinds")
    names = [f"kept{i}" for i in range(len(kept))]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[c.alias(n) for c, n in zip(kept, names, strict=True)])
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["candidate"]), "left")
    pieces = {}
    for place, rule in enumerate(rules):
        wanted = F.array_contains("kinds", rule.kind) if trigram_query(rule.pattern) else F.col("text").rlike(rule.pattern)
        pieces |= _pieces(rule, place, F.coalesce(wanted, F.lit(False)))
    rows = compute_once(rows, pieces, ("candidate", "kinds"))
    spans = F.sort_array(F.concat(*[_spans(rule, place) for place, rule in enumerate(rules)]))
    return compute_once(rows, {"spans": spans}, tuple(pieces))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    kind = "struct<at:int,done:string>"

    def add(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        more = F.concat(state["done"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(fresh, more).otherwise(state["done"]).alias("done")).cast(kind)

    return F.aggregate(spans, start.cast(kind), add, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced, all columns as they came; n_chars follows."""
    others = [name for name in docs.columns if name != "text"]
    found = scan(docs, docs["text"].isNull(), *[docs[name] for name in others], rules=rules)
    hit = F.size("spans") > 0
    clean = F.when(hit, redacted(F.col("text"), F.col("spans"))).when(~F.col("kept0"), F.col("text"))
    found = compute_once(found, {"clean": clean}, ("text",))
    columns = {name: F.col(f"kept{at}") for at, name in enumerate(others, 1)} | {"text": F.col("clean")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(hit, F.length("clean").cast("long")).otherwise(columns["n_chars"])
    return found.select(*[columns[name].alias(name) for name in docs.columns])


def _named(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"].cast("string"), s["end"].cast("string"))))


def op10_secret_scan(spark, folder: str) -> DataFrame:
    found = scan(read(spark, folder, "documents"))
    count = lambda place: F.size(F.filter("spans", lambda s: s["place"] == place)).cast("long")
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    return found.select(
        "doc_id", *[count(i).alias(f"n_{rule.kind}") for i, rule in enumerate(BASE)],
        F.sha2(_named(base, RULES), 256).alias("base_sha256"), _named(F.col("spans"), RULES).alias("spans"),
    )
