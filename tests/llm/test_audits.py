"""Conversation repair, exact duplicates and the filter audit against plain versions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from evalspark.llm import conversations as conv
from evalspark.llm import exact, filter_audit
from evalspark.llm.queries import ORACLE, QUERIES
from tests.llm import brute_audits as plain

# exact duplicates


def test_fingerprints_compose():
    rng = random.Random(1)
    bases = next(exact.fresh_bases())
    for _ in range(50):
        data = rng.randbytes(rng.randint(0, 300))
        cut = rng.randint(0, len(data))
        a, b = data[:cut], data[cut:]
        whole = exact.fingerprint(data, bases)
        assert whole == exact.combine(exact.fingerprint(a, bases), exact.fingerprint(b, bases), len(b), bases)
        for value, base, modulus in zip(whole, bases, exact.MODULI, strict=True):
            horner = 0
            for byte in data:
                horner = (horner * base + byte) % modulus
            assert value == horner


def groups_of(found):
    return sorted(((r.doc_id, r.keep_id, r.first_id, r.group_size) for r in found), key=repr)


def one_kept_each(found, rows):
    kept = [r for r in found if r.kept]
    assert len(kept) == len({text or "" for _, text in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_groups(docs, rows):
    """Whole texts, texts in pieces of 700 bytes by several tasks, and tiny chunks and groups."""
    want = plain.exact(rows)
    for options in ({}, {"huge": 700}, {"chunk": 64, "fan_in": 2}):
        found = exact.exact_groups(docs, ["lang"], **options).collect()
        assert groups_of(found) == want
        one_kept_each(found, rows)
        assert all(r.lang == "en" for r in found)


def test_exact_groups_nulls_repeats_and_hot_texts(make_docs):
    copies = [(i, "the same text") for i in range(300)]
    rows = [(None, "the same text"), (None, None), (None, None), (7, ""), (1000, "x"), (1000, "x"), (1000, "y"), (1001, " x"), *copies]
    found = exact.exact_groups(make_docs(*rows), fan_in=3).collect()
    assert groups_of(found) == plain.exact(rows)
    one_kept_each(found, rows)
    assert exact.exact_groups(make_docs((1, "a")).limit(0)).count() == 0


def test_colliding_fingerprints_are_found_and_left(spark, make_docs):
    """With the base 1 a fingerprint is the sum of the bytes: anagrams collide, in one batch or in several."""
    rows = [(1, "abc"), (2, "bca"), (3, "abc"), (4, "cab"), (5, "other"), (6, "torhe"), (7, "same"), (8, "same")]
    weak, good = (1, 1), next(exact.fresh_bases())
    for parts in (1, 4):
        docs = make_docs(*rows).repartition(parts)
        prints = exact.fingerprints(docs, [], weak)
        classes = prints.groupBy("_length", "_print").agg(exact.F.sum("_lead").alias("_leads"))
        split = exact.collisions(docs, classes, weak, chunk=2, fan_in=2).collect()
        assert {r._length for r in split} == {3, 5}
        found = exact.exact_groups(docs, bases=[weak, good], chunk=2, fan_in=2).collect()
        assert groups_of(found) == plain.exact(rows)
    with pytest.raises(ValueError, match="collide"):
        exact.exact_groups(make_docs(*rows), bases=[weak])


# filter audit


def test_gray_walk_states():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, (32, 3))
    states = filter_audit.subset_states(counts)
    for subset in range(32):
        alive = [mask for mask in range(32) if not mask & subset]
        assert (states[subset] == counts[alive].sum(axis=0)).all()


def test_filter_audit(spark, make_docs, rows):
    loud = " ".join(f"w{i}" for i in range(60))
    more = [
        (100, loud, "en", "a"), (101, loud, "en", "b"), (102, loud + " #", "en", "a"), (103, loud.upper(), "en", None),
        (104, "same " * 60, "en", "b"), (105, "same " * 60, "en", "a"), (None, loud, "en", "a"), (None, None, "en", None),
        (106, None, "en", None), (106, None, "en", None), (101, loud, "en", "b"),
    ]
    table = [*((doc, text, "en", f"s{i % 2}") for i, (doc, text) in enumerate(rows)), *more]
    labels = [(100, 1, 0), (101, 1, 1), (101, 0, 0), (105, None, 1), (7, 1, None), (None, 1, 1), (12, 0, 1), (5, 1, 1)]
    marks = spark.createDataFrame([(*label, "x") for label in labels], "doc_id bigint, quality int, toxic int, part string")
    found = filter_audit.filter_audit(make_docs(*table), marks).collect()
    assert len(found) == len(set(found))
    want = plain.filter_audit([(doc, text, source) for doc, text, _, source in table], labels)
    assert {tuple(r) for r in found} == want
    empty = filter_audit.filter_audit(make_docs(*table).limit(0), marks)
    assert empty.count() == 0


# conversations


def random_rows(rng, n):
    """One conversation's (role initial, fault) rows as symbols."""
    return "".join(rng.choice("sssuuuaaaoSUAO--") for _ in range(n))


def costs_of(symbols):
    """Cost of the rest before each row and state, by plain recursion over rows."""
    rest = [0, 6, 3, 0]
    out = [rest]
    for symbol in reversed(symbols):
        rest = conv._closed([min(c for _, c, _ in conv._options(symbol, x, rest)) for x in range(4)])
        out.append(rest)
    return out[::-1]


def test_backward_vectors_and_resuming():
    rng = random.Random(2)
    resumed = 0
    for _ in range(200):
        symbols = random_rows(rng, rng.randint(0, 40))
        vectors = conv.backward(symbols, conv.END)
        for at, costs in enumerate(costs_of(symbols)):
            assert list(vectors[4 * at : 4 * at + 4]) == [c - min(costs) for c in costs]
        speculative = conv.backward(symbols, conv.SPECULATIVE)
        assert conv.backward(symbols, conv.END, speculative) == vectors
        resumed += speculative[:4] == vectors[:4]
    assert resumed > 100  # chunks converge within their own length


def conversations(spark, rows):
    full = [(*row, "x", 1) for row in rows]
    return spark.createDataFrame(full, "conv_id bigint, turn bigint, role string, text string, symbol string, row int").repartition(3)


def check_repair(spark, rows):
    found, turns = conv.repair(conversations(spark, rows))
    digest = {r._conv: r.repaired_sha256 for r in conv.digests(turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digest.get(r.conv_id, empty)) for r in found.collect()}
    rows = [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]
    assert got == plain.repair_report(rows)


def random_conversations(rng, lengths):
    rows = []
    for c, n in enumerate(lengths):
        for turn in range(n):
            role = rng.choice(["user", "assistant", "system", "tool", "user", "assistant", "", None])
            text = rng.choice(["Yes.", "No!", "what", "a b. ", "", " \n", None, f"t{rng.randint(0, 999)}?", f"x{rng.randint(0, 99)}"])
            rows.append((c if c else None, rng.choice([turn, turn, turn, None, turn + 5]), role, text))
    return rows


@pytest.mark.parametrize("chunk", [2, 7])
def test_repair_in_chunks(spark, monkeypatch, chunk):
    """Short chunks, so that long conversations need passes; null ids, turns, roles and texts, ties and repeats."""
    monkeypatch.setattr(conv, "LEAST_CHUNK", chunk)
    monkeypatch.setattr(conv, "MOST_CHUNKS", 1000)
    rng = random.Random(chunk)
    rows = random_conversations(rng, [9, 60, 1, 2, 30, 0, 5, 120, 12, 3])
    check_repair(spark, [*rows, *rows[5:20]])


def test_chunks_that_pass_costs_on(spark, monkeypatch):
    """Rows that must go, or of no known role, let the costs of the end through: one pass per chunk."""
    monkeypatch.setattr(conv, "LEAST_CHUNK", 3)
    gone = [(1, turn, "user", "") for turn in range(20)]
    tools = [(2, turn, "tool", f"t{turn}.") for turn in range(21)]
    check_repair(spark, [(1, -1, "system", "s."), *gone, (1, 30, "assistant", "a."), *tools])


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    """Its chunks are bounded in number, and lie in several tasks."""
    monkeypatch.setattr(conv, "LEAST_CHUNK", 4)
    monkeypatch.setattr(conv, "MOST_CHUNKS", 5)
    rng = random.Random(9)
    rows = [(1, turn, rng.choice(["user", "assistant"]), f"text {turn}.") for turn in range(400)] + random_conversations(rng, [3] * 20)
    cut = conv.chunks(conv.row_faults(conv.number_rows(conversations(spark, rows))), 400).collect()
    assert 5 <= sum(r.conv_id == 1 for r in cut) <= 5 + 8
    assert len({r.part for r in cut if r.conv_id == 1}) > 1
    check_repair(spark, rows)


def test_damage(spark):
    rng = random.Random(4)
    rows = random_conversations(rng, [40] * 12)
    got = sorted(map(tuple, conv.damaged(conversations(spark, rows)).collect()), key=repr)
    assert got == sorted(plain.damage(rows), key=repr)


def test_no_conversations(spark):
    found, turns = conv.repair(conversations(spark, [(1, 1, "user", "x")]).limit(0))
    assert found.count() == 0 and conv.digests(turns).count() == 0


# registered queries


def test_conversation_query(spark):
    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in given.collect()]
    want = plain.repair_report(plain.damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op11_conversation_repair"](spark, folder).collect()}
    assert got == {c: want.get(c, nothing) for c in {row[0] for row in rows}}


@pytest.mark.parametrize("name", ["op12_exact_dedup", "op13_filter_interaction_audit"])
def test_queries_against_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for table in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = QUERIES[name](spark, folder)
    cursor = connection.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLE[name]})")
    assert sorted(map(tuple, found.collect())) == sorted(cursor.fetchall())
