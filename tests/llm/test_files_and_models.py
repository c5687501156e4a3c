"""Packing, captures, token counts, token files, the language model and the pipeline."""

from __future__ import annotations

import gzip
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from evalspark.llm import language_model as lm
from evalspark.llm import packing, token_counts, token_files, warc
from evalspark.llm.elias_fano import EliasFano, pack, unpack
from evalspark.llm.vocabulary import load, public_path
from tests.llm import brute


# packing


def test_bins_take_the_tightest_compatible_bin():
    for trial in range(100):
        rng = random.Random(trial)
        capacity = rng.choice([10, 50, 128])
        bins, simple = packing.Bins(capacity), []
        for size in sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 120))), reverse=True):
            source, cluster = rng.choice([0, 1, 1, 1, 2, 4]), rng.choice([0, 0, 1, 2])
            number, offset = bins.place(size, source, cluster)
            fits = [capacity - f for f, s, c in simple if capacity - f >= size and not s & source and not c & cluster and f < capacity]
            if fits:
                fill, sources, clusters = simple[number]
                assert capacity - fill == min(fits) and not sources & source and not clusters & cluster and offset == fill
                simple[number] = fill + size, sources | source, clusters | cluster
            else:
                assert (number, offset) == (len(simple), 0)
                simple.append((size, source, cluster))


def test_packing_keeps_everything_and_separates(docs, rows, make_docs):
    found = packing.pack(docs, capacity=100, shard=25).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    text = dict(rows)
    words = Counter()
    bins = defaultdict(list)
    for r in found:
        words[r.doc_id] += r.n_words
        if r.bin is None:
            assert not brute.WORD.findall(text[r.doc_id] or "")
        else:
            bins[r.shard, r.bin].append(r)
    assert words == {doc: len(brute.WORD.findall(t or "")) for doc, t in rows}
    for inside in bins.values():
        inside.sort(key=lambda r: r.offset)
        assert inside[-1].offset + inside[-1].n_words <= 100
        assert all(a.offset + a.n_words == b.offset for a, b in zip(inside, inside[1:], strict=False))
        assert len({source[r.doc_id] for r in inside}) == len(inside) == len({text[r.doc_id] for r in inside})
    odd = make_docs((1, "a b", "en", None), (1, "a b", "en", None), (None, "c", "en", None), (3, None, None, None))
    got = packing.pack(odd).collect()
    assert len(got) == 4 and len({(r.shard, r.bin) for r in got if r.doc_id == 1}) == 2
    assert packing.pack(odd.limit(0)).count() == 0
    same = packing.pack(make_docs(*[(None, "a b", "en", f"s{i}") for i in range(600)]), shard=20).groupBy("shard").count()
    assert max(r["count"] for r in same.collect()) < 60


# captures


def test_derivatives(spark, tmp_path):
    page = (
        '<!DOCTYPE html><html lang="en"><head><title>A &amp;\n B</title><style>p{}</style><script>var t="</p>";</script></head>'
        '<body><!-- <a href="/no">no</a> --><p>One <b>two</b>&nbsp;&lt;3</p><a href="/x?a=1&amp;b=2">x</a><A HREF=y>y</a><a href="/x?a=1&amp;b=2">z</a></body>'
    )
    pages = spark.createDataFrame(
        [(1, "http://h.org/d/", page, "x"), (2, None, None, "x"), (3, "not a url", "<p>open <script>gone", "x"), (3, "not a url", "<p>open <script>gone", "x")],
        "page_id bigint, url string, html string, record string",
    )
    sources = {r.page_id: r for r in warc.responses(pages).collect()}
    found = warc.derive(warc.responses(pages))
    rows = defaultdict(dict)
    for r in found.collect():
        rows[r.page_id][r.warc_type] = r
    assert found.count() == 8 and set(rows) == {1, 2, 3}
    assert rows[1]["conversion"].block == "One two <3\nxyz"
    fields = rows[1]["metadata"].block.split("\r\n")
    assert fields == [
        f"payload-digest: {sources[1].payload_digest}", "title: A & B", "language: en", "source-header: Content-Type: text/html; charset=utf-8",
        "outlink: http://h.org/x?a=1&b=2", "outlink: http://h.org/d/y", "",
    ]
    assert rows[1]["metadata"].n_links == 2 and rows[3]["conversion"].block == "open" and rows[2]["conversion"].block == ""
    assert sources[1].payload_digest == warc.digest(page.encode())
    warc.write_warc(found.where("page_id < 3").coalesce(1), f"file://{tmp_path}/out")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "out").glob("*.gz"))
    records = []
    while data:  # a plain reader: header lines, blank line, as many bytes as Content-Length says, two line ends
        head, _, data = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        assert lines[0] == "WARC/1.1" and data[size : size + 4] == b"\r\n\r\n"
        assert warc.digest(data[:size]) == fields["WARC-Block-Digest"]
        records.append(fields)
        data = data[size + 4 :]
    assert len(records) == 4 and len({r["WARC-Record-ID"] for r in records}) == 4
    assert {r["WARC-Refers-To"] for r in records} == {sources[1].record_id, sources[2].record_id}
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


# tokens


@pytest.fixture(scope="module")
def vocabulary():
    return public_path(token_counts.VOCABULARY)


def test_prefix_counts_are_exact(vocabulary, rows):
    tokenizer = load(vocabulary)
    rng = random.Random(1)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "'", "'re", "'ll", "s", "é", "日本", "12", "!", "%%%", "　", "\x1c", "\x85", "😀", "<|endoftext|>", "<|endo", "A", "\r\n", "--", "==="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    texts += [(text or "")[:80] for _, text in rows]
    for text, index in zip(texts, token_counts.prefix_index(texts, vocabulary), strict=True):
        want = [len(e.ids) for e in tokenizer.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]
        packed = zstandard.compress(index)
        assert token_counts.unpack(packed).tolist() == want
        for budget in (0, 3, 100):
            assert token_counts.longest_within(packed, budget) == max(i for i, n in enumerate(want) if n <= budget)
        assert token_counts.tokens_of_prefix(packed, 5) == want[min(5, len(text))]


def test_token_counts_and_files(spark, docs, rows, vocabulary, tmp_path):
    tokenizer = load(vocabulary)
    ids = {doc: tokenizer.encode(text or "", add_special_tokens=False).ids for doc, text in rows}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_index(docs, vocabulary).collect()}
    assert counts == {doc: (len((text or "").encode()), len(ids[doc])) for doc, text in rows}
    folder = f"file://{tmp_path}/ids"
    token_files.write_token_files(docs, vocabulary, folder)
    found = {r.doc_id: r for r in token_files.read_token_files(spark, folder).collect()}
    start = 0
    for doc in sorted(ids):
        want = np.array([*ids[doc], 0], "<u4")
        r = found[doc]
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r["ids"])) == (start, len(want), zlib.crc32(want.tobytes()), want.tobytes())
        start += len(want)


def test_token_files_edge_cases(spark, make_docs, vocabulary, tmp_path):
    docs = make_docs((2, "b"), (2, "b"), (None, None), (1, ""))
    for name, table, want in (("odd", docs, [(None, 0, 1), (1, 1, 1), (2, 2, 2), (2, 4, 2)]), ("none", docs.limit(0), [])):
        token_files.write_token_files(table, vocabulary, f"file://{tmp_path}/{name}")
        found = token_files.read_token_files(spark, f"file://{tmp_path}/{name}").orderBy("start")
        assert [(r.doc_id, r.start, r.n_tokens) for r in found.collect()] == want


def test_token_ids_of_any_characters(vocabulary, monkeypatch):
    tokenizer, rng = load(vocabulary), random.Random(3)
    parts = ["a", "Z", "the", " word", " ciónrr", "é", "×", "÷", "ß", "'", "'s", "#'s", "'ll", "0", "28", "²", "٣", ",", "-", "(", "|", "$$", "“", "’", "日本", "😀", "́", "ʰ"]
    parts += [" ", " ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x00", "\x7f", "\x85", "\xa0", "\u2003", "\u3000", "\u200b"]
    parts += ["<|endoftext|>", "<|endof", "text|>", "<|endoftext|<|endoftext|>", "x" * 80]
    token_files._memory(vocabulary).forget()
    monkeypatch.setattr(token_files, "ROW", 3)
    monkeypatch.setattr(token_files, "REMEMBERED", 2_000)
    for _ in range(60):
        texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 2, 5, 60]))) for _ in range(60)]
        ids, ends = token_files._encode_texts(vocabulary, [text.encode() for text in texts], 0)
        found = [part.tolist() for part in np.split(ids, ends)]
        assert found == [[*e.ids, 0] for e in tokenizer.encode_batch(texts, add_special_tokens=False)] + [[]]
        known = token_files._memory(vocabulary)
        assert len(known.numbers) == len(known.sizes) and known.sizes.sum() == len(known.ids) and max(map(len, known.numbers)) <= token_files.LONGEST


def test_words_meet_the_library_once_whatever_follows(vocabulary, monkeypatch):
    given, encode = [], token_files._encode_units
    monkeypatch.setattr(token_files, "_encode_units", lambda tokenizer, lengths, units: given.extend(units) or encode(tokenizer, lengths, units))
    words = [f" zq{a}{b}xé" for a in "abcdefgh" for b in "klmnopqr"]
    text = "".join(word + mark for mark in ("", ",", ".", "###", "7", "'s", " |") for word in words)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    (out,) = token_files._tokenize(vocabulary, 0)(iter([batch]))
    ids = [*load(vocabulary).encode(text, add_special_tokens=False).ids, 0]
    assert np.frombuffer(out.column("ids")[0].as_py(), "<u2").tolist() == ids and out.column("n_ids").to_pylist() == [len(ids)]
    assert len(given) <= len(words) + 6


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rng = random.Random(4)
    for _ in range(30):
        counts = np.array([rng.randint(1, 10 ** rng.randint(1, 6)) for _ in range(rng.randint(2, 300))])
        lengths = token_files.code_lengths(counts, 40)
        heap, cost = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert (lengths * counts).sum() == cost
        limited = token_files.code_lengths(counts, 9)
        assert limited.max() <= 9 and (0.5**limited).sum() <= 1
        code = token_files.Code(list(range(len(counts))), token_files.code_lengths(counts).tolist())
        sizes = np.array([0, 1, 700, 5, 1500])
        ids = np.array(rng.choices(range(len(counts)), counts.tolist(), k=int(sizes.sum())))
        payloads, marks = code.encode(ids, sizes)
        assert (code.decode(payloads, marks, sizes) == ids).all()


# language model


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, universe in [(0, 1), (1, 1), (5, 10), (1000, 1 << 64), (1000, 1001), (5000, 100), (3000, 1 << 40)]:
        values = np.sort(rng.integers(0, min(universe, (1 << 64) - 1), n, dtype=np.uint64))
        sequence = unpack(pack({"a": EliasFano.of(values, universe)}, {}))[0]["a"]
        wanted = np.concatenate([rng.integers(0, universe - 1, 500, dtype=np.uint64, endpoint=True), values])
        assert (sequence.successor(wanted) == np.searchsorted(values, wanted)).all()
        assert not n or (sequence.values(np.arange(n)) == values).all()


def plain_scores(rows):
    tokens = {doc: [*(text or "").encode().lower().split(), None] for doc, text in rows}
    count, pairs, after = Counter(), Counter(), defaultdict(set)
    for doc, words in tokens.items():
        if zlib.crc32(str(doc).encode()) % 5 != 1:
            count.update(words)
            for a, b in zip([None, *words], words, strict=False):
                pairs[a, b] += 1
                after[a].add(b)
    total, kinds, out = sum(count.values()), len(count), {}
    for doc, words in tokens.items():
        base = [(count[w] + 0.5) / (total + 0.5 * (kinds + 1)) for w in words]
        score = 0.0
        for a, b, p in zip([None, *words], words, base, strict=False):
            n = count[a]
            score += math.log10(max(0, pairs[a, b] - 0.75) / n + 0.75 * len(after[a]) / n * p if n else p)
        known = sum(count[w] > 0 for w in words)
        out[doc] = (zlib.crc32(str(doc).encode()) % 5 == 1, len(words), known, total, sum(map(math.log10, base)), score)
    return out


@pytest.mark.parametrize("heavy", [lm.HEAVY, 4])
def test_language_model(docs, rows, monkeypatch, heavy):
    monkeypatch.setattr(lm, "HEAVY", heavy)
    monkeypatch.setattr(lm, "BATCH_TOKENS", 500)
    scores, model = lm.train_and_score(docs)
    want = plain_scores(rows)
    got = {r[0]: tuple(r)[1:] for r in scores.collect()}
    assert set(got) == set(want)
    for doc, (held, n, known, total, base, score) in want.items():
        assert got[doc][:4] == (held, n, known, total) and got[doc][4] == pytest.approx(base)
        assert score - 0.03 * n <= got[doc][5] <= score + 1e-6  # a byte rounds down by at most 6.6 %
    assert model.count() >= 1


def test_language_model_probabilities_sum_to_one():
    """Over the vocabulary and one unknown word, up to what the bytes round down."""
    codes = lm.quantised(np.array([1.0, 0.5, 1e-3, 1e-6, 1e-9]))
    assert (lm.CODEBOOK[codes[:4]] <= np.array([1.0, 0.5, 1e-3, 1e-6]) * (1 + 1e-6)).all() and codes[0] == 255


def test_language_model_edge_cases(make_docs):
    docs = make_docs((None, None), (1, ""), (2, "a b"), (2, "a b"))
    assert lm.train_and_score(docs)[0].count() == 4
    assert lm.train_and_score(docs.limit(0))[0].count() == 0


# pipeline


def test_pipeline(spark, tmp_path, make_docs, rows):
    import corpus_pipeline

    items = [(1, " ".join(dict(rows)[30].split()[:13] or ["x"]))]
    folder = str(tmp_path)
    make_docs(*rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    left = {doc: text for doc, text in rows if not brute.quality_counts(text)[-1]}
    left = {doc: left[doc] for doc, (_, first) in brute.simhash(list(left.items())).items() if doc == first}
    left = {doc: left[doc] for doc, found in brute.contamination(list(left.items()), items).items() if not found[-1]}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema = docs.schema
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.schema.names == schema.names
    assert {r.doc_id for r in docs.collect()} == set(left)
    found = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()
    assert {r.doc_id for r in found} == set(left)


def test_pipeline_loses_no_document(spark, tmp_path, make_docs):
    """Null and repeated ids: ids, redacted texts and bins against plain versions of all stages."""
    import corpus_pipeline

    rng = random.Random(3)
    folder = str(tmp_path)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(n))
    bad, clean, other, secret = text(13), text(40), text(50), text(20) + ' token = "abcdefghijklmnop" ' + text(9)
    long = text(2500)
    table = [(1, clean), (1, other), (1, other), (2, clean), (None, secret), (None, text(15)), (None, bad + " x"), (5, bad), (6, "too short"), (6, long)]
    docs = [(doc, body, "en", None if i % 2 else f"s{i}") for i, (doc, body) in enumerate(table)]
    make_docs(*docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(9, bad)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = [(1, clean), (1, other), (None, secret), (None, table[5][1]), (6, long)]
    given = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        given = stage(spark, given, folder)
    redacted = [(doc, body.replace('token = "abcdefghijklmnop', "[secret]")) for doc, body in kept]
    assert sorted(((r.doc_id, r.text) for r in given.collect()), key=repr) == sorted(redacted, key=repr)
    found = corpus_pipeline.run(spark, folder).collect()
    sizes = Counter()
    for r in found:
        sizes[r.doc_id] += r.n_words
    want = Counter()
    for doc, body in redacted:
        want[doc] += len(brute.WORD.findall(body))
    assert sizes == want
    assert sorted(r.n_words for r in found if r.doc_id == 6) == [452, 1024, 1024]
    for place in {(r.shard, r.bin) for r in found}:
        inside = sorted((r.offset, r.n_words) for r in found if (r.shard, r.bin) == place)
        assert sum(n for _, n in inside) <= packing.CAPACITY
        assert all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:], strict=False))
