"""A word bigram model in sharded Elias-Fano tries, trained and queried by Spark.

Texts are tokenized once into batches of about ``BATCH_TOKENS`` tokens, kept in shared storage. A
batch sends to every shard what it has of the shard's contexts: the contexts (words, by hash), their
training counts, and the distinct words that follow them with theirs, so that even the most
frequent words are combined before they move. A shard makes a trie of the training part:

* first level: its contexts in order, with monotone pointers to where their successors begin;
* second level: for every context its successors, as numbers of the shard's successor vocabulary
  relative to the context, and the smoothed probability of each, quantised to a byte.

All levels but the bytes are Elias-Fano sequences, written to an unnamed file and mapped into memory.
The n-grams of the batches are looked up by successor search in the range of their context, and the
answers go back to their batches. The probability of a word w after h is interpolated absolute
discounting, (c(h,w) - D) / c(h) + D t(h) / c(h) p(w), with t(h) distinct successors of h in
training and p(w) the add-one-half estimate of the base score. Quantisation rounds down, so the
probabilities after a context sum to no more than one.

A context that is frequent in all of the corpus would fill its shard. Words with at least one in
``HEAVY`` of the training tokens, so at most ``HEAVY`` of them, are counted first and their
successors spread over all shards by hash; how many each has is summed over the shards. Shards are as many as keep each near ``SHARD_TOKENS``.

Words are told apart by 64-bit hashes. Null and empty texts are the end token alone; a null doc_id
is the empty text. Repeated rows are scored each for itself.
"""

from __future__ import annotations

import mmap
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import read, stored, tasks_for, word_blocks
from evalspark.llm.elias_fano import EliasFano, pack, unpack

DISCOUNT = 0.75
FOLDS, HELD_OUT = 5, 1
BATCH_TOKENS, SHARD_TOKENS, HEAVY = 1_000_000, 3_000_000, 512
#: The end of a text, also the context of its first word; no word has a blank in it.
END = xxhash.xxh64_intdigest(b" end ")
#: Code 0: not in the model; code k: the probability 10 ** (-DECADES * (255 - k) / 254).
DECADES = 7.0
U64 = np.uint64


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def quantised(values: np.ndarray) -> np.ndarray:
    """The largest code whose probability is not above the value; at least 1."""
    codes = 255 + np.floor(np.log10(values) * (254 / DECADES) + 1e-9)
    return np.clip(codes, 1, 255).astype(np.uint8)


CODEBOOK = np.concatenate([[0.0], 10.0 ** (-DECADES * (255 - np.arange(1, 256)) / 254)])


def _zip(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pack({}, {f"a{i}": a for i, a in enumerate(arrays)}))


def _unzip(data: bytes) -> list[np.ndarray]:
    return list(unpack(zstandard.ZstdDecompressor().decompress(data))[1].values())


BATCHES = "batch bigint, doc_ids array<{}>, n_tokens bigint, n_train bigint, words binary, tokens binary"


def _codes(text: bytes) -> np.ndarray:
    """The words' hashes and the end."""
    parts = [np.fromiter(map(xxhash.xxh64_intdigest, words), U64, len(words)) for words in word_blocks(text.lower())]
    return np.concatenate([*parts, np.array([END], U64)])


def _tokenize(kind: pa.DataType):
    def flush(ids: list, codes: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(c) for c in codes], np.int64)
        train = np.array([not is_held_out(i) for i in ids])
        words, tokens = np.unique(np.concatenate(codes), return_inverse=True)
        counts = np.bincount(tokens, np.repeat(train, sizes), len(words)).astype(np.int64)
        number = uuid.uuid4().int >> 65
        row = [number, ids, int(sizes.sum()), int(sizes[train].sum()), _zip(words, counts), _zip(sizes, train, tokens.astype(np.uint32))]
        kinds = [pa.int64(), pa.list_(kind), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = ["batch", "doc_ids", "n_tokens", "n_train", "words", "tokens"]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                codes.append(_codes(text.as_py() or b""))
                size += len(codes[-1])
                if size >= BATCH_TOKENS:
                    yield flush(ids, codes)
                    ids, codes, size = [], [], 0
        if ids:
            yield flush(ids, codes)

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words with at least one in HEAVY of a batch's training tokens, and their counts."""
    for batch in batches:
        for data, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, counts = _unzip(data)
            often = (counts > 0) & (counts * HEAVY >= total)
            yield pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(counts[often])], ["word", "n"])


def _counts_of(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                words, counts = _unzip(data)
                at = np.minimum(np.searchsorted(words, wanted), len(words) - 1)
                found = words[at] == wanted
                yield pa.RecordBatch.from_arrays([pa.array(wanted[found].view(np.int64)), pa.array(counts[at[found]])], ["word", "n"])

    return run


def heavy_words(batches: DataFrame, n_train: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, sorted, that are split over the shards, and their counts in full.

    Those whose counts in the batches that name them reach one in HEAVY of all training tokens: at
    most HEAVY words, and with them every word of twice that share.
    """
    named = batches.select("words", "n_train").mapInArrow(_frequent, "word bigint, n bigint")
    heavy = named.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") * HEAVY >= n_train).select("word").collect()
    words = np.sort(np.array([row["word"] for row in heavy], np.int64).view(U64))
    counts = batches.select("words").mapInArrow(_counts_of(words), "word bigint, n bigint")
    totals = dict(map(tuple, counts.groupBy("word").agg(F.sum("n")).collect()))
    return words, np.array([totals[word] for word in words.view(np.int64).tolist()], np.int64)


class Pairs:
    """The distinct (context, word) pairs of a batch and where they are sent; the same each time it is made."""

    def __init__(self, words: bytes, tokens: bytes, heavy: np.ndarray, shards: int) -> None:
        self.words, self.counts = _unzip(words)
        self.sizes, self.train, self.tokens = _unzip(tokens)
        end = int(np.searchsorted(self.words, U64(END)))
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = end
        key = before.astype(U64) << U64(32) | self.tokens.astype(U64)
        self.keys, self.of_token = np.unique(key, return_inverse=True)
        self.context = (self.keys >> U64(32)).astype(np.int64)
        self.word = (self.keys & U64(0xFFFFFFFF)).astype(np.int64)
        home = (self.words % U64(shards)).astype(np.int64)
        at = np.minimum(np.searchsorted(heavy, self.words), max(0, len(heavy) - 1))
        is_heavy = heavy[at] == self.words if len(heavy) else np.zeros(len(self.words), bool)
        #: the words that are heavy, and their places among those
        self.heavy, self.heavy_at = np.flatnonzero(is_heavy), at[is_heavy]
        spread = ((self.words >> U64(20)) % U64(shards)).astype(np.int64)
        self.shard = np.where(is_heavy[self.context], spread[self.word], home[self.context])
        #: pairs and words by shard, in order of hashes within
        self.order = np.argsort(self.shard, kind="stable")
        self.cuts = np.searchsorted(self.shard[self.order], np.arange(shards + 1))
        self.home_order = np.argsort(home, kind="stable")
        self.home_cuts = np.searchsorted(home[self.home_order], np.arange(shards + 1))

    def of(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the pairs and of the home words of a shard."""
        return self.order[self.cuts[shard] : self.cuts[shard + 1]], self.home_order[self.home_cuts[shard] : self.home_cuts[shard + 1]]


def _send(heavy: np.ndarray, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = Pairs(words, tokens, heavy, shards)
                counts = np.bincount(pairs.of_token, np.repeat(pairs.train, pairs.sizes), len(pairs.keys)).astype(np.uint32)
                for shard in range(shards):
                    own, home = pairs.of(shard)
                    if not len(own) and not len(home):
                        continue
                    contexts, firsts = np.unique(pairs.context[own], return_index=True)
                    children = np.diff(np.append(firsts, len(own))).astype(np.uint32)
                    succ, which = np.unique(pairs.word[own], return_inverse=True)
                    which = which.astype(np.uint16 if len(succ) <= 1 << 16 else np.uint32)
                    data = _zip(pairs.words[home], pairs.counts[home], pairs.words[contexts], children, pairs.words[succ], which, counts[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([data], pa.binary())],
                        ["shard", "batch", "data"],
                    )

    return run


def build_trie(words: np.ndarray, counts: np.ndarray, contexts: np.ndarray, context_counts: np.ndarray, successors: np.ndarray, keys: np.ndarray, key_counts: np.ndarray) -> bytes:
    """A shard's model: unigram counts of its home words, and its contexts' successors.

    ``keys`` are (place of the context << 32 | place of the successor), sorted.
    """
    place = (keys >> U64(32)).astype(np.int64)
    starts = np.searchsorted(place, np.arange(len(contexts) + 1)).astype(U64)
    relative = place.astype(U64) * U64(max(1, len(successors))) + (keys & U64(0xFFFFFFFF))
    smoothed = (key_counts - DISCOUNT) / context_counts[place] if len(keys) else np.zeros(0)
    sequences = {
        "words": EliasFano.of(words, 1 << 64),
        "contexts": EliasFano.of(contexts, 1 << 64),
        "pointers": EliasFano.of(starts, len(keys) + 1),
        "vocabulary": EliasFano.of(successors, 1 << 64),
        "successors": EliasFano.of(relative, max(1, len(contexts) * len(successors))),
    }
    return pack(sequences, {"counts": counts, "codes": quantised(smoothed) if len(keys) else np.zeros(0, np.uint8)})


class Trie:
    """A packed trie in an unnamed file, mapped into memory."""

    def __init__(self, data: bytes) -> None:
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self.levels, self.others = unpack(self.map)

    def _find(self, level: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence = self.levels[level]
        at = sequence.successor(wanted)
        found = at < sequence.n
        at = np.minimum(at, max(0, sequence.n - 1))
        if sequence.n:
            found &= sequence.values(at) == wanted
        return at, found

    def count(self, words: np.ndarray) -> np.ndarray:
        at, found = self._find("words", words)
        return np.where(found, self.others["counts"][at] if len(self.others["counts"]) else 0, 0)

    def pairs(self, contexts: np.ndarray, children: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct successors of each context, and the codes of ``words``, ``children`` for each context."""
        place, known = self._find("contexts", contexts)
        pointers = self.levels["pointers"]
        begin, end = pointers.values(place).astype(np.int64), pointers.values(place + 1).astype(np.int64)
        distinct = np.where(known, end - begin, 0)
        number, in_vocabulary = self._find("vocabulary", words)
        base = np.repeat(place, children).astype(U64) * U64(max(1, self.levels["vocabulary"].n))
        at, found = self._find("successors", base + number.astype(U64))
        found &= np.repeat(known, children) & in_vocabulary
        codes = self.others["codes"]
        return distinct, np.where(found, codes[at] if len(codes) else 0, 0).astype(np.uint8)


def _model_and_answers(heavy: np.ndarray, heavy_counts: np.ndarray):
    def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        seen = counts > 0
        values, which = np.unique(keys[seen], return_inverse=True)
        return values, np.bincount(which, counts[seen], len(values)).astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        parts = [_unzip(data) for data in table.column("data").to_pylist()]
        words, counts = merged([p[0] for p in parts], [p[1] for p in parts])
        pair_contexts = [np.repeat(p[2], p[3]) for p in parts]
        pair_words = [p[4][p[5]] for p in parts]
        contexts = np.unique(np.concatenate([c[p[6] > 0] for c, p in zip(pair_contexts, parts, strict=True)]))
        successors = np.unique(np.concatenate([w[p[6] > 0] for w, p in zip(pair_words, parts, strict=True)]))
        keys, key_counts = merged(
            [np.searchsorted(contexts, c).astype(U64) << U64(32) | np.searchsorted(successors, w).astype(U64) for c, w in zip(pair_contexts, pair_words, strict=True)],
            [p[6] for p in parts],
        )
        home = np.minimum(np.searchsorted(words, contexts), max(0, len(words) - 1))
        context_counts = np.where(words[home] == contexts, counts[home], 0) if len(words) else np.zeros(len(contexts), np.int64)
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, contexts), len(heavy) - 1)
            context_counts = np.where(heavy[at] == contexts, heavy_counts[at], context_counts)
        data = build_trie(words, counts, contexts, context_counts, successors, keys, key_counts)
        trie = Trie(data)
        shard = table.column("shard")[0].as_py()
        parts_of_heavy, _ = trie.pairs(heavy, np.zeros(len(heavy), np.int64), np.zeros(0, U64))
        rows = [(shard, None, len(words), data, parts_of_heavy.tolist())]
        for number, part, of in zip(table.column("batch").to_pylist(), parts, pair_words, strict=True):
            distinct, codes = trie.pairs(part[2], part[3], of)
            rows.append((shard, number, None, _zip(trie.count(part[0]).astype(np.int64), distinct.astype(np.uint32), codes), None))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        names = ["shard", "batch", "n_words", "data", "heavy"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _score(kind: pa.DataType, heavy: np.ndarray, heavy_distinct: np.ndarray, shards: int, n_train: int, vocabulary: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def one(doc_ids: list, words: bytes, tokens: bytes, answers: list[dict]) -> pa.RecordBatch:
        pairs = Pairs(words, tokens, heavy, shards)
        count, distinct = np.zeros(len(pairs.words), np.int64), np.zeros(len(pairs.words), np.int64)
        codes = np.zeros(len(pairs.keys), np.uint8)
        for answer in answers:
            own, home = pairs.of(answer["shard"])
            counts, successors, found = _unzip(answer["data"])
            count[home] = counts
            np.add.at(distinct, np.unique(pairs.context[own]), successors.astype(np.int64))
            codes[own] = found
        distinct[pairs.heavy] = heavy_distinct[pairs.heavy_at]
        base = (count + 0.5) / (n_train + 0.5 * (vocabulary + 1))
        seen = count[pairs.context]
        back = np.where(seen > 0, DISCOUNT * distinct[pairs.context] / np.maximum(seen, 1), 1.0)
        chance = np.log10(CODEBOOK[codes] + back * base[pairs.word])
        starts = np.cumsum(pairs.sizes) - pairs.sizes
        sums = lambda of: np.add.reduceat(of, starts)
        arrays = [
            pa.array(doc_ids, kind), pa.array(~pairs.train), pa.array(pairs.sizes),
            pa.array(sums((count > 0)[pairs.tokens].astype(np.int64))), pa.array(np.full(len(doc_ids), n_train)),
            pa.array(sums(np.log10(base)[pairs.tokens])), pa.array(sums(chance[pairs.of_token])),
        ]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield one(row["doc_ids"], row["words"], row["tokens"], row["answers"])

    return run


def train_and_score(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores, model): the model is a row per shard, (shard, n_words, data), from the other folds' texts."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow_kind = pa.int64() if kind in ("bigint", "int") else pa.string()
    rows = docs.select("doc_id" if kind != "int" else F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    batches = stored(rows.mapInArrow(_tokenize(arrow_kind), BATCHES.format(kind)), "batches")
    totals = batches.agg(F.sum("n_tokens"), F.sum("n_train")).first()
    n_tokens, n_train = (int(x or 0) for x in totals)
    shards = max(tasks_for(spark), -(-n_tokens // SHARD_TOKENS))
    heavy, heavy_counts = heavy_words(batches, n_train) if n_train else (np.zeros(0, U64), np.zeros(0, np.int64))
    sent = batches.select("batch", "words", "tokens").mapInArrow(_send(heavy, shards), "shard int, batch bigint, data binary")
    made = sent.groupBy("shard").applyInArrow(
        _model_and_answers(heavy, heavy_counts), "shard int, batch bigint, n_words bigint, data binary, heavy array<bigint>"
    )
    made = stored(made, "model")
    model = made.where("batch IS NULL").select("shard", "n_words", "data")
    # a number for each heavy word: its successors lie in all shards
    parts = made.where("batch IS NULL").select(F.posexplode("heavy").alias("at", "n")).groupBy("at").agg(F.sum("n"))
    heavy_distinct = np.zeros(len(heavy), np.int64)
    for at, n in parts.collect():
        heavy_distinct[at] = n
    vocabulary = int(model.agg(F.sum("n_words")).first()[0] or 0)
    answers = made.where("batch IS NOT NULL").groupBy("batch").agg(F.collect_list(F.struct("shard", "data")).alias("answers"))
    whole = batches.select("batch", "doc_ids", "words", "tokens").join(answers, "batch")
    scores = whole.select("doc_ids", "words", "tokens", "answers").mapInArrow(
        _score(arrow_kind, heavy, heavy_distinct, shards, n_train, vocabulary),
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
    return scores, model


def op3_ngram_trie_scores(spark, folder: str) -> DataFrame:
    return train_and_score(read(spark, folder, "documents"))[0]
