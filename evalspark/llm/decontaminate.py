"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned token windows.

A window is 13 consecutive words of an item, or the whole of a shorter item. The hashes of all
windows form the set; it is shipped with the tasks while it has at most ``SET_LIMIT`` hashes
of 8 bytes (one count decides). Beyond that the hashes of the documents' windows are joined with it,
by broadcast if its stored size is below Spark's limit, else by a shuffle of hashes. The
positions whose window hash is in the set are verified word by word, so a collision of hashes
changes nothing. Everything is DataFrame functions.

Null and empty texts have no words; an item without words has no windows. Repeated item rows
are one item. Every document row is judged by itself, whatever its doc_id: null and repeated ids
give a row each. Documents and benchmark may have any other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import compute_once
from evalspark.llm.common import ascii_lower, read, split_marked, stored

WINDOW = 13
#: After lower-casing A-Z a word is a run of digits, letters a-z and all beyond ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: So many hashes at most (8 bytes each) go into the plan; more are joined.
SET_LIMIT = 50_000
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN_WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, size, gram, h): the distinct windows of every item and their hashes."""
    items = compute_once(benchmark.select("item_id", "text"), {"words": plain_words(F.col("text"))}, ("text",))
    items = items.where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)
    grams = items.select("item_id", "size", F.explode(starts).alias("at"), "words")
    grams = grams.select("item_id", "size", F.slice("words", F.col("at"), F.col("size")).alias("gram"))
    return grams.distinct().withColumn("h", F.xxhash64("gram"))


def _starts(words: Column, size: int) -> Column:
    last = F.size(words) - size + 1
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _spots(words: Column, size: int, known: list[int] | None) -> Column:
    """(at, size, gram) of the windows whose hash is known; of all windows without a set."""

    def spot(at: Column) -> Column:
        return F.xxhash64(F.slice(words, at, size)).isin(known)

    def window(at: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(size).alias("size"), F.slice(words, at, size).alias("gram"))

    starts = _starts(words, size)
    return F.transform(starts if known is None else F.filter(starts, spot), window)


def window_hits(docs: DataFrame, grams: DataFrame, set_limit: int = SET_LIMIT) -> DataFrame:
    """(row, doc_id, text_key, n_words, spots, items): a row for every document row, hits verified.

    ``spots`` are the (at, size) of the windows that occur in an item, ``items`` the items' ids, both
    maybe with repeats. A window's items are put together before they meet the documents.
    """
    sizes = [row[0] for row in grams.select("size").distinct().orderBy("size").collect()]  # at most WINDOW
    hashes = stored(grams.select("size", "h").distinct(), "window-hashes")
    small = hashes.limit(set_limit + 1).count() <= set_limit
    known = {}
    for size, h in hashes.collect() if small else []:
        known.setdefault(size, []).append(h)
    rows = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"), "text"
    )
    texts = compute_once(rows, {"words": plain_words(F.col("text"))}, ("text",))
    if small:
        hits = [_spots(F.col("words"), size, known.get(size)) for size in sizes]
        none = F.array().cast("array<struct<at:int,size:int,gram:array<string>>>")
        spots = compute_once(
            texts, {"n_words": F.size("words").cast("long"), "spots": F.concat(none, *hits)}, ("words",)
        )
        found = spots.select("row", "doc_id", "text_key", "n_words", F.explode_outer("spots").alias("spot"))
        found = found.select("row", "doc_id", "text_key", "n_words", "spot.at", "spot.size", "spot.gram")
    else:
        found = _joined_spots(stored(texts, "words"), hashes, sizes)
    items = F.array_distinct(F.collect_list(F.col("item_id").cast("string"))).alias("items")
    wanted = grams.groupBy("gram").agg(items).withColumnRenamed("gram", "item_gram")
    met = found.join(stored(wanted, "window-items"), F.col("gram") == F.col("item_gram"), "left")
    hit = F.col("items").isNotNull()
    return met.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"),
        F.collect_list(F.when(hit, F.struct("at", "size"))).alias("spots"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )


def _joined_spots(texts: DataFrame, hashes: DataFrame, sizes: list[int]) -> DataFrame:
    """The spots where a join takes the place of the set: hashes alone are spelled out and shuffled.

    Words come back for the windows that are left, which are joined to their row by its number.
    """
    def hashed(size: int) -> Column:
        return F.transform(_starts(F.col("words"), size), lambda at: F.xxhash64(F.slice("words", at, size)))

    places = [texts.select("row", F.posexplode(hashed(size)).alias("at", "h"), F.lit(size).alias("size")) for size in sizes]
    if places:
        every = places[0]
        for more in places[1:]:
            every = every.union(more)
        left = every.join(hashes, ["size", "h"], "left_semi").groupBy("row").agg(F.collect_list(F.struct((F.col("at") + 1).alias("at"), "size")).alias("left"))
    else:
        left = texts.select("row", F.array().cast("array<struct<at:int,size:int>>").alias("left")).limit(0)
    met = texts.join(left, "row", "left").select("row", "doc_id", "text_key", F.size("words").cast("long").alias("n_words"), "words", F.explode_outer("left").alias("spot"))
    gram = F.when(F.col("spot").isNotNull(), F.slice("words", F.col("spot.at"), F.col("spot.size")))
    return met.select("row", "doc_id", "text_key", "n_words", "spot.at", "spot.size", gram.alias("gram"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_limit: int = SET_LIMIT) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items, spans, contaminated, text_key.

    ``items`` are the sorted item ids as text, ``spans`` the sorted (at, end) of the hit windows in
    words, from 1, end exclusive; ``text_key`` is the SHA-256 of the text. A document's own hits are
    combined before they are shuffled; they are bounded by its words.
    """
    grams = stored(benchmark_windows(benchmark, window), "benchmark")
    spans = F.transform("spots", lambda spot: F.struct(spot["at"].alias("at"), (spot["at"] + spot["size"]).alias("end")))
    found = compute_once(
        window_hits(docs, grams, set_limit), {"spans": F.sort_array(F.array_distinct(spans)), "sorted": F.sort_array("items")}, ("spots", "items")
    )
    found = compute_once(found, {"n_hit": covered(F.col("spans"))})
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("sorted").cast("long").alias("n_items"), F.col("sorted").alias("items"), "spans",
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "text_key",
    )


def covered(spans: Column) -> Column:
    """How many words sorted (at, end) spans cover."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))

    def add(done: Column, span: Column) -> Column:
        new = F.greatest(F.lit(0), span["end"] - F.greatest(done["end"], span["at"]))
        return F.struct((done["total"] + new).alias("total"), F.greatest(done["end"], span["end"]).alias("end"))

    return F.aggregate(spans, start, add, lambda done: done["total"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns as they came.

    Whether a row goes depends on its text alone, so the few texts that go are stored, and rows
    are held against these by the SHA-256 of their text; ids need not be there or differ. Only rows
    that a filter of fixed size lets through are joined, so the other texts are not moved.
    """
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("text_key").alias("bad_key")).distinct()
    bad = stored(bad, "contaminated")
    key = lambda some: F.sha2(F.coalesce(some["text"], F.lit("")), 256)
    asked, clear = split_marked(docs, [key(docs)], bad)
    return clear.unionByName(asked.join(bad, key(asked) == F.col("bad_key"), "left_anti"))


def op4_benchmark_decontamination(spark, folder: str) -> DataFrame:
    found = contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )
