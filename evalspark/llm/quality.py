"""Quality rules whose cutoffs are chosen under a bound on false rejections.

Every document gets counts of what makes text poor, and from them four ratios in thousandths. A
rule rejects a document whose ratio is above the rule's cutoff. Cutoffs come from labelled
documents, separately for each stratum (language):

* A good document (quality 1) that a rule rejects is a false rejection. For a stratum with n good
  documents of which a cutoff rejects k, the exact binomial test asks how likely k or fewer
  would be if the true rate were ``RISK`` / rules: P(Bin(n, RISK / rules) <= k). If this is at
  most the level, the upper Clopper-Pearson bound of the rate is below that share of the risk.
* Of each rule the cutoffs are tested from the loosest on, and the last that passes before one
  fails is taken (a fixed sequence needs no correction within itself); as k only grows, this is
  the strictest cutoff that passes. Between rules and strata the level is ``ERROR`` / (rules x
  strata). So with probability 1 - ERROR no stratum loses more than RISK of its good documents
  to the rules. A rule without a passing cutoff rejects nothing in that stratum.

A base check besides is fixed: fewer than 10 words, or over 20 % of them in repeated windows.
Everything is DataFrame functions, and no text is shuffled.

Null and empty texts have no words and fail the base check. Null languages are a stratum of
their own. A document labelled good at least once counts as good once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.columns import compute_once
from evalspark.llm.common import BLANKS, WORD, read, stored

RISK, ERROR = 0.02, 0.05
CUTOFFS = (20, 50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900)
RULES = ("symbols", "dup_lines", "repeats", "shouts")
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Thresholds of at most so many strata are broadcast.
BROADCAST_STRATA = 10_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _repeated_positions(size: int) -> Column:
    """Positions, in order, of the windows whose hash occurs at another position too."""
    at = F.sequence(F.lit(0), F.size("ordered") - 1)
    h = lambda j: F.get("ordered", j)["h"]
    twice = F.filter(at, lambda j: F.coalesce(h(j) == h(j - 1), F.lit(False)) | F.coalesce(h(j) == h(j + 1), F.lit(False)))
    return F.sort_array(F.transform(twice, lambda j: F.get("ordered", j)["at"]))


def _covered(positions: Column, size: int) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))

    def add(done: Column, at: Column) -> Column:
        return F.struct((done["total"] + at + size - F.greatest(done["end"], at)).alias("total"), (at + size).alias("end"))

    return F.aggregate(positions, start, add, lambda done: done["total"])


def features(docs: DataFrame, *kept: Column) -> DataFrame:
    """(doc_id, stratum, *kept, counts, ratios, base_failed) for every document."""
    names = ["doc_id", "stratum", *[f"kept{i}" for i in range(len(kept))]]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), *[c.alias(n) for c, n in zip(kept, names[2:], strict=True)], text.alias("body")
    )
    body = F.col("body")
    lines = F.filter(F.split(body, "\n", -1), lambda line: _without(line, BLANKS) > 0)
    rows = compute_once(rows, {"words": F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), "lines": lines})
    n, size = F.size("words"), REPEAT_WINDOW
    starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    rows = compute_once(
        rows,
        {
            "n_words": n.cast("long"),
            "word_chars": _without(body, BLANKS).cast("long"),
            "n_symbols": (F.length(body) - _without(body, SYMBOLS)).cast("long"),
            "n_shouts": (F.length(body) - _without(body, "!")).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "hashes": F.transform(starts, lambda at: F.xxhash64(F.slice("words", at, size))),
        },
        drop=("words", "lines", "body"),
    )
    several = F.size(F.array_distinct("hashes")) < F.size("hashes")
    pairs = F.transform("hashes", lambda h, at: F.struct(h.alias("h"), at.alias("at")))
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    rows = compute_once(rows, {"ordered": F.when(several, F.sort_array(pairs)).otherwise(none)}, ("hashes",))
    positions = F.when(F.size("ordered") > 0, _repeated_positions(size)).otherwise(F.array().cast("array<int>"))
    rows = compute_once(rows, {"n_repeat_words": _covered(positions, size)}, ("ordered",))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.floor(1000 * F.col(part) / F.col(whole))).otherwise(0).cast("long")
    return rows.select(
        *names, *COUNTS,
        share("n_symbols", "word_chars").alias("symbols"), share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"), share("n_shouts", "n_words").alias("shouts"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def _tail(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), summed from its terms' logarithms."""
    odds = F.log(F.lit(rate / (1 - rate)))
    start = F.struct((n * F.log(F.lit(1 - rate))).alias("log"), F.exp(n * F.log(F.lit(1 - rate))).alias("total"))

    def add(done: Column, i: Column) -> Column:
        log = done["log"] + F.log((n - i + 1) / i) + odds
        return F.struct(log.alias("log"), (done["total"] + F.exp(log)).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda done: done["total"])


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, one cutoff per rule): the strictest passing cutoff, NULL where none passes."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    held = measured.join(good, "doc_id", "left_semi")
    counts = [F.count_if(F.col(rule) > cut).alias(f"{rule}_{cut}") for rule in RULES for cut in CUTOFFS]
    tallies = stored(held.groupBy("stratum").agg(F.count("*").alias("n"), *counts), "tallies")
    strata = max(1, tallies.count())
    rate, level = risk / len(RULES), error / (len(RULES) * strata)
    tests = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(cut).alias("cut"), F.col(f"{rule}_{cut}").alias("k")) for rule in RULES for cut in CUTOFFS])
    tested = tallies.select("stratum", "n", F.inline(tests))
    # beyond the mean of n * rate the tail is near one half or more, no level in use passes
    passed = tested.where((F.col("k") <= rate * F.col("n")) & (_tail(F.col("n"), F.col("k"), rate) <= level))
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == rule, F.col("cut"))).alias(f"{rule}_cut") for rule in RULES])


def verdicts(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``measured`` with kept: false if the base check failed or a rule of the stratum rejects."""
    cuts = stored(cuts, "cutoffs")
    if cuts.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    joined = measured.join(cuts, "stratum", "left")
    rejects = [F.coalesce(F.col(rule) > F.col(f"{rule}_cut"), F.lit(False)) for rule in RULES]
    bad = F.col("base_failed")
    for reject in rejects:
        bad = bad | reject
    return joined.withColumn("kept", ~bad)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, all columns as they came; texts are measured once, where they lie.

    Measures and columns are stored side by side: labels meet the measures alone and cutoffs are
    few, so no text is moved, however many labels there are.
    """
    measured = stored(features(docs, *[docs[name] for name in docs.columns]), "features")
    whole = verdicts(measured, thresholds(measured, labels)).where("kept")
    return whole.select(*[F.col(f"kept{at}").alias(name) for at, name in enumerate(docs.columns)])


def op9_quality_rules(spark, folder: str) -> DataFrame:
    measured = stored(features(read(spark, folder, "documents")), "features")
    found = verdicts(measured, thresholds(measured, read(spark, folder, "labels")))
    return found.select("doc_id", *COUNTS, "base_failed", "kept")
