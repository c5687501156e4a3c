"""Repairing the turn structure of conversations by a rank-convergent parallel Viterbi search.

A repaired conversation has the role initials ``(s?(ua)+)?``. Edits of a row are Keep (0), Rerole to
user or assistant (3) and Delete (4, the only one for blank and duplicate rows); an empty turn may
be Inserted anywhere (3); a truncated row that stays costs 3 more. The automaton has four states
(nothing yet, after s, after u, after a), and in each state one of user and assistant is legal,
so the initials D, I, K, R of the edits say all. What is looked for is the cheapest sequence, and of
these the least as text.

The search runs over backward costs: for a row and a state, what the rest costs at least. With them
the least sequence is found forwards, taking at each point the first letter that is on a
cheapest way.

* Rows are sorted over the whole cluster by conversation and turn, and cut into chunks of one
  conversation; a conversation of any length is spread over tasks, ``MOST_CHUNKS`` and a few more
  chunks at most. A row is one character in its chunk.
* Rank convergence: a chunk does not wait for what follows it but starts from a speculative cost
  vector. A fix-up pass gives each chunk the vector its successor has found; the chunk runs again
  from its end until its vector differs from that of its last run by a constant only, and keeps all that comes
  before that. Passes end when no chunk has changed. Two passes are usual, one per chunk of
  the longest conversation is the limit.
* Vectors are kept as their differences, of which there are few, so a step is one lookup.
* Every chunk is traced from all four states; the chunks of a conversation are stitched from these,
  and the letters of the state that was entered are taken.

Rows of a conversation are in the order of their turn (nulls first); rows of one turn stand in order
of role, then of the SHA-256 of their text, then as they come. A null role or text counts as one
space. A null conv_id is a conversation like any other. Repeated rows are duplicates unless blank.
Tables may be empty and have any other columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import read, stored, tasks_for

RULE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a chunk at least; chunks of a conversation, besides those cut by the ends of tasks.
LEAST_CHUNK, MOST_CHUNKS = 256, 64
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state the state after the one turn that may be inserted or reroled to, and its role.
STEP = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: (state, role initial) -> state after keeping the row.
KEEPING = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
#: A row as one character: its initial, upper case if truncated; "-" for one that must go.
MUST_GO, NO_ROLE = "-", "o"
#: A cost vector has a byte for each state, as differences from its least cost. That of the end, where
#: only inserts are left, and that of an end whose costs are not known yet.
END, SPECULATIVE = bytes([0, 6, 3, 0]), bytes(4)


def _options(symbol: str, state: int, rest: bytes) -> list[tuple[str, int, int]]:
    """(letter, cost with all that follows, next state) of the edits that use a row up."""
    options = [("D", DELETE + rest[state], state)]
    if symbol != MUST_GO:
        extra = TRUNCATED if symbol.isupper() else 0
        kept = KEEPING.get((state, symbol.lower()))
        if kept is not None:
            options.append(("K", extra + rest[kept], kept))
        options.append(("R", RULE + extra + rest[STEP[state]], STEP[state]))
    return options


def _closed(costs: list[int]) -> list[int]:
    """Costs when turns may be inserted first."""
    for _ in range(4):
        costs = [min(cost, INSERT + costs[STEP[state]]) for state, cost in enumerate(costs)]
    return costs


@cache
def step_back(symbol: str, rest: bytes) -> tuple[bytes, int]:
    """The cost vector before a row, as differences and a constant, from the differences after it."""
    costs = _closed([min(cost for _, cost, _ in _options(symbol, state, rest)) for state in range(4)])
    least = min(costs)
    return bytes(cost - least for cost in costs), least


@cache
def first_edits(symbol: str, state: int, rest: bytes) -> tuple[str, int]:
    """The least letters up to the one that uses the row up, and the state after it."""
    before, least = step_back(symbol, rest)
    letters = ""
    while True:
        aim = before[state] + least
        ways = [(letter, to) for letter, cost, to in _options(symbol, state, rest) if cost == aim]
        if INSERT + before[STEP[state]] + least == aim:
            ways.append(("I", STEP[state]))
        letter, state = min(ways)
        letters += letter
        if letter != "I":
            return letters, state


def backward(symbols: str, end: bytes, known: bytes = b"") -> bytes:
    """The vectors before every row and at the end, in a row.

    ``known`` are those of the last run. A run stops where it meets them: vectors are kept as
    differences, so equal ones differ by a constant, and so do all before them.
    """
    vectors = bytearray(known or 4 * (len(symbols) + 1))
    vectors[-4:] = rest = end
    for at in range(len(symbols) - 1, -1, -1):
        rest = step_back(symbols[at], rest)[0]
        if known and rest == known[4 * at : 4 * at + 4]:
            break
        vectors[4 * at : 4 * at + 4] = rest
    return bytes(vectors)


def trace(symbols: str, vectors: bytes, state: int) -> tuple[list[str], int]:
    """The letters of each row, entered in a state, and the state at the end."""
    letters = []
    for at, symbol in enumerate(symbols, 1):
        own, state = first_edits(symbol, state, vectors[4 * at : 4 * at + 4])
        letters.append(own)
    return letters, state


def effects(symbols: str, letters: list[str], state: int) -> list[str]:
    """What becomes of each row, entered in a state: K as it is, U or A with that role, u or a an insert."""
    made = []
    for symbol, own in zip(symbols, letters, strict=True):
        marks = ""
        for letter in own:
            if letter == "K":
                state = KEEPING[state, symbol.lower()]
                marks += "K"
            elif letter != "D":
                state = STEP[state]
                marks += ROLES[state][0].upper() if letter == "R" else ROLES[state][0]
        made.append(marks)
    return made


def edit_cost(symbol: str, letters: str) -> int:
    """What the letters of a row cost, those of inserts around it included."""
    row = letters.replace("I", "")
    extra = TRUNCATED if symbol.isupper() and row != "D" else 0
    return INSERT * letters.count("I") + {"D": DELETE, "K": 0, "R": RULE}[row] + extra


# -- rows --------------------------------------------------------------------------------


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def number_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, row), stored, since a row's number must stay what it is."""
    rows = conversations.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "turns")


def row_faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, row, initial, fault): the first fault of each row, or "none".

    First rows are found by an aggregate that combines on the map side, and are joined by row
    number, so no conversation, role or text that is frequent meets in one task.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = turns.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), "row", last.alias("last"),
        F.substring("role", 1, 1).alias("initial"),
    )
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"))
    firsts = firsts.select(F.col("first.row").alias("row"), F.lit(True).alias("is_first"))
    fault = (
        F.when(F.col("last") == "", "blank")
        .when(F.col("is_first").isNull(), "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated")
        .otherwise("none")
    )
    return rows.join(firsts, "row", "left").select(
        "conv_id", "turn", "role", "digest", "row", "initial", fault.alias("fault")
    )


def _cut(most: int):
    """Sorted rows into chunks: symbols, row numbers, initials at both ends, illegal pairs inside."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.int64()]
    names = ["part", "number", "symbols", "rows", "first", "last", "illegal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        conv, symbols, rows, initials, illegal, kind = None, [], [], ["", ""], 0, None

        def done() -> tuple:
            return conv, part, number, "".join(symbols), rows, initials[0], initials[1], illegal

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = [list(column) for column in zip(*out, strict=True)]
            arrays = [pa.array(column, own) for column, own in zip(columns, [kind, *kinds], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", *names])

        for batch in batches:
            out, kind = [], batch.schema.field("conv_id").type
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "row", "symbol", "initial"))
            for own, row, symbol, initial in zip(*columns, strict=True):
                if symbols and (own != conv or len(symbols) >= most):
                    out.append(done())
                    number, symbols, rows = number + 1, [], []
                if symbols:
                    illegal += initials[1] + initial not in LEGAL
                else:
                    initials[0], illegal = initial, 0
                conv, initials[1] = own, initial
                symbols.append(symbol)
                rows.append(row)
            if out:
                yield made(out)
        if symbols:
            yield made([done()])

    return run


LEGAL = frozenset({"su", "ua", "au"})


def chunks(faults: DataFrame, longest: int) -> DataFrame:
    """Chunks of sorted rows, stored: conv_id, part, number, symbols, rows, first, last, illegal,
    and what follows in the conversation: index, entry (is first), final (is last), next_part, next_number."""
    spark = faults.sparkSession
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(NO_ROLE)
    symbol = (
        F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO)
        .when(F.col("fault") == "truncated", F.upper(letter))
        .otherwise(letter)
    )
    rows = faults.withColumns({"symbol": symbol, "has_turn": F.col("turn").isNotNull()})
    order = ["conv_id", "has_turn", "turn", "role", "digest", "row"]
    ordered = rows.repartitionByRange(tasks_for(spark), *order).sortWithinPartitions(*order)
    kind = faults.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, part bigint, number bigint, symbols string, rows array<bigint>, first string, last string, illegal bigint"
    )
    most = max(LEAST_CHUNK, -(-longest // MOST_CHUNKS))
    return stored(ordered.select("conv_id", "row", "symbol", "initial").mapInArrow(_cut(most), schema), "chunks")


def _in_order(cut: DataFrame, *values: str) -> DataFrame:
    """(conv_id, chunks): the chunks of each conversation in order; few, whatever its length."""
    return cut.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "number", *values))).alias("chunks"))


def linked(cut: DataFrame) -> DataFrame:
    """(part, number, is_first, next_part, next_number) of every chunk."""
    lists = _in_order(cut).select("chunks", F.posexplode("chunks").alias("at", "chunk"))
    after = F.get("chunks", F.col("at") + 1)
    return lists.select(
        "chunk.part", "chunk.number", (F.col("at") == 0).alias("is_first"),
        after["part"].alias("next_part"), after["number"].alias("next_number"),
    )


# -- search ------------------------------------------------------------------------------

KEY = ["part", "number"]
VECTORS = "part bigint, number bigint, used binary, vectors binary"


def _run_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's vectors from that at its end, resuming from those of the run before."""
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("symbols", "wanted", "vectors"))
        found = [backward(symbols, end, known or b"") for symbols, end, known in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), batch.column("number"), batch.column("wanted"), pa.array(found, pa.binary())],
            ["part", "number", "used", "vectors"],
        )


def converged(cut: DataFrame, links: DataFrame) -> DataFrame:
    """(part, number, used, vectors) of the chunks that are not alone, when none changes any more."""
    alone = F.col("is_first") & F.col("next_part").isNull()
    several = stored(links.where(~alone).join(cut.select(*KEY, "symbols"), KEY), "several")
    start = F.when(F.col("next_part").isNull(), F.lit(END)).otherwise(F.lit(SPECULATIVE))
    first = several.select(*KEY, "symbols", start.alias("wanted"), F.lit(None).cast("binary").alias("vectors"))
    state = stored(first.mapInArrow(_run_back, VECTORS), "vectors")
    while True:
        begins = state.select(
            F.col("part").alias("next_part"), F.col("number").alias("next_number"), F.substring("vectors", 1, 4).alias("wanted")
        )
        asked = several.select(*KEY, "next_part", "next_number").join(begins, ["next_part", "next_number"])
        changed = asked.join(state, KEY).where("wanted <> used").select(*KEY, "wanted", "vectors")
        changed = stored(changed, "changed")
        if changed.isEmpty():
            return state
        again = several.select(*KEY, "symbols").join(changed, KEY).mapInArrow(_run_back, VECTORS)
        state = stored(state.join(changed.select(*KEY), KEY, "left_anti").unionByName(again), "vectors")


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("symbols", "vectors"))
        exits = [[trace(symbols, vectors, state)[1] for state in range(4)] for symbols, vectors in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("part"), batch.column("number"), pa.array(exits, pa.list_(pa.int32()))],
            ["conv_id", "part", "number", "exits"],
        )


def entries(cut: DataFrame, state: DataFrame) -> DataFrame:
    """(part, number, entry): the state in which each chunk that is not alone is entered."""
    kind = cut.schema["conv_id"].dataType.simpleString()
    known = cut.select("conv_id", *KEY, "symbols").join(state.select(*KEY, "vectors"), KEY)
    exits = known.mapInArrow(_exits, f"conv_id {kind}, part bigint, number bigint, exits array<int>")
    none = F.array().cast("array<struct<part:bigint,number:bigint,entry:int>>")

    def enter(so_far: Column, chunk: Column) -> Column:
        entered = F.struct(chunk["part"].alias("part"), chunk["number"].alias("number"), so_far["state"].alias("entry"))
        return F.struct(
            F.element_at(chunk["exits"], so_far["state"] + 1).alias("state"),
            F.concat(so_far["done"], F.array(entered)).alias("done"),
        )

    begin = F.struct(F.lit(START).alias("state"), none.alias("done"))
    return _in_order(exits, "exits").select(F.inline(F.aggregate("chunks", begin, enter, lambda last: last["done"])))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "part", "number", "first", "last", "illegal", "rows"]
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("symbols", "vectors", "entry", "is_last"))
        audits, costs, made = [], [], []
        for symbols, vectors, entry, is_last in zip(*columns, strict=True):
            letters, state = trace(symbols, vectors or backward(symbols, END), entry)
            if is_last:
                letters[-1] += "I" * (END[state] // INSERT)
            audits.append("".join(letters))
            costs.append(sum(map(edit_cost, symbols, letters)))
            made.append(effects(symbols, letters, entry))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name) for name in names), pa.array(audits), pa.array(costs, pa.int64()), pa.array(made, pa.list_(pa.string()))],
            [*names, "audit", "cost", "effects"],
        )


def edits(cut: DataFrame) -> DataFrame:
    """Every chunk with the least audit of its rows, its cost and what becomes of each row, stored."""
    links = stored(linked(cut), "links")
    state = converged(cut, links)
    known = links.select(*KEY, F.col("next_part").isNull().alias("is_last"))
    known = cut.join(known, KEY).join(state.select(*KEY, "vectors"), KEY, "left").join(entries(cut, state), KEY, "left")
    kind = cut.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, part bigint, number bigint, first string, last string, illegal bigint, rows array<bigint>, "
        "audit string, cost bigint, effects array<string>"
    )
    return stored(known.withColumn("entry", F.coalesce("entry", F.lit(START))).mapInArrow(_edits, schema), "edits")


# -- results -----------------------------------------------------------------------------


def report(faults: DataFrame, done: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation with rows."""
    one = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    turns = faults.groupBy("conv_id", "turn").agg(one("blank"), one("duplicate"), one("truncated"))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    found = turns.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"), *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")]
    )
    lists = _in_order(done, "first", "last", "illegal", "audit", "cost")
    seam = F.transform(
        F.arrays_zip(F.slice("chunks", 1, F.size("chunks") - 1).alias("a"), F.slice("chunks", 2, F.size("chunks")).alias("b")),
        lambda two: (~F.concat(two["a"]["last"], two["b"]["first"]).isin(*sorted(LEGAL))).cast("bigint"),
    )
    add = lambda a, b: a + b
    zero = F.lit(0).cast("bigint")
    stitched = lists.select(
        F.col("conv_id").alias("_conv"),
        (F.aggregate("chunks", zero, lambda a, c: a + c["illegal"]) + F.aggregate(seam, zero, add)).alias("illegal"),
        F.aggregate("chunks", zero, lambda a, c: a + c["cost"]).alias("cost"),
        F.array_join(F.transform("chunks", lambda c: c["audit"]), "").alias("audit"),
    )
    return found.join(stitched, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def repaired_turns(turns: DataFrame, done: DataFrame) -> DataFrame:
    """(conv_id, part, number, place, step, effect, role, text): the repaired conversations' turns.

    ``part``, ``number``, ``place`` and ``step`` give their order. Texts are joined by row number.
    """
    rows = done.select("part", "number", F.posexplode(F.arrays_zip("rows", "effects")).alias("place", "one"))
    rows = rows.select("part", "number", "place", F.col("one.rows").alias("row"), F.col("one.effects").alias("effects"))
    rows = rows.where("effects <> ''").join(turns.select("conv_id", "row", "role", "text"), "row")
    marks = F.posexplode(F.split("effects", "")).alias("step", "effect")
    steps = rows.select("conv_id", "part", "number", "place", "role", "text", marks)
    mark = F.lower("effect")
    return steps.select(
        "conv_id", "part", "number", "place", "step", "effect",
        F.when(mark == "u", "user").when(mark == "a", "assistant").otherwise(F.col("role")).alias("role"),
        F.when(F.col("effect").isin("u", "a"), "").otherwise(F.col("text")).alias("text"),
    )


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report on every conversation, and the turns of the repaired ones."""
    turns = number_rows(conversations)
    faults = stored(row_faults(turns), "faults")
    longest = faults.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    done = edits(chunks(faults, longest))
    return report(faults, done), repaired_turns(turns, done)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, which come one after the other."""
    hasher, conv, kind = None, None, None
    for batch in batches:
        out, kind = [], batch.schema.field("conv_id").type
        for own, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if hasher is not None and own == conv:
                hasher.update(b"\n")
            else:
                if hasher is not None:
                    out.append((conv, hasher.hexdigest()))
                hasher, conv = hashlib.sha256(), own
            hasher.update(line.encode())
        if out:
            yield _digest_rows(out, kind)
    if hasher is not None:
        yield _digest_rows([(conv, hasher.hexdigest())], kind)


def _digest_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([conv for conv, _ in rows], kind), pa.array([digest for _, digest in rows])], ["_conv", "repaired_sha256"]
    )


def digests(turns: DataFrame) -> DataFrame:
    """(_conv, repaired_sha256): SHA-256 of each conversation's ``role:text`` lines.

    A SHA-256 runs from the first byte to the last, so one task sees the lines of a conversation, one
    batch at a time; sorting spills.
    """
    order = ["part", "number", "place", "step"]
    lines = turns.select("conv_id", *order, F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition(tasks_for(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)
    kind = turns.schema["conv_id"].dataType.simpleString()
    return ordered.select("conv_id", "line").mapInArrow(_digests, f"_conv {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The given rows as the contract damages them; conv_id and turn decide how."""
    key = F.concat(_text("conv_id"), F.lit(":"), _text("turn"))
    rows = conversations.select(
        "conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), (F.crc32(key) % 20).alias("how")
    )
    rows = rows.where("how <> 0").select(
        "conv_id", "turn",
        F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


def op11_conversation_repair(spark, folder: str) -> DataFrame:
    given = read(spark, folder, "conversations")
    found, turns = repair(damaged(given))
    whole = given.select("conv_id").distinct()
    both = whole.join(found.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    both = both.join(digests(turns), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zero = [F.coalesce(name, F.lit(0)).alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return both.select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )
