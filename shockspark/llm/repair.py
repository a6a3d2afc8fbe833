"""Repair of the structure of conversations.

A sound conversation has at most one system turn, in front, and then pairs of a user's and
an assistant's turn: its role initials are ``(s?(ua)+)?``.  Rows are kept (K, free), given
another role (R: user or assistant, 2), deleted (D, 3) or inserted (I: a user's or
assistant's turn without text, 2); blank and duplicate rows must go, and a truncated row that
stays costs 1 more.  The cheapest edits are chosen, of several those whose initials come first
in ASCII order.

The automaton of role initials has four states, and a row's cost step is a (min, +) matrix
on vectors of four costs.  A conversation's rows are cut into chunks, so that one that holds
much of the table is worked on by many tasks (rank-convergence Viterbi):

1. each chunk runs backward over its rows from a speculative cost vector (its true one, if
   it is the last of its conversation) to the vector of costs to go at its start;
2. a chunk whose follower's start vector is not, up to a constant, the one it began with runs
   again from that one, only until its vectors differ from the last run's by a constant;
   passes go on until no chunk is left (each settles one more chunk of a conversation at
   least, mostly all at once);
3. with the stitched costs to go, each chunk tells for every state in which it may be entered
   the state in which it is left; the entry states follow from these maps of four, composed by doubling;
4. each chunk takes, row by row, the ASCII-least edit that is on a cheapest way.

Vectors are kept with least cost 0; constants do not matter to the choice.

Rows are ordered by turn (nulls first); equal turns by role, then by SHA-256 of the text.  Null
roles and texts are read as one space (blank rows: they go); a null conversation id is an id
of its own.  A role counts by its first character alone.  Equal rows stay as many as they
are; all but the first are duplicates.  Texts of any length are carried whole.  Extra columns
are dropped.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shockspark.llm.common import at, ship, written

SPACE = " \t\n\x0b\x0c\r"
CHUNK_ROWS = 256
CHUNK_BYTES = 4 << 20  # of text, after which a chunk ends as well

# A row's code: role (0 system, 1 user, 2 assistant, 3 other) + 4 if truncated, + 8 if it must go;
# +16 marks blank and +32 duplicate rows, for the counts only.
ROLES = "sua"
TRUNCATED, GOES, BLANK, DUPLICATE = 4, 8, 16, 32

# States: 0 nothing yet, 1 after the system turn, 2 after a user's turn, 3 after an assistant's.
ADDED = (2, 2, 3, 2)  # the state after the turn that may come next: a user's, or the assistant's in 2
KEPT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))  # by state and role
END = (0, 4, 2, 0)  # costs to go at the end: turns that are still to be added
Vector = tuple[int, int, int, int]


# one row ------------------------------------------------------------------------------

def _options(code: int, state: int, after: Vector) -> list[tuple[int, str, int]]:
    """(cost to go, initial, next state) of the edits that use up a row."""
    found = [(3 + after[state], "D", state)]
    if not code & GOES:
        extra = 1 if code & TRUNCATED else 0
        to = KEPT[state][code & 3]
        if to is not None:
            found.append((extra + after[to], "K", to))
        found.append((2 + extra + after[ADDED[state]], "R", ADDED[state]))
    return found


@lru_cache(maxsize=1 << 16)
def step(code: int, after: Vector) -> Vector:
    """Costs to go before a row, less their least, from those after it."""
    costs = [min(_options(code, s, after))[0] for s in range(4)]
    for _ in range(3):  # turns added in front of the row
        costs = [min(c, 2 + costs[ADDED[s]]) for s, c in enumerate(costs)]
    least = min(costs)
    return tuple(c - least for c in costs)


@lru_cache(maxsize=1 << 16)
def edit(code: int, state: int, after: Vector) -> tuple[str, int]:
    """The ASCII-least cheapest initials up to and with the row's own, and the next state."""
    best = [min(_options(code, s, after))[0] for s in range(4)]
    for _ in range(3):
        best = [min(c, 2 + best[ADDED[s]]) for s, c in enumerate(best)]
    audit = ""
    while True:
        ways = [(initial, to) for cost, initial, to in _options(code, state, after) if cost == best[state]]
        if 2 + best[ADDED[state]] == best[state]:
            ways.append(("I", ADDED[state]))
        initial, state = min(ways)
        audit += initial
        if initial != "I":
            return audit, state


# chunks -------------------------------------------------------------------------------

def backward(codes: bytes, end: Vector) -> list[Vector]:
    """Costs to go after each row, and before the first, from the last row to the first."""
    found = [end]
    for code in reversed(codes):
        found.append(step(code & 15, found[-1]))
    return found


def converged(codes: bytes, old: Vector, new: Vector, start: Vector) -> Vector:
    """The start vector from the end vector ``new``, given that ``old`` leads to ``start``:
    the run ends as soon as the two differ by a constant."""
    for code in reversed(codes):
        if new == old:
            return start
        old, new = step(code & 15, old), step(code & 15, new)
    return new


def trace(codes: bytes, state: int, end: Vector) -> tuple[list[str], int]:
    """The initials for each row, added turns with the row that they stand before, and the
    state in which the chunk is left."""
    after, audit = backward(codes, end), []
    for i, code in enumerate(codes, 1):
        initials, state = edit(code & 15, state, after[-1 - i])
        audit.append(initials)
    return audit, state


def apply(codes: bytes, roles: list[str], texts: list[str], state: int, audit: list[str], last: bool) -> tuple[list[dict], str, int]:
    """The repaired turns, all initials, and their cost."""
    turns, cost = [], 0

    def add():
        nonlocal state
        state = ADDED[state]
        return ("user", "assistant")[state == 3]

    for code, initials, role, text in zip(codes, audit, roles, texts):
        for initial in initials:
            if initial == "I":
                turns.append({"role": add(), "text": ""})
                cost += 2
            elif initial == "D":
                cost += 3
            else:
                cost += (code & TRUNCATED > 0) + 2 * (initial == "R")
                if initial == "K":
                    state = KEPT[state][code & 3]
                turns.append({"role": role if initial == "K" else add(), "text": text})
    closing = END[state] // 2 if last else 0
    for _ in range(closing):
        turns.append({"role": add(), "text": ""})
    return turns, "".join(audit) + "I" * closing, cost + 2 * closing


def illegal(codes: bytes) -> int:
    """Adjacent roles other than system-user, user-assistant, assistant-user."""
    return sum((a & 3, b & 3) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes, codes[1:]))


# tables -------------------------------------------------------------------------------

def _rows(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Equal rows as one with their number; blank and truncated by the text."""
    blank = lambda c: F.coalesce(at(c).cast("string"), F.lit(" "))
    rows = df.select(at(conv_id).alias("conv_id"), at(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    return written(rows.withColumns({"mark": F.sha2("text", 256), "end": end}), "turns")


def _codes(rows: DataFrame) -> DataFrame:
    """Rows with the codes of the first and of the further ones of equal rows."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = (rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"))
             .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("turns")).filter("turns > 1"))
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m")), "left")
    base = F.instr(F.lit(ROLES), F.substring("role", 1, 1)) - 1
    base = F.when((F.col("role") == "") | (base < 0), 3).otherwise(base)
    is_blank = F.col("end") == ""
    code = base + F.when(is_blank, GOES + BLANK).otherwise(
        F.when(place > F.col("first"), GOES + DUPLICATE).otherwise(0) + F.when(~F.col("end").isin(".", "!", "?"), TRUNCATED).otherwise(0))
    again = base + F.when(is_blank, GOES + BLANK).otherwise(GOES + DUPLICATE)
    return met.select("conv_id", "turn", "role", "mark", "copies", code.cast("int").alias("code"), again.cast("int").alias("again"),
                      F.when(code.bitwiseAND(GOES) == 0, F.col("text")).otherwise("").alias("text"))


def chunks(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, codes, roles, texts) by ascending ``part`` in each conversation,
    written, and the (conv_id, turn) of all rows."""
    ship(df.sparkSession)
    rows = _rows(df, conv_id, turn, role, text)
    order = ["conv_id", "turn", "role", "mark"]
    dealt = _codes(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("part", T.LongType()), T.StructField("codes", T.BinaryType()),
                           T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType()))])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: tuple | None = None  # conversation, codes, roles, texts
        size = 0

        def out():
            nonlocal part
            part += 1
            conv, codes, roles, texts = held
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((conv, part - 1, bytes(codes), roles, texts), arrow)], schema=arrow)

        for batch in batches:
            for conv, role, text, copies, code, again in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "copies", "code", "again"))):
                for nth in range(copies):
                    if held and (held[0] != conv or len(held[1]) >= chunk_rows or size >= CHUNK_BYTES):
                        yield out()
                        held = None
                    if not held:
                        held, size = (conv, bytearray(), [], []), 0
                    held[1].append(again if nth else code)
                    held[2].append(role)
                    held[3].append("" if nth else text)
                    size += 0 if nth else len(text)
        if held:
            yield out()

    return written(dealt.mapInArrow(packed, schema), "chunks"), rows.select("conv_id", "turn")


PLACES = "part long, start array<int>, used array<int>"


def _run(links: DataFrame, todo: DataFrame) -> DataFrame:
    """Start vectors of chunks (part, codes, given, and used and start of the last run)."""

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                given = tuple(row["given"])
                start = backward(row["codes"], given)[-1] if row["used"] is None else converged(row["codes"], tuple(row["used"]), given, tuple(row["start"]))
                out.append((row["part"], list(start), list(given)))
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, kinds)], names=["part", "start", "used"])

    return todo.mapInArrow(ran, PLACES)


def _vector(v: Vector) -> Column:
    return F.array(*[F.lit(c).cast("int") for c in v])


def stitched(links: DataFrame, codes: DataFrame) -> DataFrame:
    """(part, used) of the chunks of cut conversations: the cost vector at their end.
    ``links``: part, next_part (null for the last); ``codes``: part, codes."""
    open_, null = _vector((0, 0, 0, 0)), F.lit(None).cast("array<int>")
    work = codes.join(links, "part")
    done = _run(links, work.select("part", "codes", F.when(F.col("next_part").isNull(), _vector(END)).otherwise(open_).alias("given"),
                                   null.alias("used"), null.alias("start")))
    done = written(done, "vectors")
    while True:
        follower = done.select(F.col("part").alias("next_part"), F.col("start").alias("given"))
        todo = links.join(follower, "next_part").join(done, "part").filter("given != used").select("part", "given", "used", "start")
        todo = written(todo, "fix_up")
        if todo.isEmpty():
            return done.select("part", "used")
        again = _run(links, codes.join(todo, "part"))
        done = written(done.join(todo, "part", "left_anti").unionByName(again), "vectors")


def entries(links: DataFrame, codes: DataFrame, ends: DataFrame) -> DataFrame:
    """(part, used, state): the state in which each chunk of a cut conversation is entered."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, [trace(c, s, tuple(u))[1] for s in range(4)]) for p, c, u in zip(*(batch.column(c).to_pylist() for c in ("part", "codes", "used")))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int32()))], names=["part", "to"])

    maps = codes.join(ends, "part").select("part", "codes", "used").mapInArrow(mapped, "part long, to array<int>")
    # each chunk's way in: the map of the chunks from behind ``back`` up to it, doubled in every round
    before = links.filter("next_part is not null").select(F.col("next_part").alias("part"), F.col("part").alias("back"))
    way = before.join(maps.withColumnRenamed("part", "back"), "back").select("part", "back", F.col("to").alias("way"))
    first = links.join(before, "part", "left_anti").select("part", F.lit(None).cast("long").alias("back"), _vector((0, 1, 2, 3)).alias("way"))
    ways = written(way.unionByName(first), "ways")
    while not ways.filter("back is not null").isEmpty():
        behind = ways.select(F.col("part").alias("back"), F.col("back").alias("further"), F.col("way").alias("first_way"))
        both = F.transform("first_way", lambda s: F.get("way", s))
        ways = written(ways.join(behind, "back", "left").select("part", F.col("further").alias("back"), F.coalesce(both, F.col("way")).alias("way")), "ways")
    return ways.select("part", F.col("way")[0].alias("state")).join(ends, "part")


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Chunks of repaired conversations in order of ``part`` - conv_id, part, parts (of the
    conversation), turns (role, text), audit, cost, and of the rows before: blank, duplicate,
    truncated, illegal - and the (conv_id, turn) of all rows."""
    packed, turns = chunks(df, conv_id, turn, role, text, chunk_rows)
    whole = Window.partitionBy("conv_id")
    ends = packed.select("conv_id", "part", F.substring("codes", 1, 1).alias("head"), F.substring("codes", -1, 1).alias("tail"))
    links = ends.withColumns({"parts": F.count(F.lit(1)).over(whole), "next_part": F.lead("part").over(whole.orderBy("part")),
                              "seam": F.concat("tail", F.lead("head").over(whole.orderBy("part")))})
    links = written(links.filter("parts > 1").select("conv_id", "part", "parts", "next_part", "seam"), "links")
    codes = packed.select("part", "codes").join(links.select("part"), "part", "left_semi")
    known = entries(links, codes, written(stitched(links.select("part", "next_part"), codes), "ends")) if not links.isEmpty() else None
    if known is not None:
        known = written(known.join(links.drop("conv_id"), "part"), "entries")
        packed = packed.join(known, "part", "left")
    else:
        packed = packed.withColumns({"used": F.lit(None).cast("array<int>"), "state": F.lit(None).cast("int"), "parts": F.lit(None).cast("long"),
                                     "next_part": F.lit(None).cast("long"), "seam": F.lit(None).cast("binary")})
    counts = ("cost", "blank", "duplicate", "truncated", "illegal")
    schema = T.StructType([packed.schema["conv_id"], T.StructField("part", T.LongType()), T.StructField("parts", T.LongType()),
                           T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))),
                           T.StructField("audit", T.StringType()), *[T.StructField(c, T.LongType()) for c in counts]])

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                codes, state, end = row["codes"], row["state"] or 0, tuple(row["used"] or END)
                audit = trace(codes, state, end)[0]
                turns, initials, cost = apply(codes, row["roles"], row["texts"], state, audit, row["next_part"] is None)
                blank, duplicate = (sum(c & flag > 0 for c in codes) for flag in (BLANK, DUPLICATE))
                out.append((row["conv_id"], row["part"], row["parts"] or 1, turns, initials, cost, blank, duplicate,
                            sum(c & TRUNCATED > 0 for c in codes), illegal(codes) + illegal(row["seam"] or b"")))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow)

    return packed.mapInArrow(repaired, schema), turns


def reports(repaired: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each conversation: gaps in its turn numbers, faults, cost and audit."""
    sums = repaired.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                                           F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    spans = turns.distinct().groupBy(F.col("conv_id").alias("c")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    return sums.join(spans, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the repaired ``role:text``, joined by newlines.  A conversation of
    one chunk is hashed where it is; a cut one is a stream in order of its chunks (the hash
    is sequential), held chunk by chunk."""
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    single = repaired.filter("parts = 1").select("conv_id", F.sha2(line, 256).alias("sha256"))
    lines = repaired.filter("parts > 1").select("conv_id", "part", (F.size("turns") > 0).alias("some"), line.alias("line"))
    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = single.schema

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        held = None  # conversation, hash, whether a line was taken

        def out():
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((held[0], held[1].hexdigest()), arrow)], schema=arrow)

        for batch in batches:
            for conv, some, line in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "some", "line"))):
                if held and held[0] != conv:
                    yield out()
                    held = None
                held = held or [conv, hashlib.sha256(), False]
                if some:
                    held[1].update(("\n" if held[2] else "").encode() + line.encode())
                    held[2] = True
        if held:
            yield out()

    return single.unionByName(dealt.mapInArrow(streamed, schema))


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` with faults put in by crc32 of ``conv_id:turn``: of 20 rows one goes, one
    loses its text, one its marks of an end, one comes twice, one is made the user's.  Nulls are
    one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = df.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault")).filter("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("copy", "fault")
