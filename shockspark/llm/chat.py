"""Chat formatting: conversations as budgeted training windows with a loss mask.

A turn is rendered by its role between two control strings (``TEMPLATE``); a control string
inside a text gets a backslash, after the backslashes right before it have been doubled, so
that reading back is exact.  Tokens of the rendered turns are added up along the
conversation, and a turn's prefix sum places it: the axis of tokens is cut into cells of
three quarters of the room (the budget less the system turn and the history, a quarter of the
budget at least), a turn belongs to the cell in which it begins, and one that would end
beyond the room has a window of its own.  So windows follow from prefix sums alone, without a
walk through the conversation, and a conversation that holds much of the table is dealt to
many tasks.  Every window repeats the conversation's system turn (its first turn, if its
role is ``system``) and up to ``history_turns`` turns before its first one, counted backwards
as far as ``history_tokens`` and the budget reach.  Repeated turns carry no loss: each
assistant text is under the mask once.  Nothing is cut or dropped: a window whose system turn
and single own turn do not fit is longer than the budget, and says so.  A turn counts as one
token at least.

Turns are ordered by turn (nulls first), equal ones by role, then by SHA-256 of the text.  Null
roles and texts are empty; a null conversation id is an id of its own; repeated rows are
turns of their own.  Extra columns are dropped.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shockspark.functions.broadcast import bounded_broadcast
from shockspark.llm.bpe import encode
from shockspark.llm.common import at, ship, written

#: The control strings before and after a turn's text, by role.  A turn of
#: any other role names it first.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, END_ROLE, END = "[ROLE]", "[/ROLE]", "[END]"
CONTROLS = [*(c for pair in TEMPLATE.values() for c in pair), ROLE, END_ROLE, END]
_ANY = "|".join(map(re.escape, CONTROLS))
ESCAPABLE = rf"(?<!\\)(\\*+)({_ANY})"
_CONTROL = re.compile(rf"(?<!\\)(?:{_ANY})")
_ESCAPED = re.compile(rf"(?<!\\)(\\++)({_ANY})")
SYSTEM, ASSISTANT = "system", "assistant"


# one turn -----------------------------------------------------------------------------

def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1$1\\$2")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1][:len(m[1]) // 2] + m[2], text)


def rendered(role: Column, text: Column) -> tuple[Column, Column]:
    """What stands before the text in the formatted turn, and the whole turn."""
    before, after = F.concat(F.lit(f"{ROLE} "), escaped(role), F.lit(f" {END_ROLE} ")), F.lit(f" {END}")
    for name, (first, last) in TEMPLATE.items():
        before, after = (F.when(role == name, F.lit(x)).otherwise(y) for x, y in ((f"{first} ", before), (f" {last}", after)))
    return before, F.concat(before, escaped(text), after)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    openings = {first: (role, last) for role, (first, last) in TEMPLATE.items()}
    marks, turns, i = [(m[0], *m.span()) for m in _CONTROL.finditer(formatted)], [], 0
    between = lambda a, b: unescaped(formatted[marks[a][2] + 1:marks[b][1] - 1])
    while i < len(marks):
        if marks[i][0] == ROLE:
            turns.append((between(i, i + 1), between(i + 1, i + 2)))
            i += 3
        else:
            turns.append((openings[marks[i][0]][0], between(i, i + 1)))
            i += 2
    return turns


# prefix sums --------------------------------------------------------------------------

def byte_pair_tokens(rank_path: str, pattern: str) -> Callable[[DataFrame, str, str], DataFrame]:
    """Adds the number of byte-pair tokens of a text column to a frame."""

    def counted(df: DataFrame, text: str, out: str) -> DataFrame:
        return encode(df, rank_path, pattern, text, "token_ids").withColumn(out, F.size("token_ids").cast("long")).drop("token_ids")

    return counted


def placed_turns(df: DataFrame, tokens: Callable[[DataFrame, str, str], DataFrame], conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, part, place, role, lead, whole, tokens, start, system), written: ``place`` is the
    number of the turn in its conversation, ``start`` the tokens of the turns before it (but
    the system turn's), ``system`` the tokens of the system turn or 0."""
    ship(df.sparkSession)
    empty = lambda c: F.coalesce(at(c).cast("string"), F.lit(""))
    rows = df.select(at(conv_id).alias("conv_id"), at(turn).cast("long").alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    order = ["conv_id", "turn", "role", "mark"]
    lead, whole = rendered(F.col("role"), F.col("text"))
    rows = rows.withColumn("mark", F.sha2("text", 256)).repartitionByRange(*order).sortWithinPartitions(*order)
    # conv_id, role and the token count are all that the running sums need to see
    turns = tokens(rows.select("conv_id", "role", F.char_length(lead).alias("lead"), whole.alias("whole")), "whole", "tokens")
    turns = turns.withColumn("tokens", F.greatest(F.col("tokens").cast("long"), F.lit(1)))
    schema = T.StructType([*turns.schema, *[T.StructField(c, T.LongType()) for c in ("part", "place", "start", "system")]])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, place, start, system = TaskContext.get().partitionId() if TaskContext.get() else 0, None, 0, 0, 0
        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for conv, role, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "tokens"))):
                if held is None or held[0] != conv:
                    held, place, start, system = (conv,), 0, 0, n if role == SYSTEM else 0
                out.append((part, place, start, system))
                place, start = place + 1, start + n
            added = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, *added], arrow)], schema=arrow)

    turns = written(turns.mapInArrow(summed, schema), "turns")
    # a conversation cut by a range bound: its later parts continue the sums of the first
    sums = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("sum"), F.min_by("system", "place").alias("first"))
    along = Window.partitionBy("conv_id").orderBy("part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    later = sums.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.sum("turns").over(before).alias("places"), F.sum("sum").over(before).alias("tokens_before"),
                        F.first("first").over(along).alias("own")).filter("places is not null")
    met = turns.join(bounded_broadcast(later), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    system = F.coalesce("own", "system")
    place, start = (F.col(a) + F.coalesce(F.col(b), F.lit(0)) for a, b in (("place", "places"), ("start", "tokens_before")))
    return met.select("conv_id", "role", "lead", "whole", "tokens", place.alias("place"),
                      F.when(place == 0, 0).otherwise(start - system).alias("start"), system.alias("system"))


# windows ------------------------------------------------------------------------------

def _window(budget: int, history_tokens: int) -> Column:
    """Number of the window: twice the cell, and one more for a turn that ends beyond the room.
    The system turn goes with the turn after it, which begins at 0."""
    room = F.greatest(F.lit(budget - history_tokens) - F.col("system"), F.lit(max(4, budget // 4)))
    cell = F.floor(room * 3 / 4)
    number = F.floor(F.col("start") / cell)
    return 2 * number + (F.col("start") + F.col("tokens") - number * cell > room).cast("long")


def windows(df: DataFrame, tokens: Callable[[DataFrame, str, str], DataFrame], budget: int = 2048, history_turns: int = 2, history_tokens: int = 256,
            conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, window, formatted, loss, repeated, tokens, over_budget): the formatted
    text of each window, the spans of its loss in code points, and the number of turns in
    front that other windows hold."""
    turns = placed_turns(df, tokens, conv_id, turn, role, text)
    is_system = (F.col("place") == 0) & (F.col("system") > 0)
    own = turns.withColumn("window", F.when(~is_system, _window(budget, history_tokens)))
    # the first window takes the system turn in; the others repeat it
    first = own.groupBy("conv_id", "window").agg(F.min("place").alias("from"), F.max("system").alias("system"), F.sum("tokens").alias("own"))
    spans = written(first.filter("window is not null"), "spans")
    later = spans.filter(F.col("from") > (F.col("system") > 0).cast("int")).select(F.col("conv_id").alias("c"), F.col("window").alias("to"), "from",
                                                                                             F.least(F.lit(history_tokens), F.lit(budget) - F.col("system") - F.col("own")).alias("spare"))
    several = later.select("c").distinct()
    # a turn's room in the history is what the turns behind it leave
    back = F.explode(F.sequence(F.lit(1), F.lit(history_turns))) if history_turns else F.explode(F.array().cast("array<int>"))
    asked = later.withColumn("back", back).withColumn("asked", F.col("from") - F.col("back"))
    cut = turns.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    near = cut.filter(~is_system).join(asked, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("asked")))
    reach = Window.partitionBy("conv_id", "to").orderBy("back")  # history_turns rows
    near = near.withColumn("sum", F.sum("tokens").over(reach)).filter("sum <= spare")
    heads = cut.filter(is_system).join(later, F.col("conv_id").eqNullSafe(F.col("c")))
    entry = lambda window, repeated: ["conv_id", window.alias("window"), F.struct(
        "place", F.lit(repeated).alias("repeated"), "role", "lead", "whole", "tokens").alias("turn")]
    held = own.filter("window is not null").select(*entry(F.col("window"), False))
    homes = spans.groupBy(F.col("conv_id").alias("c")).agg(F.min("window").alias("home"))
    alone = own.filter(is_system).join(homes, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(*entry(F.coalesce("home", F.lit(0)), False))
    every = held.unionByName(alone).unionByName(near.select(*entry(F.col("to"), True))).unionByName(heads.select(*entry(F.col("to"), True)))
    lists = every.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("turn")).alias("turns"))  # budget tokens, or one turn
    spot = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def along(s: Column, t: Column) -> Column:
        length = F.char_length(t["whole"])
        text = F.struct((s["at"] + t["lead"]).alias("start"), (s["at"] + length - len(f" {TEMPLATE[ASSISTANT][1]}")).alias("end"))
        return F.struct((s["at"] + length).alias("at"), F.when((t["role"] == ASSISTANT) & ~t["repeated"], F.concat(s["loss"], F.array(text))).otherwise(s["loss"]).alias("loss"))

    total = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["tokens"])
    return lists.select("conv_id", "window", F.array_join(F.col("turns.whole"), "").alias("formatted"), F.aggregate("turns", spot, along)["loss"].alias("loss"),
                        F.size(F.filter("turns", lambda t: t["repeated"])).alias("repeated"), total.alias("tokens"), (total > budget).alias("over_budget"))


# reading back -------------------------------------------------------------------------

READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(found: DataFrame) -> DataFrame:
    """One row for each conversation, from its windows' texts and spans alone: number and
    digest of its turns (role, newline, text, newline), code points and digest of the text
    under the loss mask, and code points of all windows.  Windows stream by in order; the
    digests are sequential, so one conversation is read by one task, a window at a time."""
    dealt = found.select("conv_id", "window", "formatted", "loss", "repeated").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    schema = T.StructType(
        [found.schema["conv_id"], *[T.StructField(n, T.LongType() if k == "long" else T.StringType()) for n, k in (c.split() for c in READ.split(", "))]])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held = to_arrow_schema(schema), None  # conversation, turns, digest, loss, digest, formatted

        def out():
            conv, n, turns, chars, loss, size = held
            row = (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for i in range(batch.num_rows):
                conv, formatted, loss, repeated = (batch.column(c)[i].as_py() for c in ("conv_id", "formatted", "loss", "repeated"))
                if held and held[0] != conv:
                    yield out()
                    held = None
                held = held or [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted)[repeated:]:
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescaped(formatted[span["start"]:span["end"]])
                    held[3] += len(text)
                    held[4].update(text.encode())
                held[5] += len(formatted)
        if held:
            yield out()

    return dealt.mapInArrow(streamed, schema)
