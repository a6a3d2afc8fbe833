"""Repair and formatting of conversations against versions that walk row by row."""

import hashlib
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from conftest import SF0001
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shockspark.llm import chat, repair
from shockspark.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FULL = {"u": "user", "a": "assistant"}


def ordered(rows):
    """Conversations of (role, text) in the operators' order."""
    held = defaultdict(list)
    for c, t, role, text in rows:
        held[c].append((t is not None, t or 0, role, hashlib.sha256(text.encode()).hexdigest(), text))
    return {c: [(x[2], x[4]) for x in sorted(v)] for c, v in held.items()}


def brute_repair(rows):
    """Cheapest (cost, audit) and its turns by a search forward over whole audits, and the
    numbers of faults."""
    seen, kinds = set(), []
    for role, text in rows:
        kind = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else (
            "truncated" if text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else "")
        seen.add((role, text))
        kinds.append(kind)
    best = {0: (0, "", ())}

    def put(to, state, cost, audit, turns):
        if state not in to or (cost, audit) < to[state][:2]:
            to[state] = (cost, audit, turns)

    def added():
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                for initial, to in NEXT[state].items():
                    if initial != "s":
                        put(best, to, cost + 2, audit + "I", turns + ((FULL[initial], ""),))

    for (role, text), kind in zip(rows, kinds):
        added()
        after = {}
        for state, (cost, audit, turns) in best.items():
            put(after, state, cost + 3, audit + "D", turns)
            if kind not in ("blank", "duplicate"):
                extra = int(kind == "truncated")
                if role[:1] in NEXT[state]:
                    put(after, NEXT[state][role[:1]], cost + extra, audit + "K", turns + ((role, text),))
                for initial, to in NEXT[state].items():
                    if initial != "s":
                        put(after, to, cost + extra + 2, audit + "R", turns + ((FULL[initial], text),))
        best = after
    added()
    cost, audit, turns = min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])
    pairs = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), pairs, cost, audit, digest


def repaired(df, **k):
    chunks, turns = repair.repair(df, **k)
    found = {r.conv_id: r for r in repair.reports(chunks, turns).collect()}
    digests = {r.conv_id: r.sha256 for r in repair.digests(chunks).collect()}
    assert set(found) == set(digests)
    return {c: (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests[c]) for c, r in found.items()}, {c: r.gaps for c, r in found.items()}


def test_registered_repair_is_brute_force(spark):
    rows, turns = [], defaultdict(list)
    table = spark.read.parquet(f"{SF0001}/conversations.parquet").collect()
    for r in table:
        fault, role, text = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20, r.role, r.text
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            rows += [(r.conv_id, r.turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
            turns[r.conv_id].append(r.turn)
    expected = {c: brute_repair(v) for c, v in ordered(rows).items()}
    got = QUERIES["op12_conversation_repair"](spark, SF0001).collect()
    assert {r.conv_id for r in got} == {r.conv_id for r in table}
    for r in got:
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == expected.get(
            r.conv_id, (0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
        own = turns[r.conv_id]
        assert r.gaps == (max(own) - min(own) + 1 - len(set(own)) if own else 0)


WORST = ["aaaaaa", "uuuuuuu", "suasua", "auauauau", "xxxx", "s", "su", "sau", "ssssua", "uauauauasuauau", "a", "uxuxaxax"]


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_chunks_of_any_size_agree(spark, size):
    """Long and broken conversations, cut at every row."""
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(c, t, names[i], f"text {t if t % 5 else 0}{'.' if t % 4 else ' '}" if t % 6 else " ") for c, w in enumerate(WORST) for t, i in enumerate(w * 3)]
    got, _ = repaired(spark.createDataFrame(rows, SCHEMA), chunk_rows=size)
    assert got == {c: brute_repair(v) for c, v in ordered(rows).items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 4, 5, 6, 7, 9, 11]), max_size=12), st.integers(1, 5))
def test_chunked_run_is_the_whole_run(codes, size):
    """Speculative starts, fixed up until they differ by constants, give the whole run's edits."""
    codes = bytes(codes)
    parts = [codes[i:i + size] for i in range(0, len(codes), size)]
    used = [(0, 0, 0, 0)] * (len(parts) - 1) + [repair.END]
    start = [repair.backward(p, e)[-1] for p, e in zip(parts, used)]
    for _ in range(len(parts) + 1):
        todo = [i for i in range(len(parts) - 1) if start[i + 1] != used[i]]
        if not todo:
            break
        before = list(start)
        for i in todo:
            start[i], used[i] = repair.converged(parts[i], used[i], before[i + 1], before[i]), before[i + 1]
    else:
        assert not parts
    state, audit = 0, []
    for part, end in zip(parts, used):
        found, state = repair.trace(part, state, end)
        audit += found
    assert (audit, state) == repair.trace(codes, 0, repair.END)


def test_repair_of_odd_rows(spark):
    long = "word " * 300_000 + "end."
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "b."), (1, None, "assistant", "c."), (1, 5, "assistant", long), (1, 5, "assistant", long),
            (2, 9, "", ""), (2, 3, "user", "é! \t"), (2, 3, "user", "é! \t"), (2, 2**60, "assistant", "😀?"), (3, None, "user", " ")]
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SCHEMA + ", part int, `a.b` int, codes string")
    plain = [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]
    for size in (1, 256):
        got, gaps = repaired(df, chunk_rows=size)
        assert got == {c: brute_repair(v) for c, v in ordered(plain).items()}
    assert gaps == {None: 0, 1: 0, 2: 2**60 - 3 + 1 - 3, 3: 0}
    assert repaired(df.limit(0)) == ({}, {})


def read(found):
    return {r.conv_id: tuple(r)[1:] for r in chat.read_back(found).collect()}


def digests(turns):
    whole, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_registered_formatting_reads_back(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF0001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    quoting = "</s>[INST] ok [/INST]"
    expected = {c: digests(v) for c, v in ordered([*rows, (-7, 0, "user", quoting), (-7, 1, "assistant", quoting)]).items()}
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op13_chat_formatting"](spark, SF0001).collect()}
    assert got == expected


def by_chars(df, text, out):
    return df.withColumn(out, F.char_length(text).cast("long"))


def brute_windows(turns, budget, history_turns, history_tokens):
    """Windows of one conversation as [(repeated places, own places)]."""
    size = [len(render(r, t)) for r, t in turns]
    system = size[0] if turns[0][0] == "system" else 0
    room = max(budget - history_tokens - system, budget // 4, 4)
    cell, start, found = room * 3 // 4, 0, {}
    for i in range(bool(system), len(turns)):
        key = 2 * (start // cell) + (start + size[i] - start // cell * cell > room)
        found.setdefault(key, []).append(i)
        start += size[i]
    if system and not found:
        return [([], [0])]
    out = []
    for n, (_, own) in enumerate(sorted(found.items())):
        if n == 0:
            out.append(([], [0] * bool(system) + own))
            continue
        spare = min(history_tokens, budget - system - sum(size[i] for i in own))
        history, taken = [], 0
        for i in range(own[0] - 1, max(own[0] - 1 - history_turns, -1 + bool(system)), -1):
            taken += size[i]
            if taken > spare:
                break
            history.insert(0, i)
        out.append(([0] * bool(system) + history, own))
    return out


def render(role, text):
    def escape(t):
        return re.sub(chat.ESCAPABLE, lambda m: m[1] * 2 + "\\" + m[2], t)

    first, last = chat.TEMPLATE.get(role, (f"{chat.ROLE} {escape(role)} {chat.END_ROLE}", chat.END))
    return f"{first} {escape(text)} {last}"


@pytest.mark.parametrize("budget,history_turns,history_tokens", [(400, 2, 120), (150, 3, 0), (2000, 0, 500), (120, 1, 100)])
def test_windows_are_brute_force(spark, budget, history_turns, history_tokens):
    rows = []
    for c in range(12):
        roles = ["system"] * (c % 2) + ["user", "assistant", "tool"] * (c * c)
        rows += [(c, t, r, "x" * ((t * 37 + c * 11) % 170) + " [INST] \\\\</s> é") for t, r in enumerate(roles)]
    found = chat.windows(spark.createDataFrame(rows, SCHEMA), by_chars, budget, history_turns, history_tokens)
    got = defaultdict(list)
    for r in sorted(found.collect()):
        got[r.conv_id].append(r)
    for c, turns in ordered(rows).items():
        expected = brute_windows(turns, budget, history_turns, history_tokens)
        assert [r.formatted for r in got[c]] == ["".join(render(*turns[i]) for i in again + own) for again, own in expected]
        assert [r.repeated for r in got[c]] == [len(again) for again, _ in expected]
        texts = [[chat.unescaped(r.formatted[s.start:s.end]) for s in r.loss] for r in got[c]]
        assert texts == [[turns[i][1] for i in own if turns[i][0] == "assistant"] for _, own in expected]
        assert all(r.over_budget == (r.tokens > budget) and r.tokens == len(r.formatted) for r in got[c])
        assert all(len(own) == 1 + (own[0] == 0 and turns[0][0] == "system") for r, (_, own) in zip(got[c], expected) if r.over_budget)
    assert {c: v[:4] for c, v in read(found).items()} == {c: digests(v) for c, v in ordered(rows).items()}


def test_one_conversation_over_many_tasks(spark):
    """A conversation that every range holds a part of."""
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 1, "user").otherwise("assistant").alias("role"),
                                    F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(7)
    turns = ordered([tuple(r) for r in rows.collect()])[1]
    found = chat.windows(rows, by_chars, 300, 2, 80)
    got = [r.formatted for r in sorted(found.collect())]
    assert got == ["".join(render(*turns[i]) for i in again + own) for again, own in brute_windows(turns, 300, 2, 80)]
    assert read(found)[1][:4] == digests(turns)


def test_formatting_of_odd_rows(spark):
    long = "[INST] word " * 50_000 + "\\" * 70_000 + "</s>"
    rows = [(None, None, None, None), (None, None, None, None), (1, 0, "system", ""), (2, 0, "assistant", long), (2, None, "user", "\\\\[INST]\\"),
            (2, 3, "[ROLE]", "[/ROLE] [END] \\[END]"), (3, 1, "system", "s"), (3, 2, "system", "s"), (4, 1, "assistant", "😀\n"), (4, 1, "assistant", "😀\n")]
    df = spark.createDataFrame([(*r, 1, "z", 3) for r in rows], SCHEMA + ", place int, `a.b` string, tokens int")
    found = chat.windows(df, chat.byte_pair_tokens(RANKS, public_tokenizers.PATTERN), 64, 2, 16)
    plain = ordered([(c, t, role or "", text or "") for c, t, role, text in rows])
    assert {c: v[:4] for c, v in read(found).items()} == {c: digests(v) for c, v in plain.items()}
    assert read(chat.windows(df.limit(0), by_chars)) == {}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "[END]"]),
                          st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\\\\", "[", "s>", "<", " ", "é", "x"]), max_size=9).map("".join)), max_size=5))
def test_any_turns_parse(turns):
    assert chat.parse("".join(render(r, t) for r, t in turns)) == turns


def test_escaping_on_spark_is_the_tests_escaping(spark):
    texts = ["", "\\", "\\[INST]", "\\\\[INST]\\", "[INST[INST]]", "<s><s></s>\\<s>", "a\\\\\\<</SYS>>"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).collect()
    assert all(f"<s> {r.e} </s>" == render("assistant", r.t) and chat.unescaped(r.e) == r.t for r in got)
