"""Conversation repair against a plain walk over all edits, and its DuckDB oracle."""

import hashlib
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lathework.llm import registry, turns

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return by


def plain_best(rows, faults):
    """Cost, audit and lines, by trying every edit in every state, inserts one at a time."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    def put(states, k, found):
        if k not in states or found[:2] < states[k][:2]:
            states[k] = found
            return True
        return False

    def inserted(states):
        states = dict(states)
        while any(put(states, after[k], (c + 3, a + "I", lines + (("assistant:" if k == 2 else "user:"),))) for k, (c, a, lines) in list(states.items())):
            pass
        return states

    states = {0: (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for k, (c, a, lines) in inserted(states).items():
            put(new, k, (c + 4, a + "D", lines))
            if fault in "bd" and fault:
                continue
            extra = 3 if fault == "t" else 0
            fitting = "assistant" if k == 2 else "user"
            if role[:1] == "s" and k == 0:
                put(new, 1, (c + extra, a + "K", (*lines, f"{role}:{text}")))
            if role[:1] == fitting[0]:
                put(new, after[k], (c + extra, a + "K", (*lines, f"{role}:{text}")))
            put(new, after[k], (c + extra + 3, a + "R", (*lines, f"{fitting}:{text}")))
        states = new
    states = inserted(states)
    return min((states[k] for k in (0, 3) if k in states), key=lambda s: s[:2])


def plain_repair(rows):
    out = {}
    for conv, own in plain_damage(rows).items():
        faults, seen = [], set()
        for _, role, text in own:
            body = text.rstrip(WHITE)
            faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        known = {r[0] for r in own if r[0] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = plain_best(own, faults)
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def chance_rows(n, conversations, seed):
    r = random.Random(seed)
    ids, turns_of = [None, *range(conversations)], [None, *range(40)]
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "u"]
    texts = [None, "", "  ", "hi.", "hi", "yes!", "no? ", "a.b\n", "own."]
    return [(r.choice(ids), r.choice(turns_of), r.choice(roles), (t := r.choice(texts)) and (f"{r.random()}." if t == "own." else t)) for _ in range(n)]


def found(frame, **how):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in turns.repair(turns.damage(frame), **how).collect()}


@pytest.mark.parametrize(("n", "conversations", "how"), [(400, 40, {}), (500, 3, {}), (500, 3, {"chunk": 8, "fan": 2, "per_range": 50}), (500, 20, {"chunk": 16, "fan": 3, "per_range": 100})])
def test_repair_like_plain(spark, n, conversations, how):
    """Nulls in every column, ties, repeats, unknown roles; whole conversations, and the same in chunks."""
    rows = chance_rows(n, conversations, n + conversations)
    assert found(spark.createDataFrame(rows, SCHEMA), **how) == plain_repair(rows)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = registry.QUERIES["op12_conversation_repair"](spark, sf)
    assert got.columns == ["conv_id", *COLUMNS]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == plain_repair(rows)


def test_oracle():
    rows = chance_rows(600, 12, 9)
    conversations = pa.table({k: pa.array([r[j] for r in rows], t) for j, (k, t) in enumerate([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])})
    con = duckdb.connect()
    con.register("conversations", conversations)
    assert {r[0]: tuple(r[1:]) for r in con.sql(turns.OP12_SQL).fetchall()} == plain_repair(rows)


def test_hot_conversation(spark):
    """One conversation with nearly all rows, half of them one text at many turns, very long texts: no array exceeds a chunk."""
    rows = [(1, k, "user" if k % 2 else "assistant", "the same." if k % 3 else f"turn {k}" + " x" * (50_000 if k % 400 == 0 else 0)) for k in range(1_500)]
    rows += [(1, None, "user", "again.")] * 300 + [(c, 0, "user", "hi.") for c in range(2, 30)]
    assert found(spark.createDataFrame(rows, SCHEMA), chunk=64, fan=4, per_range=200) == plain_repair(rows)


def test_edges(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    dropped = next(c for c in range(1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(dropped, 0, "user", "hi.")], SCHEMA)
    assert found(frame) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    clash = {c: F.lit("other") for c in (*COLUMNS, "copies", "place", "piece", "x", "n", "digest")}
    rows = chance_rows(60, 5, 1)
    assert found(spark.createDataFrame(rows, SCHEMA).withColumns(clash)) == plain_repair(rows)
