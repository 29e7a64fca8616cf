"""Conversation repair: against a search over single rows, its DuckDB SQL, and edge rows."""

import hashlib
import heapq
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from spanlake.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def search(rows):
    """(cost, audit, repaired lines) of the cheapest, then least, edits: best-first search."""
    seen, marked = set(), []
    for role, text in rows:
        blank, copy = not text.strip(" \t\n\x0b\f\r"), (role, text) in seen
        seen.add((role, text))
        cut = not blank and not copy and text.rstrip(" \t\n\x0b\f\r")[-1] not in ".!?"
        marked.append((role, text, blank or copy, int(cut)))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(marked) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(lines)
        state = (i, roles[-1:], bool(roles))
        if (state, cost, audit) in done:
            continue
        done.add((state, cost, audit))
        new = "a" if roles[-1:] == "u" else "u"
        name = {"u": "user", "a": "assistant"}[new]
        if cost <= 4 * len(marked) + 4:
            heapq.heappush(heap, (cost + 2, audit + "I", i, roles + new, (*lines, f"{name}:")))
        if i < len(marked):
            role, text, gone, cut = marked[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, lines))
            if not gone:
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, roles + new, (*lines, f"{name}:{text}")))
                if role and re.fullmatch("s?(ua)*u?", roles + role[:1]):
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, roles + role[:1], (*lines, f"{role}:{text}")))
    raise AssertionError


def test_equals_search(spark):
    draw = random.Random(5)
    talks = {k: [(draw.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), draw.choice(["a.", "b", "", "c!", f"x{t}?", f"y{t}"]))
                 for t in range(draw.randint(1, 8))] for k in range(120)}
    rows = [(k, t, role, text) for k, v in talks.items() for t, (role, text) in enumerate(v)]
    got = {r["conv_id"]: r for r in C.report(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    for k, v in talks.items():
        cost, audit, lines = search(v)
        assert (got[k]["cost"], got[k]["audit"]) == (cost, audit), v
        assert got[k]["repaired_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        pairs = [a[:1] + b[:1] for (a, _), (b, _) in itertools.pairwise(v)]
        assert got[k]["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs) and got[k]["gaps"] == 0


@pytest.mark.parametrize("symbol", range(16))
def test_runs_equal_single_rows(symbol):
    v = C.end()
    for n in range(1, 70):
        v = C.before(symbol, 1, v)
        assert v == C.before(symbol, n, C.end())
    cost, text = C.audit([(4, 1), (symbol, 1300), (8, 1)])
    one, single = C.audit([(4, 1), *[(symbol, 1)] * 1300, (8, 1)])
    assert cost == one and "".join(text) == "".join(single)


def test_damage(spark):
    rows = spark.createDataFrame([(c, t, "assistant", "Is it? Yes. No!") for c in range(20) for t in range(20)], SCHEMA)
    got = C.damage(rows).groupBy("role", "text", "copies").count().collect()
    kinds = {(r["role"], r["text"], r["copies"]): r["count"] for r in got}
    whole = "Is it? Yes. No!"
    assert {("assistant", whole, 0), ("assistant", "", 1), ("assistant", "Is it Yes No", 1), ("assistant", whole, 2), ("user", whole, 1)} <= set(kinds)
    assert sum(kinds.values()) == 400 and kinds["assistant", whole, 1] > 250


EDGE = [(1, None, "user", "late?"), (1, 3, "assistant", "b."), (1, 7, "user", "late?"), (2, 0, None, None), (None, 5, "user", "q."), (None, 5, "user", "q."),
        (3, None, "user", "x.\x0b"), (3, None, "assistant", "y!"), (4, 1, "assistant", "\U0001F600" * 200_000), (5, 9, "user", ""), (6, 2, "user", "drop"), (6, 1, "user", "two")]


def test_edge_rows(spark):
    rows = spark.createDataFrame(EDGE, SCHEMA).withColumns({"digest": F.lit(1), "head": F.lit(2), "kept": F.lit("x"), "blank": F.lit(True)})
    got = {r["conv_id"]: r for r in C.report(rows).collect()}
    assert (got[1]["gaps"], got[1]["duplicate"], got[1]["audit"]) == (3, 1, "KKD")
    assert (got[2]["blank"], got[2]["audit"], got[2]["repaired_sha256"]) == (1, "D", hashlib.sha256(b"").hexdigest())
    assert (got[None]["duplicate"], got[None]["gaps"], got[None]["audit"]) == (1, 0, "DIKI") or got[None]["audit"] == "KDI"
    assert (got[3]["gaps"], got[3]["illegal"], got[3]["truncated"]) == (0, 0, 0) and got[4]["audit"] == "D" or got[4]["cost"] == 3
    assert got[5]["audit"] == "D" and got[6]["illegal"] == 1
    gone = rows.withColumn("copies", F.when(F.col("conv_id") == 6, 0).otherwise(1))
    empty = C.report(gone).where("conv_id = 6").collect()[0]
    assert tuple(empty)[1:8] == (0, 0, 0, 0, 0, 0, "") and empty["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert C.report(rows.limit(0)).count() == 0 and C.repair(rows.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "user", "r?"), (1, 3, "assistant", "a.")], SCHEMA)
    got = [tuple(r) for r in C.repair(rows).orderBy("position").collect()]
    assert got == [(1, 0, "K", 0, "system", "s."), (1, 1, "K", 1, "user", "q?"), (1, 2, "I", None, "assistant", ""),
                   (1, 3, "K", 2, "user", "r?"), (1, 4, "K", 3, "assistant", "a.")]


def test_one_conversation_over_many_partitions(spark):
    n = 3000
    rows = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', if(id % 31 = 1, 'user', 'assistant')) as role",
                                     "concat('t', id, if(id % 17 = 0, '', '.')) as text").repartition(13)
    got = C.report(rows).collect()[0]
    runs = []
    for t in range(n):
        role = 1 if t % 2 == 0 or t % 31 == 1 else 2
        runs.append((4 * role + (C.CUT if t % 17 == 0 else C.FINE), 1))
    cost, text = C.audit(runs)
    assert (got["cost"], got["audit"]) == (cost, "".join(text)) and got["truncated"] == sum(t % 17 == 0 for t in range(n))


def test_sql(spark, tmp_path):
    rows = spark.createDataFrame([*EDGE, *[(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(10, 60) for t in range(6)]], SCHEMA)
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op13_conversations(spark, str(tmp_path))
    con = duckdb.connect()
    con.register("conversations", spark.read.parquet(f"{tmp_path}/conversations.parquet").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.sql(C.SQL)
    assert got.columns == want.columns and {tuple(r) for r in got.collect()} == set(want.fetchall())
