"""Importance resampling: against plain Python, its DuckDB SQL, and edge rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from spanlake.llm import importance as M

DOCS = "doc_id long, text string"
LONG = "É longword-x " * 30_000
ROWS = [(1, "The CAT, sat 12 ÀB on" * 9), (1, "The CAT, sat 12 ÀB on" * 9), (2, None), (3, ""), (4, LONG), (5, "!! --"), (None, "the cat " * 12),
        *[(k, " ".join(f"w{k * j % 17}" for j in range(25))) for k in range(10, 60)]]
TARGET = [(1, "the cat sat"), (2, None), (3, "on w3 w3 w5")]


def plain(docs, target, max_n=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    def found(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        grams = [" ".join(words[i:i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    s, t = [0] * buckets, [0] * buckets
    for side, rows in ((s, docs), (t, target)):
        for _, text in rows:
            for b in found(text)[1]:
                side[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t, strict=True)]
    out = []
    for doc, text in docs:
        n, hit = found(text)
        weight = sum(gain[b] for b in hit) // len(hit) if hit else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, n, len(hit), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("options", [{}, {"max_n": 3, "buckets": 97, "percent": 40}, {"min_words": 0, "percent": 100, "seed": 7}])
def test_equals_plain(spark, options):
    docs = spark.createDataFrame(ROWS, DOCS).withColumns({"score": F.lit("x"), "rank": F.lit(1), "_place": F.lit(2)}).repartition(3)
    got = M.scores(docs, spark.createDataFrame(TARGET, "item_id long, text string"), **options).collect()
    assert sorted(map(tuple, got), key=repr) == plain(ROWS, TARGET, **options)


def test_empty_sides(spark):
    docs, target = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(TARGET, DOCS)
    assert M.scores(docs.limit(0), target).count() == 0
    assert sorted(map(tuple, M.scores(docs, target.limit(0)).collect()), key=repr) == plain(ROWS, [])


def test_pieces_change_no_word():
    draw = random.Random(3)
    text = "".join(draw.choice("ab1é,. \n") for _ in range(5000)) + "x" * 900 + " end"
    assert "".join(M.pieces(text, 64)) == text and max(map(len, M.pieces(text, 64))) >= 900
    words = [w for p in M.pieces(text, 64) for w, _ in M._WORDS.pre_tokenize_str(p)]
    assert words == re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def test_resample(spark):
    docs = spark.createDataFrame(ROWS, DOCS).withColumn("rank", F.lit("mine"))
    out = M.resample(docs, spark.createDataFrame(TARGET, DOCS), percent=30)
    want = {r[0] for r in plain(ROWS, TARGET, percent=30) if r[5]}
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want


def test_target_is_favoured(spark):
    """Texts like the target are drawn more often than the rest."""
    rows = [(k, ("apple pear plum " if k % 5 == 0 else "bolt nut gear ") * 8) for k in range(1000)]
    got = M.scores(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(0, "apple pear plum " * 50)], DOCS)).where("rank is not null")
    assert got.count() == 100 and got.where("doc_id % 5 = 0").count() >= 95


def test_sql(spark, tmp_path):
    spark.createDataFrame(ROWS, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(TARGET, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = M.op12_importance(spark, str(tmp_path))
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.register(n, spark.createDataFrame(spark.read.parquet(f"{tmp_path}/{n}.parquet").collect()).toPandas().convert_dtypes())
    want = con.sql(M.SQL)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
