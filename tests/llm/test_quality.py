"""Quality ranking: held-out accuracy, the ranking loss against plain gradient descent,
layout independence, and edge rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlake.llm import quality as M

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


def made(n=400):
    draw = random.Random(4)
    words = ["ship", "harbour", "was", "the", "cold", "river", "of", "a", "wind", "stone"]
    rows, marks = [], []
    for k in range(n):
        text = " ".join(draw.choice(words) for _ in range(draw.randint(5, 90))) + "."
        if k % 4 == 0:
            text = draw.choice([text.upper().replace(" ", "!! "), " ".join(["buy"] * 40), text.replace(" ", " | ")])
        rows.append((k, text))
        marks.append((k, int(k % 4 != 0)))
    return rows, marks


@pytest.fixture(scope="module")
def model(spark):
    rows, marks = made()
    return M.fit(spark.createDataFrame(rows[:300], DOCS), spark.createDataFrame(marks, "doc_id long, quality int"))


def test_made_documents(spark, model):
    rows, marks = made()
    got = {r["doc_id"]: r["score"] for r in M.score(spark.createDataFrame(rows[300:], DOCS), model).collect()}
    assert all((got[k] >= M.LIMIT) == bool(q) and 0 <= got[k] <= 1 for k, q in marks[300:])
    kept = M.filter_quality(spark.createDataFrame(rows[300:], DOCS), model)
    assert kept.columns == ["doc_id", "text"] and {r["doc_id"] for r in kept.collect()} == {k for k, q in marks[300:] if q}


def test_layout_does_not_matter(spark, model):
    rows, marks = made()
    docs, labels = spark.createDataFrame(rows[:300], DOCS), spark.createDataFrame(marks, "doc_id long, quality int")
    again = M.fit(docs.repartition(7), labels.repartition(3))
    assert np.allclose(again.weights, model.weights, rtol=1e-9, atol=1e-12) and abs(again.cut - model.cut) < 1e-9


def test_held_out_accuracy(spark):
    got = M.op11_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    fold = spark.read.parquet(f"{SF}/documents.parquet").where("crc32(cast(doc_id as string)) % 5 = 0").count()
    assert got.where("held_out").count() == fold and got.where("predicted <> cast(score >= 0.3 as int)").count() == 0


def test_weights_minimise_the_pair_loss():
    draw = np.random.default_rng(1)
    diff = draw.normal(size=(200, 4)) + [1, 0.5, 0, -0.2]
    w = np.zeros(4)
    for _ in range(20_000):
        w += 0.002 * (diff.T @ (1 / (1 + np.exp(diff @ w))) - w)
    assert np.allclose(M.rank_weights(diff, ridge=1.0), w, atol=1e-4)
    good, bad = M.pairs(3, 5)
    assert len(good) == len(bad) == 64 and set(good) == {0, 1, 2} and set(bad) == set(range(5))


def test_cut_is_the_best_quantile():
    draw = np.random.default_rng(2)
    good, bad = draw.normal(1, 1, 300), draw.normal(-1, 1, 200)
    every = np.sort(np.concatenate([good, bad]))

    def miss(c):
        return 900 * np.mean(good < c) + 100 * np.mean(bad >= c)

    assert miss(M.quantile_cut(good, bad, 900, 100)) <= min(miss(c) for c in every) + 6


def test_features_of_plain_texts():
    text = "AB c!! d\nab c!! d é1"
    x = M.features(pa.array([text, "", None]))
    n = len(text)
    assert np.isclose(x[0, M._MARKS.index(ord("!"))], np.log1p(50 * 4 / n)) and np.isclose(x[0, M._UPPER], np.log1p(50 * 2 / n))
    assert np.isclose(x[0, M.CLASSES], np.log1p(50 * 1 / n)) and np.isclose(x[0, M.CLASSES + 1], np.log1p(50 * 2 / n))
    assert np.isclose(x[0, M.CLASSES + 4], 4 / 7) and np.isclose(x[0, M.CLASSES + 5], 4 / 5)
    assert (x[1] == x[2]).all()
    # pieces of a long text add up
    long = "One two, three! " * 200_000
    y = M.features(pa.array([long, "One two, three! " * 10]))
    assert np.allclose(y[0, :M._INNER], y[1, :M._INNER]) and np.isclose(y[0, M._INNER], np.log1p(len(long)))


def test_edge_rows(spark, model):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (None, ""), (3, "é" * 3_000_000), (4, "!" * 50)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("mine"), "_score": F.lit(1), "c0": F.lit(2), "_t": F.lit(3)})
    out = M.score(docs, model)
    got = out.collect()
    assert sorted(out.columns) == sorted(docs.columns) and len(got) == len(rows)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, None)}) == 1 and {r["_score"] for r in got} == {1}
    assert M.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 7)], "doc_id long, quality int")
    untaught = M.fit(docs, labels)
    assert not untaught.weights.any() and {r["score"] for r in M.score(docs, untaught).collect()} == {M.LIMIT}
