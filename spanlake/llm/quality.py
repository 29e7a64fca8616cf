"""Quality classifier by Bradley-Terry ranking.

A document's strength is linear in features of its text: shares of character classes,
neighbouring capitals and marks, word lengths, and how few words and word triples repeat.  A
pair prefers a document of label 1 to one of label 0 with the probability
``1 / (1 + exp(weak - strong))``; the weights maximise the likelihood of sampled preference
pairs, a logistic loss on feature differences solved by Newton steps.  The cut is a quantile
of the training documents' strengths: the one that parts the labels with the least weighted
error (the middle, if several do).  A score is the probability to be preferred to a document
at the cut, with odds moved so that the cut itself scores ``LIMIT``.

Training takes at most ``FIT_ROWS`` labelled documents of each label, those with the least
hashes of doc_id, and ``PARTNERS`` partners for each; their features are all that reaches
the driver.  Every document is scored in Arrow batches of bounded passes.

Defined results: null and empty texts have zero features and a score like any other; a text
over ``PIECE`` bytes is measured in pieces whose counts add up; repeated rows score alike;
of rows that share a doc_id the least text
teaches; labels other than 0 and 1, and null ids, teach nothing; without documents of both labels all
weights are 0 and every score is ``LIMIT``; further columns pass through ``score`` and are
ignored by the query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.llm.common import doc_ranges, python_ready, table, utf8
from spanlake.llm.shingles import word_hashes

FOLDS, LIMIT = 5, 0.3
FIT_ROWS, PARTNERS, SEED = 4000, 8, 11
RIDGE, ROUNDS, QUANTILES = 1.0, 25, 1000
PIECE = 1 << 20

#: Classes of bytes: every ASCII mark its own, then letters, digits, blanks and the rest.
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _LEAD, _INNER, _CONTROL = range(len(_MARKS), len(_MARKS) + 8)
CLASSES = len(_MARKS) + 8


def _class(b: int) -> int:
    if b >= 0x80:
        return _INNER if b < 0xC0 else _LEAD
    c = chr(b)
    if c.isalnum():
        return _DIGIT if c.isdigit() else _UPPER if c.isupper() else _LOWER
    return _MARKS.index(b) if b in _MARKS else _SPACE if c in " \t" else _LINE if c in "\r\n" else _CONTROL


_CLASS = np.array([_class(b) for b in range(256)], np.int64)
#: Counts per piece: classes, capital pairs, mark pairs, words, distinct words, triples, distinct triples.
COUNTS = CLASSES + 6
FEATURES = CLASSES + 6


def _distinct(h: np.ndarray, piece: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, piece))
    h, piece = h[order], piece[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (piece[1:] != piece[:-1])
    return np.bincount(piece[new], minlength=n)


def _count(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The counts of every piece (rows) of a pass."""
    n = len(offsets) - 1
    out = np.zeros((n, COUNTS))
    piece = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS[data]
    out[:, :CLASSES] = np.bincount(piece * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    together = piece[1:] == piece[:-1]
    upper, mark = kind == _UPPER, kind < len(_MARKS)
    out[:, CLASSES] = np.bincount(piece[1:][together & upper[1:] & upper[:-1]], minlength=n)
    out[:, CLASSES + 1] = np.bincount(piece[1:][together & mark[1:] & mark[:-1]], minlength=n)
    h, per = word_hashes(data, offsets)
    of = np.repeat(np.arange(n), per)
    out[:, CLASSES + 2] = per
    out[:, CLASSES + 3] = _distinct(h, of, n)
    if len(h) > 2:
        triple = (h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:]
        inside = of[:-2] == of[2:]
        out[:, CLASSES + 4] = np.maximum(per - 2, 0)
        out[:, CLASSES + 5] = _distinct(triple[inside], of[:-2][inside], n)
    return out


def features(col) -> np.ndarray:
    """A row of features for every text of an Arrow column."""
    data, offsets = utf8(col)
    size = np.diff(offsets)
    parts = np.maximum(-(-size // PIECE), 1)
    doc = np.repeat(np.arange(len(size)), parts)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = np.append(offsets[doc] + inner * PIECE, offsets[-1])
    total = np.zeros((len(size), COUNTS))
    for i, j in doc_ranges(cuts):
        np.add.at(total, doc[i:j], _count(data[cuts[i]:cuts[j]], cuts[i:j + 1] - cuts[i]))
    chars = total[:, :CLASSES].sum(axis=1) - total[:, _INNER]
    some = np.maximum(chars, 1)[:, None]
    out = np.zeros((len(size), FEATURES))
    out[:, :CLASSES + 2] = np.log1p(50 * total[:, :CLASSES + 2] / some)
    out[:, _INNER] = np.log1p(chars)
    words, triples = total[:, CLASSES + 2], total[:, CLASSES + 4]
    letters = total[:, [_UPPER, _LOWER, _DIGIT, _LEAD]].sum(axis=1)
    out[:, CLASSES + 2] = np.where(words > 0, letters / np.maximum(words, 1), 0)
    out[:, CLASSES + 3] = np.log1p(50 * words / some[:, 0])
    out[:, CLASSES + 4] = np.where(words > 0, total[:, CLASSES + 3] / np.maximum(words, 1), 1)
    out[:, CLASSES + 5] = np.where(triples > 0, total[:, CLASSES + 5] / np.maximum(triples, 1), 1)
    return out


@dataclass
class Model:
    """Weights of the features and the strength that scores ``LIMIT``."""

    weights: np.ndarray
    cut: float = 0.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x * self.weights).sum(axis=1)  # row by row: equal texts score alike wherever they stand

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = self.strength(x) - self.cut + math.log(LIMIT / (1 - LIMIT))
        return np.where(odds == math.log(LIMIT / (1 - LIMIT)), LIMIT, 1 / (1 + np.exp(-np.clip(odds, -500, 500))))


def pairs(n_good: int, n_bad: int, partners: int = PARTNERS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of preferred and other documents: ``partners`` drawn for each document."""
    draw = np.random.default_rng(seed)
    good = np.concatenate([np.repeat(np.arange(n_good), partners), draw.integers(0, n_good, n_bad * partners)])
    bad = np.concatenate([draw.integers(0, n_bad, n_good * partners), np.repeat(np.arange(n_bad), partners)])
    return good, bad


def rank_weights(diff: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of least logistic loss of the preference pairs' feature differences."""

    def loss(w):
        return np.logaddexp(0, -(diff @ w)).sum() + ridge / 2 * w @ w

    w = np.zeros(diff.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(diff @ w))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff + ridge * np.eye(len(w)), diff.T @ p - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        last, now = now, loss(w)
        if last - now < 1e-6 * last:
            break
    return w


def quantile_cut(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> float:
    """The quantile of all strengths (a label weighs its documents' number) with the least
    weighted error; the middle one of those."""
    s = np.concatenate([good, bad])
    weight = np.concatenate([np.full(len(good), n_good / len(good)), np.full(len(bad), n_bad / len(bad))])
    order = np.argsort(s, kind="stable")
    s, weight = s[order], weight[order]
    share = np.cumsum(weight) / weight.sum()
    at = np.searchsorted(share, np.arange(QUANTILES + 1) / QUANTILES)
    at = np.unique(np.minimum(at, len(s) - 1))
    tries = np.unique(np.concatenate([s[at], (s[at] + s[np.maximum(at - 1, 0)]) / 2]))
    miss = (n_good * np.searchsorted(np.sort(good), tries) / len(good)
            + n_bad * (len(bad) - np.searchsorted(np.sort(bad), tries)) / len(bad))
    best = tries[miss <= miss.min() * (1 + 1e-9)]
    return float((best[0] + best[-1]) / 2)


def train(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> Model:
    """A model from features of preferred and other documents, which stand for ``n_good`` and
    ``n_bad`` ones."""
    if not len(good) or not len(bad):
        return Model(np.zeros(FEATURES))
    spread = np.concatenate([good, bad]).std(axis=0)
    scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)
    i, j = pairs(len(good), len(bad))
    model = Model(rank_weights((good[i] - bad[j]) * scale) * scale)
    model.cut = quantile_cut(model.strength(good), model.strength(bad), n_good, n_bad)
    return model


def _features(batches):
    for b in batches:
        x = features(b.column(1))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))],
            names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", rows: int = FIT_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, 0 or 1)."""
    python_ready(docs)
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).distinct()
    count = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    first = Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id")
    some = marked.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= rows).drop("_place")
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col(text).cast("string").alias("_text"))
    # at most 2 * rows ids: broadcast, so that no text is shuffled but the chosen ones
    one = texts.join(F.broadcast(some), F.col("_doc") == F.col("_id")).groupBy("_id", "_label").agg(F.min("_text").alias("text"))
    got = one.select(F.col("_label").alias("label"), "text").mapInArrow(
        _features, "label int, x array<double>").collect()
    x = {k: np.array(sorted(r["x"] for r in got if r["label"] == k)).reshape(-1, FEATURES) for k in (0, 1)}
    return train(x[1], x[0], count.get(1, 0), count.get(0, 0))


def _scores(model: Model, position: int):
    def run(batches):
        for b in batches:
            s = model.score(features(b.column(position)))
            keep = [b.column(k) for k in range(b.num_columns) if k != position]
            names = [b.schema.names[k] for k in range(b.num_columns) if k != position]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(s)], names=[*names, "_score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every text (a column of that name is replaced)."""
    python_ready(docs)
    rest = docs.drop(name)
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest.columns)]
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rest.schema.fields)) + ", _score double"
    found = rest.select(*kept, F.col(text).cast("string").alias("_t")).mapInArrow(_scores(model, len(kept)), schema)
    return found.toDF(*rest.columns, name)


def filter_quality(docs: DataFrame, model: Model, text: str = "text", limit: float = LIMIT) -> DataFrame:
    """The documents that score ``limit`` or more."""
    found = score(docs, model, text, "_quality_score")
    return found.where(F.col("_quality_score") >= limit).drop("_quality_score")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    found = score(rows, fit(docs, labels)).drop("text")
    return found.withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
