"""Language identification by rank-order profiles (out-of-place distance).

A text's letters (lower-cased; every other character is a blank) give character n-grams
of one to three characters; its profile is its ``top`` most frequent n-grams in order of
frequency (ties: by code points).  A language's profile is made the same way from labelled
texts.  The distance to a language is the sum, over the n-grams of the text's profile, of
how far each is out of place in the language's profile (absent: ``size``); the nearest
language wins (ties: the smaller name).  The score is ``1 - distance / largest distance``.

The profiles are fitted on at most ``per_lang`` distinct labelled texts of each language
(those with the smallest hash of the text: independent of order, source and id), a bounded
sample; prediction reads every whole text.  At most ``MAX_LANGS`` labels are accepted, so
the shipped profiles are bounded.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is
every text when nothing was learned; labels that are null teach nothing; repeated texts
teach once; a null doc_id is not held out and teaches nothing.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanlake.llm.common import python_ready, table

TOP = 300
SIZE = 1000
PER_LANG = 400
MAX_LANGS = 2000
CHUNK_CHARS = 1 << 20
FOLDS = 5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=np.uint8).astype(bool)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of a text's n-grams; a key packs up to three code points."""
    keys, counts = [], []
    letters = _letters()
    prev = np.zeros(0, np.int64)
    text = text or ""
    for i in range(0, len(text), CHUNK_CHARS):
        cp = np.frombuffer(text[i:i + CHUNK_CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.where(letters[cp], cp, 32).astype(np.int64)
        cur = np.concatenate([prev if i else np.array([32]), cp])
        n_prev = len(cur) - len(cp)
        if i + CHUNK_CHARS >= len(text):
            cur = np.append(cur, 32)
        is_letter = cur != 32
        one = cur[n_prev:][is_letter[n_prev:]]
        a = max(n_prev - 1, 0)
        two = ((cur[a:-1] << 21) | cur[a + 1:])[is_letter[a:-1] | is_letter[a + 1:]]
        b = max(n_prev - 2, 0)
        three = ((cur[b:-2] << 42) | (cur[b + 1:-1] << 21) | cur[b + 2:])[is_letter[b + 1:-1]]
        k, c = np.unique(np.concatenate([one, two, three]), return_counts=True)
        keys.append(k)
        counts.append(c)
        prev = cur[-2:]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def profile(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The ``top`` most frequent keys, most frequent first, ties by key."""
    if len(keys) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """Language profiles as one sorted key list with a rank per language."""

    def __init__(self, ranked: dict[str, list[int]], size: int = SIZE):
        self.langs, self.size = sorted(ranked), size
        self.keys = np.unique(np.array([k for ks in ranked.values() for k in ks], np.int64))
        self.rank = np.full((len(self.keys) + 1, len(self.langs)), size, np.int64)
        for j, name in enumerate(self.langs):
            self.rank[np.searchsorted(self.keys, np.array(ranked[name], np.int64)), j] = np.arange(len(ranked[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        p = profile(*grams(text))
        if not len(p) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.keys, p)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == p, at, len(self.keys))
        rank = self.rank[at]
        away = np.where(rank == self.size, self.size, np.abs(rank - np.arange(len(p))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.langs[best], float(max(0.0, 1 - away[best] / (len(p) * self.size)))


def _count_grams(batches):
    for b in batches:
        by: dict[str, list] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(grams(text))
        for lang, got in by.items():
            k, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            n = np.bincount(at, np.concatenate([g[1] for g in got]), minlength=len(k)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n)],
                                             names=["lang", "gram", "n"])


def fit(labelled: DataFrame, per_lang: int = PER_LANG, size: int = SIZE) -> dict[str, list[int]]:
    """Profiles from (text, lang) rows: lang -> ranked n-gram keys."""
    python_ready(labelled)
    rows = labelled.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("h"))
    first = Window.partitionBy("lang").orderBy("h")
    bound = (rows.select("lang", "h").distinct().withColumn("r", F.row_number().over(first))
             .where(F.col("r") <= per_lang).groupBy("lang").agg(F.max("h").alias("most")))
    limits = bound.limit(MAX_LANGS + 1).collect()
    if not limits:
        return {}
    if len(limits) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} language labels")
    spark = labelled.sparkSession
    small = spark.createDataFrame([(r["lang"], r["most"]) for r in limits], "lang string, most long")
    sample = (rows.join(F.broadcast(small), "lang").where("h <= most").groupBy("lang", "h")
              .agg(F.first("text").alias("text")).select("lang", "text"))
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (sample.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram")
           .agg(F.sum("n").alias("n")).withColumn("r", F.row_number().over(most)).where(F.col("r") <= size))
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = SIZE) -> DataFrame:
    """``docs`` (which needs ``text``) with ``lang_pred`` and ``score``; columns of these names
    are replaced."""
    python_ready(docs)
    rest = docs.drop("lang_pred", "score")
    at = rest.columns.index("text")

    def run(batches):
        p = Profiles(profiles, size)
        for b in batches:
            got = [p.predict(x.as_py()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*b.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()),
                                              T.StructField("score", T.DoubleType())]))


def held_out(doc_id="doc_id", folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def fit_documents(docs: DataFrame) -> dict[str, list[int]]:
    return fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    found = predict(rows, fit_documents(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")
