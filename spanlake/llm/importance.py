"""Importance resampling towards a target distribution, on pre-tokenised hashed n-grams.

An untrained ``Split`` pre-tokeniser cuts each ASCII-lowered text into words with offsets.
Every window of 1 to ``max_n`` consecutive offset pairs is a feature, its words joined by one
space, and falls into the bucket ``crc32 mod buckets`` of its UTF-8 bytes.  A text is read
once: its bucket histogram (at most ``buckets`` pairs, whatever its length) is stored, and
both the corpus histogram and the weights come from the stored rows.  A bucket's gain is the
smoothed log ratio of target to corpus in thousandths, a text's weight the floored mean of
its features' gains, its score the weight plus seeded Gumbel noise.  Of the texts with at
least ``min_words`` words the highest scores are drawn: Gumbel top-k, that is sampling
without replacement in proportion to ``exp(weight / 1000)``.  Only the two histograms
(``buckets`` rows) reach the driver; ranks come from a distributed sort of narrow rows.

Defined results: null and wordless texts have no features, weight 0 and take part in the
draw only if ``min_words`` is 0; a null doc_id reads as empty in the noise and ranks last
among ties; repeated rows are judged and ranked each; an empty corpus or target leaves all
counts of that side 0; long texts are cut at separators into pieces that are split one by
one, which changes no word; further columns are ignored (``resample`` passes them through).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from spanlake.llm.common import materialize, python_ready, table
from spanlake.operators.windows import global_row_number

BUCKETS, MAX_N, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
PIECE, CACHE, OUT_BYTES = 1 << 14, 1 << 18, 8 << 20

_WORDS = pre_tokenizers.Split(Regex(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), behavior="removed", invert=True)
_SEPARATOR = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]")

STORED = "doc_id long, n_words long, n_features long, ids binary, counts binary"


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of about ``limit`` characters that end at separators."""
    start = 0
    while len(text) - start > limit:
        cut = _SEPARATOR.search(text, start + limit)
        if not cut:
            break
        yield text[start:cut.end()]
        start = cut.end()
    yield text[start:]


def features(text: str, max_n: int = MAX_N) -> Iterator[tuple[int, list[str]]]:
    """(number of words, features) of every piece of a text: the windows that end in it."""
    tail: list[str] = []
    for piece in pieces(text.encode().lower().decode()):
        words = [word for word, _ in _WORDS.pre_tokenize_str(piece)]
        out = list(words)
        line = tail + words
        for n in range(2, max_n + 1):
            first = max(len(tail) - n + 1, 0)
            out += [" ".join(line[i:i + n]) for i in range(first, len(line) - n + 1)]
        tail = line[len(line) - max_n + 1:] if max_n > 1 else []
        yield len(words), out


def _stored(ids, words, sizes, hit, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hit, pa.binary()),
         pa.array(counts, pa.binary())], names=["doc_id", "n_words", "n_features", "ids", "counts"])


def _histograms(max_n: int, buckets: int):
    def run(batches):
        known: dict[str, int] = {}
        for b in batches:
            ids, words, sizes, hit, counts, held = [], [], [], [], [], 0
            for key, cell in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total = np.zeros(0, np.int64)
                n_words = n = 0
                for more, part in features(cell.as_py() or "", max_n):
                    at = []
                    for f in part:
                        k = known.get(f)
                        if k is None:
                            if len(known) >= CACHE:
                                known.clear()
                            k = known[f] = zlib.crc32(f.encode()) % buckets
                        at.append(k)
                    got = np.bincount(np.array(at, np.int64))
                    if len(got) < len(total):
                        total[:len(got)] += got
                    else:
                        got[:len(total)] += total
                        total = got
                    n += len(part)
                    n_words += more
                full = np.flatnonzero(total)
                ids.append(key)
                words.append(n_words)
                sizes.append(n)
                hit.append(full.astype(np.int32).tobytes())
                counts.append(total[full].astype(np.int64).tobytes())
                held += 12 * len(full)
                if held >= OUT_BYTES:
                    yield _stored(ids, words, sizes, hit, counts)
                    ids, words, sizes, hit, counts, held = [], [], [], [], [], 0
            if ids:
                yield _stored(ids, words, sizes, hit, counts)

    return run


def histograms(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_n: int = MAX_N,
               buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, ids, counts) per row: the bucket histogram of its text."""
    python_ready(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_histograms(max_n, buckets), STORED)


def _sum(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[np.frombuffer(i, np.int32)] += np.frombuffer(c, np.int64)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])

    return run


def corpus_histogram(stored: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the whole table fall into each bucket."""
    found = stored.select("ids", "counts").mapInArrow(_sum(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln(smoothed target share / smoothed corpus share))."""
    n = len(corpus)
    ratio = ((target + 1) * float(corpus.sum() + n)) / ((corpus + 1) * float(target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigh(gain: np.ndarray):
    def run(batches):
        for b in batches:
            out = []
            for n, i, c in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                out.append(int(gain[np.frombuffer(i, np.int32)] @ np.frombuffer(c, np.int64)) // n if n else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.int64())],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of seed and doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text",
           max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT,
           seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) per row of ``docs``; rank counts the
    drawn rows from 1, best first, and is null for the others."""
    stored = materialize(histograms(docs, text, doc_id, max_n, buckets), "importance-histograms")
    wanted = histograms(target.withColumn("_id", F.lit(0)), target_text, "_id", max_n, buckets)
    gain = gains(corpus_histogram(stored, buckets), corpus_histogram(wanted, buckets))
    weighed = stored.mapInArrow(_weigh(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = materialize(weighed.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")),
                         "importance-scores")
    n_drawn = scored.where(F.col("n_words") >= min_words).count() * percent // 100
    placed = global_row_number(scored.withColumn("_out", F.col("n_words") < min_words),
                               ["_out", F.desc("score"), F.asc_nulls_last("doc_id")], "_place", ["_out", "score", "doc_id"])
    drawn = ~F.col("_out") & (F.col("_place") < n_drawn)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score",
                         F.when(drawn, F.col("_place") + 1).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns (rows that share a doc_id are drawn together)."""
    ids = scores(docs, target, doc_id=doc_id, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col(doc_id).cast("long").eqNullSafe(F.col("_drawn")), "left_semi")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_CRC = """
bits(crc_of) as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: xor(c >> 1, (c & 1) * 3988292384), i))
)"""

SQL = f"""
with {_CRC},
texts as (select 'd' as side, doc_id, text from documents union all select 'b', null, text from benchmark),
split as (
  select side, doc_id, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
  from texts),
one as (select side, r, unnest(words) as word from split),
word_list as (select distinct word, hex(encode(word)) as h from one),
hashed as (
  select word, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint),
      lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 as bucket
  from word_list, bits),
counted as (select side, r, bucket, count(*) as n from one join hashed using (word) group by all),
totals as (
  select bucket, sum(n) filter (side = 'd') as s, sum(n) filter (side = 'b') as t from counted group by bucket),
sizes as (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from totals),
gain as (
  select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * (s_all + 10000)::double)
      / ((coalesce(s, 0) + 1)::double * (t_all + 10000)::double)))::bigint as g
  from totals, sizes),
weights as (select r, sum(n * g)::bigint as total from counted join gain using (bucket) where side = 'd' group by r),
scored as (
  select doc_id, len(words)::bigint as n_features, coalesce(floor(total::double / len(words)), 0)::bigint as weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from split left join weights using (r) where side = 'd'),
final as (
  select doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double))))::bigint as score from scored),
ranked as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last) as place,
    count(*) filter (n_features >= 20) over () as eligible
  from final)
select doc_id, n_features, weight, score,
  case when n_features >= 20 and place <= eligible * 10 // 100 then place::double end as rank  -- nullable numbers are doubles in pandas
from ranked
"""
