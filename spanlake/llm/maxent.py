"""Language-model scoring with a hashed maximum-entropy model.

Tokens are lower-cased (A-Z) runs of non-blanks; every text ends with one end token.  The
corpus is turned once into blocks: a dictionary of 64-bit token hashes and the texts as
indices into it.  Dictionaries are dealt by hash to count every training token over the
whole corpus, and each block gets back the counts of its own tokens, so no task holds the
vocabulary and nothing but fixed-size tables reaches the driver.

Model: ``P(token | history) = P(class | history) * P(token | class)``.  The ``OWN`` most
frequent training tokens are classes of their own, the rest fall into the other classes by
their ending (two last characters before any punctuation).  The class is a softmax over hashed
features of the history (bias, previous token, previous two, the one before the previous); in
a class a token has its smoothed training share.

Training starts from the features' own class counts, ``START`` of the log ratio to the classes'
shares, and takes ``ROUNDS`` distributed gradient steps: every task sums the expected class
counts of all its training positions under the common weights, the tasks' sums are added up,
and the weights move along observed less expected counts, scaled by their size.  A round sums
over positions, so neither the layout of the corpus nor the cut into blocks decides anything
(but for the rounding of sums).  Equal histories of a few blocks are evaluated once and weigh as
often as they occur.  Scoring gathers the few weights of each position.

A block's large cells are compressed where they are made (frequent tokens have small numbers, so
their upper bytes are nearly all zero), so Spark reads, shuffles and holds small rows.

Defined results: null and empty texts are one end token; a null doc_id is not held out and
teaches nothing; with nothing to learn all counts are 0; repeated rows are scored (and
taught) each; further columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import materialize, python_ready, shuffle_partitions, table
from spanlake.llm.shingles import mix

FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 8 << 20
CLASSES, OWN = 64, 24
SLOTS = 1 << 14
#: Positions handled at a time: a batch's rows of weights stay in the processor's caches; sums
#: by slot and counts take more at a time.
BATCH, SUM_BATCH, COUNT_BATCH = 1 << 11, 1 << 16, 1 << 18
#: Training positions from which a task evaluates the histories it has gathered.
GATHERED = 1 << 21
#: Rows of a batch whose texts are Python objects at a time.
ROWS = 256
#: Words of all blocks' dictionaries that one group of the count takes at most, but for chance.
BUCKET_WORDS = 1 << 20
ROUNDS, START, RATE, PRIOR = 4, 0.5, 0.3, 50.0
PARTS = 16
END = b""
_END_HASH = np.uint64(xxhash.xxh3_64_intdigest(END))
_START = np.uint64(0x5851F42D4C957F2D)


def tokens(text: str | None) -> list[bytes]:
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


@lru_cache(1 << 16)
def _tail_class(tail: bytes) -> int:
    return OWN + xxhash.xxh3_64_intdigest(tail) % (CLASSES - OWN)


def ending(word: bytes) -> int:
    """The class of a token that is not one of its own."""
    tail = word[-2:]
    if not tail.isalnum():  # else it has neither punctuation nor parts of longer characters
        tail = word.decode().rstrip(string.punctuation)[-2:].encode()
    return _tail_class(tail)


_ZSTD = pa.Codec("zstd")


def pack(x: np.ndarray) -> bytes:
    """A cell of numbers: size, then the compressed bytes, first those of the lowest place."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return np.int64(x.nbytes).tobytes() + _ZSTD.compress(planes, asbytes=True)


def unpack(cell: bytes, dtype) -> np.ndarray:
    size = int(np.frombuffer(cell, np.int64, 1)[0])
    planes = np.frombuffer(_ZSTD.decompress(memoryview(cell)[8:], size), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


class _Numbers(dict):
    """Numbers by order of appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _make_blocks(batches):
    """Rows of (block, doc ids, flags, lengths, tokens, dictionary, its classes, training counts, its size)."""

    def close():
        length, flag = np.array(lengths, np.int64), np.array(train, bool)
        ids_ = np.concatenate(parts)
        often = np.argsort(-np.bincount(ids_), kind="stable")
        rank = np.empty(len(often), np.int32)
        rank[often] = np.arange(len(often), dtype=np.int32)
        ids_ = rank[ids_]
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[often]
        kind = np.fromiter(map(ending, names), np.uint8, len(names))[often]
        count = np.bincount(ids_[np.repeat(flag, length)], minlength=len(h))
        return pa.RecordBatch.from_arrays(
            [pa.array([xxhash.xxh3_64_hexdigest(h.tobytes() + length.tobytes() + repr(docs[:4]).encode()) + f"-{seq}"]),
             pa.array([docs], pa.list_(pa.int64())), pa.array([np.array(held, bool).tobytes()]), pa.array([flag.tobytes()]),
             pa.array([length.astype(np.int32).tobytes()]), pa.array([pack(ids_)]),
             pa.array([h.tobytes()]), pa.array([pack(kind)]),
             pa.array([pack(count.astype(np.int64))]), pa.array([len(h)], pa.int64())],
            names=["block", "docs", "held", "train", "lengths", "tokens", "dictionary", "kinds", "counts", "n_words"])

    names, docs, held, train, lengths, parts, size, seq = _Numbers(), [], [], [], [], [], 0, 0
    for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        for doc, out, fit, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = tokens(text)
            parts.append(np.fromiter(map(names.__getitem__, words), np.int32, len(words)))
            docs.append(doc)
            held.append(out)
            train.append(fit)
            lengths.append(len(words))
            size += len(text or "")
            if size >= BLOCK_BYTES or len(docs) >= 20_000:
                yield close()
                names, docs, held, train, lengths, parts, size, seq = _Numbers(), [], [], [], [], [], 0, seq + 1
    if docs:
        yield close()


BLOCK_SCHEMA = ("block string, docs array<long>, held binary, train binary, lengths binary, tokens binary, "
                "dictionary binary, kinds binary, counts binary, n_words long")


def blocks(docs: DataFrame, held_out, train) -> DataFrame:
    python_ready(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), train.alias("train"),
                       F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_make_blocks, BLOCK_SCHEMA).withColumn("part", F.spark_partition_id())
                       .withColumn("block", F.concat("block", F.lit("-"), F.col("part").cast("string"))).drop("part"), "lm-blocks")


def _by_bucket(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket, bounds of the buckets) of a dictionary."""
    bucket = (h % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def buckets(corpus: DataFrame) -> int:
    """Buckets of the count: more than the shuffle's partitions once these would hold too much."""
    n = corpus.agg(F.sum("n_words")).first()[0] or 0
    return max(shuffle_partitions(corpus.sparkSession), -(-n // BUCKET_WORDS))


def _deal(n):
    def run(batches):
        for b in batches:
            for block, d, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                h, kind, count = np.frombuffer(d, np.uint64), unpack(k, np.uint8), unpack(c, np.int64)
                order, at = _by_bucket(h, n)
                h, kind, count = h[order], kind[order], count[order]
                full = np.flatnonzero(at[1:] > at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(full), pa.string()), pa.array(full.astype(np.int32)),
                     *[pa.array([cell(x[at[i]:at[i + 1]]) for i in full], pa.binary())
                       for x, cell in ((h, np.ndarray.tobytes), (kind, np.ndarray.tobytes), (count, pack))]],
                    names=["block", "bucket", "hashes", "kinds", "counts"])

    return run


def _sum_bucket(t: pa.Table) -> pa.Table:
    """Global counts of a bucket's tokens, for each block that has them; and, in a row without
    block, per class the tokens and distinct tokens, and the bucket's most frequent ones."""
    hashes = [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()]
    every = np.concatenate(hashes)
    h, first, at = np.unique(every, return_index=True, return_inverse=True)
    kind = np.concatenate([np.frombuffer(x, np.uint8) for x in t["kinds"].to_pylist()])[first].astype(np.int64)
    c = np.bincount(at, np.concatenate([unpack(x, np.int64) for x in t["counts"].to_pylist()]),
                    minlength=len(h)).astype(np.int64)
    ends = np.cumsum([len(x) for x in hashes])
    out = [pack(c[at[z - len(x):z]]) for x, z in zip(hashes, ends, strict=True)]
    top = np.lexsort((h, -c))[:OWN]
    stats = np.concatenate([np.bincount(kind, c, CLASSES), np.bincount(kind, c > 0, CLASSES)]).astype(np.int64)
    best = np.concatenate([h[top], c[top].astype(np.uint64), kind[top].astype(np.uint64)])
    return pa.table({"block": pa.array([*t["block"].to_pylist(), None], pa.string()),
                     "bucket": pa.array([*t["bucket"].to_pylist(), t["bucket"][0].as_py()], pa.int32()),
                     "counts": pa.array([*out, None], pa.binary()),
                     "stats": pa.array([*[None] * len(out), stats.tobytes()], pa.binary()),
                     "top": pa.array([*[None] * len(out), best.tobytes()], pa.binary())})


@dataclass
class Model:
    """Sizes, the tokens that are classes of their own, class totals and weights."""

    n: int
    v: int
    own: np.ndarray
    class_n: np.ndarray
    class_v: np.ndarray
    weights: np.ndarray | None = None

    def classes(self, h: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        out = kinds.astype(np.int64)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
            is_own = self.own[at] == h
            out[is_own] = at[is_own]
        return out


def features(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weight rows (positions x 4) of token hashes ``h``; ``first``: the texts' first positions."""
    one = np.empty_like(h)
    two = np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    two[:2] = _START
    one[first] = two[first] = _START
    second = first[first + 1 < len(h)] + 1
    two[second] = _START
    out = np.zeros((4, len(h)), np.int64)
    n, mixed = np.uint64(SLOTS - 1), mix(one)
    for row, x in zip(out[1:], (mixed, mix(mixed + two), mix(two ^ np.uint64(0xA5A5A5A5A5A5A5A5))), strict=True):
        row[:] = x - x // n * n  # the remainder; a division by one number is the faster way to it
        row += 1
    return out.T


def chances(w: np.ndarray, f: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """The classes' probabilities after every history (rows).  Weights are logs of ratios of
    smoothed counts and some bounded steps, so their sums need no shift before ``exp``.
    ``room``: two tables of rows, used again by every call; the result is in the first."""
    z, other = np.empty((2, len(f), w.shape[1]), w.dtype) if room is None else room[:, :len(f)]
    w.take(f[:, 1], axis=0, out=z, mode="clip")
    for k in (2, 3):
        z += w.take(f[:, k], axis=0, out=other, mode="clip")
    z += w[0]
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _positions(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    length = np.frombuffer(r["lengths"], np.int32).astype(np.int64)
    tok = unpack(r["tokens"], np.int32)
    d = np.frombuffer(r["dictionary"], np.uint64)
    return length, np.cumsum(length) - length, tok, d


def _training(r: dict, model: Model, batch: int):
    """(features, classes) of a block's training positions, a batch at a time."""
    length, first, tok, d = _positions(r)
    keep = np.repeat(np.frombuffer(r["train"], bool), length)
    starts = np.zeros(len(tok), bool)
    starts[first] = True
    h, starts, y = d[tok][keep], starts[keep], model.classes(d, unpack(r["kinds"], np.uint8))[tok[keep]]
    for i in range(0, len(y), batch):
        a = max(i - 2, 0)
        yield features(h[a:i + batch], np.flatnonzero(starts[a:i + batch]))[i - a:], y[i:i + batch]


def observed(f: np.ndarray, y: np.ndarray, total: np.ndarray) -> None:
    """Add the classes that follow every feature."""
    total[0] += np.bincount(y, minlength=CLASSES)
    for k in range(1, f.shape[1]):
        total += np.bincount(f[:, k] * CLASSES + y, minlength=total.size).reshape(total.shape)


def _keys(f: np.ndarray) -> np.ndarray:
    """One number for every row of features."""
    return (f[:, 1] * SLOTS + f[:, 2]) * SLOTS + f[:, 3]


def _unkeyed(keys: np.ndarray) -> np.ndarray:
    upper = keys // SLOTS
    one = upper // SLOTS
    return np.stack([np.zeros_like(keys), one, upper - one * SLOTS, keys - upper * SLOTS]).T


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.diff(np.append(at, len(keys)))


def histories(parts) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the distinct rows of the features in ``parts``, in order, and how often each occurs)."""
    return _distinct(np.concatenate([_keys(f) for f in parts]))


def expected(keys: np.ndarray, count: np.ndarray, w: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` (classes x slots) the classes that the weights expect after every feature
    of the ``histories`` with these keys, which occur ``count`` times."""
    rows = np.empty((2, BATCH, CLASSES), w.dtype)
    # a row's length is no power of two, else all rows' places meet in the same lines of the caches
    room = np.empty((CLASSES, min(len(keys), SUM_BATCH) + 8))
    for i in range(0, len(keys), SUM_BATCH):
        f = _unkeyed(keys[i:i + SUM_BATCH])
        p = room[:, :len(f)]
        for j in range(0, len(f), BATCH):
            z = chances(w, f[j:j + BATCH], rows)
            z *= count[i + j:i + j + len(z), None].astype(np.float32)
            p[:, j:j + len(z)] = z.T
        total[:, 0] += p.sum(axis=1)
        one = f[:, 1]
        at = np.flatnonzero(np.append(True, one[1:] != one[:-1]))  # equal ones are neighbours
        total[:, one[at]] += np.add.reduceat(p, at, axis=1)
        for k in (2, 3):
            for c in range(CLASSES):
                total[c] += np.bincount(f[:, k], p[c], SLOTS)


def _sums(model: Model):
    """A task's observed (without weights) or expected class counts of all its positions."""
    def run(batches):
        total = np.zeros((SLOTS, CLASSES) if model.weights is None else (CLASSES, SLOTS))
        keys, n = [], 0
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if not any(r["train"]):
                    continue
                if model.weights is None:
                    for f, y in _training(r, model, COUNT_BATCH):
                        observed(f, y, total)
                    continue
                for f, _ in _training(r, model, SUM_BATCH):
                    keys.append(_keys(f))
                    n += len(f)
                if n >= GATHERED:
                    some, keys, n = np.concatenate(keys), [], 0
                    expected(*_distinct(some), model.weights, total)
        if keys:
            expected(*_distinct(np.concatenate(keys)), model.weights, total)
        if model.weights is not None:
            total = np.ascontiguousarray(total.T)
        rows = SLOTS // PARTS
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(PARTS, dtype=np.int32)),
             pa.array([total[k * rows:(k + 1) * rows].astype(np.float32).tobytes() for k in range(PARTS)], pa.binary())],
            names=["part", "w"])

    return run


def _add(t: pa.Table) -> pa.Table:
    total = np.zeros(SLOTS // PARTS * CLASSES)
    for w in t["w"]:
        x = w.as_py()
        total += np.frombuffer(x, np.float32 if len(x) == 4 * len(total) else np.float64)
    return pa.table({"part": t["part"][:1], "w": pa.array([total.tobytes()], pa.binary())})


def totals(corpus: DataFrame, model: Model) -> np.ndarray:
    """The class counts of every feature over the whole corpus.  Every task writes one table of
    sums, so the tasks are as many as the cores keep busy, whatever the blocks' partitions; many
    tables are added in two levels."""
    schema = "part int, w binary"
    tasks = 2 * corpus.sparkSession.sparkContext.defaultParallelism
    some = corpus.select("train", "lengths", "tokens", "dictionary", "kinds").coalesce(tasks).mapInArrow(_sums(model), schema)
    if tasks > 64:
        some = some.withColumn("salt", F.spark_partition_id() % 16).groupBy("part", "salt").applyInArrow(_add, schema)
    some = some.groupBy("part").applyInArrow(_add, schema)
    out, rows = np.zeros((SLOTS, CLASSES)), SLOTS // PARTS
    for r in some.collect():
        out[r["part"] * rows:(r["part"] + 1) * rows] = np.frombuffer(r["w"], np.float64).reshape(rows, CLASSES)
    return out


def starting_weights(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, shares of the classes) from the observed class counts."""
    share = (seen[0] + 1) / (seen[0].sum() + CLASSES)
    w = START * np.log((seen + PRIOR * share) / (seen.sum(axis=1, keepdims=True) + PRIOR) / share)
    w[0] = np.log(share)
    return w, share


def step(w: np.ndarray, seen: np.ndarray, hoped: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The weights after a gradient step, scaled per weight by its counts."""
    return w + RATE * (seen - hoped) / (np.maximum(seen, hoped) + PRIOR * share)


def fit(corpus: DataFrame, counted: DataFrame) -> Model:
    """The model: class totals from the counts, weights from passes over all blocks."""
    stats = counted.where("block is null").select("stats", "top").collect()
    total = np.zeros(2 * CLASSES, np.int64)
    top = []
    for r in stats:
        total += np.frombuffer(r["stats"], np.int64)
        x = np.frombuffer(r["top"], np.uint64).reshape(3, -1)
        top += [(-int(c), int(h), int(k)) for h, c, k in x.T if c]
    own = sorted(top)[:OWN]
    class_n, class_v = total[:CLASSES].copy(), total[CLASSES:].copy()
    for c, _, k in own:
        class_n[k] += c
        class_v[k] -= 1
    model = Model(int(total[:CLASSES].sum()), int(total[CLASSES:].sum()), np.array(sorted(h for _, h, _ in own), np.uint64),
                  class_n, class_v)
    seen = totals(corpus, model)
    w, share = starting_weights(seen)
    for _ in range(ROUNDS):
        model.weights = w.astype(np.float32)
        w = step(w, seen, totals(corpus, model), share)
    model.weights = w.astype(np.float32)
    return model


def _score(model: Model, n_buckets: int):
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for r in t.to_pylist():
            length, first, tok, d = _positions(r)
            order, _ = _by_bucket(d, n_buckets)
            got = sorted(zip(replies["bucket"].to_pylist(), replies["counts"].to_pylist(), strict=True))
            c = np.empty(len(d), np.int64)
            c[order] = np.concatenate([unpack(x, np.int64) for _, x in got])
            kind = model.classes(d, unpack(r["kinds"], np.uint8))
            is_own = kind < OWN
            in_class = np.where(is_own, 0.0, np.log10((c + 1) / (model.class_n[kind] + model.class_v[kind] + 1)))
            base = np.log10(c + 1) - np.log10(model.n + model.v + 1)
            per = np.zeros(len(tok))
            h, doc_first = d[tok], np.zeros(len(tok), bool)
            doc_first[first] = True
            for i in range(0, len(tok), BATCH):
                a = max(i - 2, 0)
                f = features(h[a:i + BATCH], np.flatnonzero(doc_first[a:i + BATCH]))[i - a:]
                y = kind[tok[i:i + BATCH]]
                per[i:i + BATCH] = np.log10(chances(model.weights, f)[np.arange(len(y)), y])
            out.append(pa.table({
                "doc_id": pa.array(r["docs"], pa.int64()), "held_out": pa.array(np.frombuffer(r["held"], bool)),
                "n_tokens": pa.array(length), "n_known": pa.array(np.add.reduceat((c > 0)[tok].astype(np.int64), first)),
                "train_tokens": pa.array(np.full(len(length), model.n)),
                "base_score": pa.array(np.add.reduceat(base[tok], first)),
                "score": pa.array(np.add.reduceat(per + in_class[tok], first))}))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, held_out, train) -> DataFrame:
    """Scores of every row of ``docs`` under a model of the rows that ``train`` selects."""
    corpus = blocks(docs, held_out, train)
    n_buckets = buckets(corpus)
    counted = materialize(corpus.select("block", "dictionary", "kinds", "counts")
                          .mapInArrow(_deal(n_buckets), "block string, bucket int, hashes binary, kinds binary, counts binary")
                          .groupBy("bucket").applyInArrow(
                              _sum_bucket, "block string, bucket int, counts binary, stats binary, top binary"), "lm-counts")
    model = fit(corpus, counted)
    replies = counted.where("block is not null").select("block", "bucket", "counts")
    return corpus.select("block", "docs", "held", "lengths", "tokens", "dictionary", "kinds").groupBy("block").cogroup(
        replies.groupBy("block")).applyInArrow(
        _score(model, n_buckets), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")


def op6_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    held = F.coalesce(fold == HELD_OUT, F.lit(False))
    train = F.coalesce(fold != HELD_OUT, F.lit(False))
    return score(table(spark, sf_dir, "documents"), held, train)
