"""The gradient rounds of the maximum-entropy model."""

import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from spanlake.llm import maxent


def test_training_takes_several_rounds_over_all_classes():
    assert maxent.ROUNDS >= 4 and maxent.CLASSES >= 64 and maxent.OWN >= 24


def test_rounds_raise_the_training_likelihood():
    """Expected counts equal a sum position by position, and every round fits the texts better."""
    rng = np.random.default_rng(4)
    f = np.column_stack([np.zeros(3000, np.int64), rng.integers(1, 40, (3000, 3)) ** 2])
    y = (f[:, 1] + f[:, 2] * (rng.random(3000) < 0.7)) % maxent.CLASSES
    seen = np.zeros((maxent.SLOTS, maxent.CLASSES))
    maxent.observed(f, y, seen)
    w, share = maxent.starting_weights(seen)
    fits = []
    for _ in range(maxent.ROUNDS + 1):
        p = maxent.chances(w, f)
        fits.append(np.log(p[np.arange(len(y)), y]).sum())
        plain = np.zeros_like(seen)
        for k in range(4):
            np.add.at(plain, f[:, k], p)
        hoped = np.zeros((maxent.CLASSES, maxent.SLOTS))
        maxent.expected(*maxent.histories([f[:1000], f[1000:]]), w, hoped)
        assert np.allclose(hoped.T, plain, atol=1e-4)
        w = maxent.step(w, seen, hoped.T, share)
    assert all(b > a for a, b in zip(fits, fits[1:]))


def zipf_blocks(n_texts=400, seed=5):
    """Blocks of made texts with a few frequent and many rare words, and the texts' words."""
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, 250) % 50_000) for _ in range(n_texts)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n_texts), pa.int64()), pa.array([i % 7 == 2 for i in range(n_texts)]),
         pa.array([i % 7 != 2 for i in range(n_texts)]), pa.array(texts)], names=["doc_id", "held", "train", "text"])
    return list(maxent._make_blocks([batch])), [t.encode().split() + [maxent.END] for t in texts]


def test_cells_of_a_block_are_small_and_whole(monkeypatch):
    """The tokens and counts that Spark reads, shuffles and holds take under half of their plain bytes."""
    monkeypatch.setattr(maxent, "BLOCK_BYTES", 1 << 18)
    blocks, words = zipf_blocks()
    assert len(blocks) > 1
    got = []
    for b in blocks:
        r = b.to_pylist()[0]
        n = sum(np.frombuffer(r["lengths"], np.int32))
        assert len(r["tokens"]) < 2 * n and len(r["counts"]) < 4 * r["n_words"]
        d, tok = np.frombuffer(r["dictionary"], np.uint64), maxent.unpack(r["tokens"], np.int32)
        assert r["n_words"] == len(d) == len(set(d.tolist())) and len(tok) == n
        assert maxent.unpack(r["counts"], np.int64).sum() == sum(
            k for k, t in zip(np.frombuffer(r["lengths"], np.int32), r["train"]) if t)
        got += d[tok].tolist()
    assert got == [xxhash.xxh3_64_intdigest(w) for t in words for w in t]


def test_a_round_gathers_histories_over_blocks(monkeypatch):
    """A task's sums are those of its positions, however many it gathers before it adds them."""
    monkeypatch.setattr(maxent, "BLOCK_BYTES", 1 << 18)
    blocks, _ = zipf_blocks(200)
    model = maxent.Model(1, 1, np.zeros(0, np.uint64), np.ones(maxent.CLASSES), np.ones(maxent.CLASSES))
    w = np.random.default_rng(1).normal(0, 0.3, (maxent.SLOTS, maxent.CLASSES))
    plain, calls = np.zeros((maxent.SLOTS, maxent.CLASSES)), []
    for b in blocks:
        for f, _ in maxent._training(b.to_pylist()[0], model, 5000):
            p = maxent.chances(w, f)
            for k in range(4):
                np.add.at(plain, f[:, k], p)
    model.weights, whole = w, maxent.expected
    monkeypatch.setattr(maxent, "expected", lambda *x: (calls.append(len(x[0])), whole(*x)))
    for gathered, n in ((1, len(blocks)), (1 << 40, 1)):
        monkeypatch.setattr(maxent, "GATHERED", gathered)
        calls.clear()
        got = next(iter(maxent._sums(model)(blocks)))
        got = np.concatenate([np.frombuffer(x.as_py(), np.float32) for x in got["w"]]).reshape(plain.shape)
        assert len(calls) == n and np.allclose(got, plain, rtol=1e-4, atol=1e-3)


def test_endings_of_bytes_are_those_of_characters():
    words = ["", "a", "ab", "Haus", "mat.", "été", "ré", "é1", "x-", "--", "...", "1.5", "日本", "日a", "a日", "a_", "ok!?", "z\x00", " y"]
    for w in words:
        tail = w.rstrip(string.punctuation)[-2:]
        assert maxent.ending(w.encode()) == maxent.OWN + xxhash.xxh3_64_intdigest(tail.encode()) % (maxent.CLASSES - maxent.OWN)


def test_buckets_of_the_count_grow_with_the_dictionaries(spark, monkeypatch):
    """No group of the count holds more than its share; counts and scores are the same in any number of them."""
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(60))) for i in range(30)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = []
    for most in (1 << 20, 5):
        monkeypatch.setattr(maxent, "BUCKET_WORDS", most)
        got = maxent.score(docs.coalesce(1), F.lit(False), F.col("doc_id").isNotNull()).collect()
        out.append({r["doc_id"]: tuple(r)[1:6] + (round(r["score"], 3),) for r in got})
    assert out[0] == out[1] and len(out[0]) == 31
    corpus = maxent.blocks(docs.coalesce(1), F.lit(False), F.lit(True))
    n = corpus.agg(F.sum("n_words")).first()[0]
    assert n == 98 and maxent.buckets(corpus) == max(maxent.shuffle_partitions(spark), 20)
