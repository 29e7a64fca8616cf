"""Recall of the graph search on rows that are no uniform sphere."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlake.llm import ann


def clusters(rng, spread):
    middle = rng.normal(size=(60, 24))
    return middle[rng.integers(0, 60, 2500)] + spread * rng.normal(size=(2500, 24))


ROWS = {"clusters": lambda rng: clusters(rng, 0.02), "far clusters": lambda rng: clusters(rng, 0.02) * 10.0 ** rng.integers(-2, 3, (2500, 1)),
        "norms": lambda rng: rng.normal(size=(2500, 24)) * np.exp(3 * rng.normal(size=(2500, 1))),
        "one long": lambda rng: np.concatenate([rng.normal(size=(2499, 24)), np.full((1, 24), -1e5)]),
        "huge": lambda rng: clusters(rng, 0.1) * 1e120}


@pytest.mark.parametrize("kind", ROWS)
def test_recall(kind):
    x = ROWS[kind](np.random.default_rng(1))
    graph, entry = ann.build(x)
    q = x[::20]
    found, _ = ann.search(x, graph, entry, q, 20)
    scale = np.abs(x).max()
    exact = (q / scale) @ (x / scale).T
    least = np.sort(exact, axis=1)[:, -20]
    hit = np.take_along_axis(exact, found, axis=1) >= least[:, None] - 1e-12
    assert hit.mean() >= 0.97


def test_neighbours_come_once():
    """Also where a random edge of a node leads to one of its pruned neighbours."""
    x = np.random.default_rng(5).normal(size=(500, 64))
    graph, entry = ann.build(x)
    found, _ = ann.search(x, graph, entry, x[::20], 21)
    assert [len(set(r)) for r in found.tolist()] == [21] * 25


def plain_prune(x, own, cands, degree, alpha):
    apart = lambda a, b: ((x[a] - x[b]) ** 2).sum()
    kept = []
    for c in sorted({c for c in cands if c >= 0 and c != own}, key=lambda c: apart(own, c)):
        if len(kept) < degree and all(alpha * alpha * apart(k, c) > apart(own, c) for k in kept):
            kept.append(c)
    return kept + [-1] * (degree - len(kept))


def test_prune_of_kept_neighbours_and_new_ones():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    sq, own = (x * x).sum(axis=1), np.arange(300)
    first = ann.robust_prune(x, sq, own, rng.integers(-1, 400, (300, 60)), 12, 1.0)
    cands = np.concatenate([first, rng.integers(-1, 400, (300, 9))], axis=1)
    again = ann.robust_prune(x, sq, own, cands, 12, 1.3, 12)
    assert again.tolist() == [plain_prune(x, o, c, 12, 1.3) for o, c in zip(own, cands)]


def test_only_checked_queries_try_beams(monkeypatch):
    """Whether a beam is wide enough shows on the checked queries; the others are searched once."""
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(1500, 48)), rng.normal(size=(600, 48))
    graph, entry = ann.build(x)
    walked, walk = {}, ann.beam_search

    def counted(x, sq, graph, entries, queries, beam):
        walked[beam] = walked.get(beam, 0) + len(queries)
        return walk(x, sq, graph, entries, queries, beam)
    monkeypatch.setattr(ann, "beam_search", counted)
    found, _ = ann.search(x, graph, entry, q, 20, beam=24)
    assert len(walked) > 1 and walked.pop(max(walked)) >= len(q)
    assert set(walked.values()) == {ann.CHECKED}
    least = np.sort(q @ x.T, axis=1)[:, -20:-19]
    assert (np.take_along_axis(q @ x.T, found, axis=1) >= least - 1e-9).mean() >= 0.98


def test_a_task_sends_on_the_best_of_its_shards():
    """One result a query from all shards of a group, ids of any sign, absent ones left out."""
    rng = np.random.default_rng(4)
    ids, x = np.arange(-45, 45), rng.normal(size=(90, 8)).astype(np.float32)
    table = lambda at, **more: pa.table({"rep": ids[at], "e": pa.array(list(x[at]))} | {
        c: pa.array([v] * len(ids[at]), pa.int32()) for c, v in more.items()})
    shards = [ann._index_shard(table(slice(i, None, 3), dim=8, shard=i)) for i in range(3)]
    queries = [ann._pack_queries(table(slice(i, i + 30), dim=8, block=i)) for i in (0, 30)]
    t = pa.concat_tables([*shards, *queries])
    t = t.add_column(1, "group", pa.array([0] * len(t), pa.int32()))
    exact = x.astype(float) @ x.astype(float).T
    for k, n in ((5, 5), (100, 90)):
        got = pa.Table.from_batches(ann._answer(t.to_batches(max_chunksize=2), k))
        assert len(got) == 60 * n
        for i in (0, 17, 59):
            mine = {c: s for q, c, s in zip(*(got[c].to_pylist() for c in ("q", "c", "score"))) if q == ids[i]}
            assert sorted(mine) == sorted(ids[np.argsort(-exact[i])[:n]])
            assert all(s == pytest.approx(exact[i, c + 45]) for c, s in mine.items())


def test_vectors_of_doubles_and_of_two_lengths(spark):
    rows = [(i, [float(i % 7 + 1), 1e-9 * i]) for i in range(60)] + [(100 + i, [1.0, 0.0, float(i + 1)]) for i in range(40)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(t, F.col("vec_id") % 20 == 0, k=3, shard=16, query_block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    x = dict(rows)
    score = lambda a, b: sum(p * q for p, q in zip(x[a], x[b]))
    for q in (i for i in x if i % 20 == 0):
        best = sorted((-score(q, i), i) for i in x if i != q and len(x[i]) == len(x[q]))[:3]
        assert [(i, pytest.approx(-s)) for s, i in best] == got[q]
