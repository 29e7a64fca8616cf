"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Distinct vectors are dealt by a hash into shards of about ``SHARD`` vectors.  Each shard
gets a graph: vectors are inserted in batches, a greedy beam search proposes neighbours,
relaxed distance pruning (an edge stays unless a kept neighbour is ``alpha`` times closer to
its end) keeps diverse ones, and reverse edges are pruned the same way.  Inner product
becomes distance by one more coordinate that lifts all vectors of a shard to one norm.
Besides its pruned neighbours a point keeps ``LONG`` random ones, so tight clusters stay
connected; a search starts from several points, those of the largest norms among them.  It
beams through every shard's graph, in blocks of queries, and rescoring is exact in double
precision on the original vectors.  Every search is checked: for up to ``CHECKED`` of its
queries the shard's exact nearest are computed, and the beam is doubled while fewer than
``RECALL`` of them were found; the block is searched with the beam that they needed.  A task of
the search holds up to ``GROUP`` shards, lets the blocks pass and sends on each query's best.

Equal vectors are one point of the index; only the ``k + 1`` smallest ids of a point can
appear among a query's ``k`` nearest, so groups of equal vectors of any size cost as much
as small ones, and queries with equal vectors are searched once.

Defined results: rows without id, and vectors that are null, empty, zero or hold null or
non-finite components, take no part; vectors meet only those of their own dimension; rows
that repeat id and vector count once; ties go to the smaller id; with fewer candidates than
``k`` all are returned (a shard that is no larger than the beam is read whole); further
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlake.llm.common import materialize, python_ready, shuffle_partitions, table

SHARD = 4096
DEGREE, LONG = 32, 8
STARTS = 16
BEAM = 96
CHECKED, RECALL = 64, 0.99
ALPHA = 1.3
PASSES = 2
K = 20
QUERY_BLOCK = 2048
BATCH = 256
#: Shards that one task of the search holds at most.
GROUP = 8
#: Nodes of a beam that one step of a walk expands; cells of a table of distances.
WIDE = 16
TABLE = 1 << 18


def _lift(x: np.ndarray) -> np.ndarray:
    """Rows, scaled to components of at most 1, with one more coordinate, so that all have the
    largest norm.  Doubles: beside a few long vectors the short ones differ in late digits."""
    x = x / np.abs(x).max()
    sq = (x * x).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(sq.max() - sq, 0.0))])


def _walk(table: np.ndarray, graph: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beams of ``beam_search`` from a table of squared distances (a row a query, the last
    column infinite), which it overwrites: a cell once read is infinite.  Each step expands the
    ``WIDE`` nearest nodes of every beam that were not expanded yet."""
    q, cells = table.shape
    wide, m, flat = min(WIDE, beam), len(entries), table.reshape(-1)
    ids, dist = np.full((q, beam), -1, np.int64), np.full((q, beam), np.inf)
    ids[:, :m], dist[:, :m] = entries, table[:, entries]
    table[:, entries] = np.inf
    live, start = np.arange(q), np.arange(q)[:, None] * cells
    node, near_by, todo = ids.copy(), dist.copy(), np.isfinite(dist)
    while True:
        at = np.argpartition(np.where(todo, near_by, np.inf), wide - 1, axis=1)[:, :wide]
        open_ = np.take_along_axis(todo, at, axis=1)
        go = open_.any(axis=1)
        if not go.all():
            ids[live[~go]], dist[live[~go]] = node[~go], near_by[~go]
            live, start, node, near_by, todo, at, open_ = (a[go] for a in (live, start, node, near_by, todo, at, open_))
            if not len(live):
                break
        near = graph.take(np.where(open_, np.take_along_axis(node, at, axis=1), cells - 1), axis=0)
        np.put_along_axis(todo, at, False, axis=1)
        d = np.empty(near.shape)
        for w in range(wide):  # one node after the other: a common neighbour is read once
            cell = near[:, w] + start
            d[:, w] = flat.take(cell)
            flat[cell] = np.inf
        d = d.reshape(len(live), -1)
        dists = np.concatenate([near_by, d], axis=1)
        nodes = np.concatenate([node, near.reshape(d.shape)], axis=1)
        todos = np.concatenate([todo, np.isfinite(d)], axis=1)
        keep = dists <= np.partition(dists, beam - 1, axis=1)[:, beam - 1:beam]
        if np.count_nonzero(keep) == len(live) * beam:
            near_by, node, todo = (a[keep].reshape(len(live), beam) for a in (dists, nodes, todos))
        else:  # equal distances at the beam's end
            at = np.argpartition(dists, beam - 1, axis=1)[:, :beam]
            near_by, node, todo = (np.take_along_axis(a, at, axis=1) for a in (dists, nodes, todos))
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
    return np.where(np.isfinite(dist), ids, -1), dist


def beam_search(x: np.ndarray, sq: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray,
                beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of each query's beam from the entry points, nearest first; -1 pads.
    The distances of some queries to the shard are one matrix product: beams over a shard ask for
    most of them, and gathering vectors edge by edge costs more."""
    n = len(x)
    # each neighbour of a node once; what is missing leads to a last node without neighbours
    graph = np.sort(np.concatenate([graph, np.full((1, graph.shape[1]), -1)]), axis=1)
    graph[:, 1:][graph[:, 1:] == graph[:, :-1]] = -1
    graph[graph < 0] = n
    entries = np.atleast_1d(entries)[:beam]
    rows, out = max(16, TABLE // (n + 1)), []
    for i in range(0, len(queries), rows):
        some = queries[i:i + rows]
        table = np.full((len(some), n + 1), np.inf)
        table[:, :n] = (some * some).sum(axis=1)[:, None] + sq - 2 * some @ x.T
        out.append(_walk(table, graph, entries, beam))
    return np.concatenate([ids for ids, _ in out]), np.concatenate([dist for _, dist in out])


def robust_prune(x: np.ndarray, sq: np.ndarray, own: np.ndarray, cands: np.ndarray, degree: int,
                 alpha: float, pruned: int = 0) -> np.ndarray:
    """For each own point the kept neighbours among its candidates (-1 pads both).  The first
    ``pruned`` candidates were kept together before, by no larger ``alpha``: none of them hides
    another of them, so only the others are compared with all."""
    b, c = cands.shape
    if b > (rows := max(1, 2 * TABLE // max(1, c * (c - pruned)))):
        return np.concatenate([robust_prune(x, sq, own[i:i + rows], cands[i:i + rows], degree, alpha, pruned)
                               for i in range(0, b, rows)])
    safe = np.maximum(cands, 0)
    xc, c_sq = x[safe], sq[safe]
    d = sq[own, None] + c_sq - 2 * np.matmul(xc, x[own][:, :, None])[:, :, 0]
    d[(cands < 0) | (cands == own[:, None])] = np.inf
    apart = np.matmul(xc[:, pruned:], xc.transpose(0, 2, 1))
    apart *= -2
    apart += c_sq[:, pruned:, None]
    apart += c_sq[:, None]
    apart *= alpha * alpha
    # [:, i, j]: once i is kept, j goes
    hides = np.zeros((b, c, c), bool)
    hides[:, pruned:] = apart <= d[:, None]
    hides[:, :pruned, pruned:] = apart[:, :, :pruned].transpose(0, 2, 1) <= d[:, None, pruned:]
    order = np.argsort(d, axis=1, kind="stable")
    gone = ~np.isfinite(d)
    sorted_ = np.take_along_axis(safe, order, axis=1)
    out, kept, rows = np.full((b, degree + 1), -1, np.int64), np.zeros(b, np.int64), np.arange(b)
    gone[rows[:, None], order[:, 1:]] |= sorted_[:, 1:] == sorted_[:, :-1]
    for at in order.T:
        keep = ~gone[rows, at] & (kept < degree)
        out[rows, np.where(keep, kept, degree)] = safe[rows, at]
        kept += keep
        gone |= hides[rows, at] & keep[:, None]
        gone[rows, at] = True
    return out[:, :degree]


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA,
          seed: int = 7, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """(graph of out-neighbours padded with -1, entry points) of one shard; every pass but the
    last prunes without relaxation.  The last ``LONG`` columns are random neighbours."""
    x = _lift(vectors)
    n, rng = len(x), np.random.default_rng(seed)
    sq = (x * x).sum(axis=1)
    middle = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    entries = np.unique(np.concatenate([[middle], np.argsort(x[:, -1], kind="stable")[:STARTS], rng.permutation(n)[:STARTS]]))
    graph = np.full((n, degree + LONG), -1, np.int64)
    if n > 1:
        graph[:, degree:] = (np.arange(n)[:, None] + rng.integers(1, n, (n, LONG))) % n
    order = np.concatenate([rng.permutation(n) for _ in range(passes)])
    for i in range(0, len(order), BATCH):
        own = np.unique(order[i:i + BATCH])
        relaxed = alpha if i >= n * (passes - 1) else 1.0
        found, _ = beam_search(x, sq, graph, entries, x[own], beam)
        kept = robust_prune(x, sq, own, np.concatenate([found, graph[own]], axis=1), degree, relaxed)
        graph[own, :degree] = kept
        src, at = np.nonzero(kept >= 0)
        back, to = kept[src, at], own[src]
        by = np.argsort(back, kind="stable")
        back, to = back[by], to[by]
        ends, first, count = np.unique(back, return_index=True, return_counts=True)
        more = np.full((len(ends), int(count.max()) if len(count) else 0), -1, np.int64)
        of = np.repeat(np.arange(len(ends)), count)
        more[of, np.arange(len(back)) - first[of]] = to
        by = np.argsort(count, kind="stable")  # ends with about as many new neighbours are padded together
        for j in range(0, len(ends), BATCH):
            some = by[j:j + BATCH]
            e = ends[some]
            graph[e, :degree] = robust_prune(x, sq, e, np.concatenate([graph[e, :degree], more[some, :count[some[-1]]]], axis=1), degree,
                                              relaxed, degree)
    return graph, entries


def _best(vectors: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, exact inner products) of the ``k`` best of each query's ``ids``; ties to the first row."""
    score = np.einsum("qkd,qd->qk", vectors[np.maximum(ids, 0)], queries)
    score[ids < 0] = -np.inf
    order = np.lexsort((ids, -score))[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)


def _recall(vectors: np.ndarray, queries: np.ndarray, score: np.ndarray) -> float:
    """The share of the queries' exact nearest whose inner products are in ``score``."""
    k = min(score.shape[1], len(vectors))
    least = -np.partition(-(queries @ vectors.T), k - 1, axis=1)[:, k - 1]
    least -= 1e-9 * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max()
    return float((score[:, :k] >= least[:, None]).mean())


def search(vectors: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, k: int,
           beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, exact inner products) of each query's ``k`` best, -1 pads."""
    n, x = len(vectors), _lift(vectors)
    sq = (x * x).sum(axis=1)
    # scaling a query does not change its order of neighbours
    unit = queries / np.abs(queries).max(axis=1, keepdims=True)
    unit *= math.sqrt(float(sq.max())) / np.linalg.norm(unit, axis=1, keepdims=True)
    lifted = np.column_stack([unit, np.zeros(len(queries))])

    def found(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for i in range(0, len(at), BATCH):
            some = queries[at[i:i + BATCH]]
            ids = (np.tile(np.arange(n), (len(some), 1)) if n <= beam
                   else beam_search(x, sq, graph, entries, lifted[at[i:i + BATCH]], beam)[0])
            rows = max(1, (BATCH * BEAM) // ids.shape[1])
            out += [_best(vectors, some[j:j + rows], ids[j:j + rows], k) for j in range(0, len(some), rows)]
        ids, score = (np.concatenate(p) for p in zip(*out))
        return ids, score

    # the beam that the checked queries need is the beam of all
    checked = np.unique(np.linspace(0, len(queries) - 1, min(CHECKED, len(queries))).astype(np.int64))
    while n > beam and _recall(vectors, queries[checked], found(checked)[1]) < RECALL:
        beam *= 2
    return found(np.arange(len(queries)))


def _matrix(col) -> np.ndarray:
    """The vectors of a column as rows, in their own type."""
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _doubles(cell: pa.Scalar, dim: int, rows: int) -> np.ndarray:
    """The vectors of a binary cell, floats or doubles, as doubles."""
    raw = cell.as_buffer()
    return np.frombuffer(raw, f"f{raw.size // (rows * dim)}").astype(np.float64).reshape(rows, dim)


PACKED = "dim int, shard int, ids binary, vectors binary, graph binary, entries binary"


def _index_shard(t: pa.Table) -> pa.Table:
    order = np.argsort(np.asarray(t["rep"]))
    ids, x = np.asarray(t["rep"])[order], _matrix(t["e"])[order]
    graph, entries = build(x.astype(np.float64))
    return pa.table({"dim": t["dim"][:1], "shard": t["shard"][:1], "ids": pa.array([ids.tobytes()]),
                     "vectors": pa.array([x.tobytes()]), "graph": pa.array([graph.astype(np.int32).tobytes()]),
                     "entries": pa.array([entries.astype(np.int32).tobytes()])})


def _pack_queries(t: pa.Table) -> pa.Table:
    none = pa.array([None], pa.binary())
    return pa.table({"dim": t["dim"][:1], "shard": pa.array([None], pa.int32()), "ids": pa.array([np.asarray(t["rep"]).tobytes()]),
                     "vectors": pa.array([_matrix(t["e"]).tobytes()]), "graph": none, "entries": none})


def _merge(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """(found, ids, scores) of each query's ``k`` best of what several shards found; ties to the smaller id."""
    there, ids, score = (np.concatenate(p, axis=1) for p in zip(*found))
    order = np.lexsort((ids, -score, ~there))[:, :k]
    return tuple(np.take_along_axis(a, order, axis=1) for a in (there, ids, score))


def _answer(batches, k: int):
    """The ``k`` best of each query in the shards of its group: rows of shards, each group's
    first, then its blocks of queries (without shard)."""
    group, shards = None, []
    for b in batches:
        for i in range(b.num_rows):
            dim, of, shard, ids, vectors, graph, entries = (c[i] for c in b.columns)
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            x, dim = _doubles(vectors, dim.as_py(), len(ids)), dim.as_py()
            if (dim, of.as_py()) != group:
                group, shards = (dim, of.as_py()), []
            if shard.as_py() is not None:
                shards.append((ids, x, np.frombuffer(graph.as_buffer(), np.int32).reshape(len(ids), -1).astype(np.int64),
                               np.frombuffer(entries.as_buffer(), np.int32)))
                continue
            out = []
            for own, y, edges, starts in shards:
                at, score = search(y, edges, starts, x, k)
                out = [_merge([*out, (at >= 0, own[at], score)], k)]
            for there, near, score in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.broadcast_to(ids[:, None], there.shape)[there]), pa.array(near[there]), pa.array(score[there])],
                    names=["q", "c", "score"])


def points(table_: DataFrame) -> DataFrame:
    """(vec_id, dim, e): the rows that take part; e is of floats if the embeddings are, else of doubles."""
    kind = "float" if table_.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    e = F.col("embedding").cast(f"array<{kind}>")
    finite = F.forall("e", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return (table_.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))
            .where(F.col("vec_id").isNotNull() & (F.size("e") > 0))
            .where(finite & F.exists("e", lambda v: v != 0))
            .select("vec_id", F.size("e").alias("dim"), "e"))


def nearest(table_: DataFrame, is_query, k: int = K, shard: int = SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that
    ``is_query`` (a condition on vec_id) selects, among all other rows."""
    python_ready(table_)
    pts = materialize(points(table_), "ann-points")
    by_id = Window.partitionBy("dim", "e").orderBy("vec_id")
    members = (pts.distinct().withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
               .select("vec_id", "dim", "e", "nth"))
    reps = pts.groupBy("dim", "e").agg(F.min("vec_id").alias("rep"), F.max(is_query).alias("asked"))
    reps = materialize(reps, "ann-reps")
    members = materialize(members.join(reps.select("dim", "e", "rep"), ["dim", "e"]).select("rep", "vec_id"), "ann-members")
    asked = reps.where("asked")
    sizes = reps.agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).head()
    shards, blocks = max(1, math.ceil(sizes["n"] / shard)), max(1, math.ceil(sizes["q"] / query_block))
    # a task for each shard: hashed keys would put several of them into one
    index = (reps.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
             .repartitionById(shards, "shard").groupBy("dim", "shard").applyInArrow(_index_shard, PACKED))
    index = materialize(index, "ann-index")
    packed = (asked.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int")).groupBy("dim", "block")
              .applyInArrow(_pack_queries, PACKED))
    # a task holds a group of shards and streams all queries past them
    groups = min(shards, max(shuffle_partitions(table_.sparkSession), math.ceil(shards / GROUP)))
    parts = (index.withColumn("group", F.col("shard") % groups)
             .unionByName(packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
             .select("dim", "group", "shard", "ids", "vectors", "graph", "entries")
             .repartitionById(groups, "group").sortWithinPartitions("dim", "group", F.asc_nulls_last("shard")))
    pairs = parts.mapInArrow(lambda batches: _answer(batches, k + 1), "q long, c long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    near = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("q", "c", "score")
    named = near.join(members, F.col("c") == F.col("rep")).select("q", "vec_id", "score")
    by_q = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("r", F.row_number().over(by_q)).where(F.col("r") <= k + 1).select("q", "vec_id", "score")
    ids = (pts.where(is_query).distinct().join(reps.select("dim", "e", "rep"), ["dim", "e"])
           .select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q")))
    out = ids.join(named, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
