"""Set-similarity join on word shingles by the chosen-path method.

A document is the set of its five-word shingles (hashed); documents with equal sets are one
node.  In every run a node chooses, from a path of shingles, each of its shingles with
probability ``1 / (threshold * size)`` by a hash of path and shingle, so two similar sets
are expected to share at least one choice at every level.  Paths of length ``SHALLOW`` are
buckets; a bucket of more than ``SMALL`` nodes is split further, on paths of length
``DEEP``.  A pair at the threshold is expected to meet in ``RUNS`` runs with a probability of
over 0.99 in buckets that need no split; the worst case, a set that holds the other and
shares only buckets that are split, meets with 0.983.

In a bucket, nodes are compared by small bin-minimum sketches, in one pass that keeps only
leaders: a node is linked to every leader of similarity 0.5 or more (by sketch) and becomes
a leader unless one is 0.8 similar; by the triangle inequality of Jaccard distance two nodes
0.8 similar thus get linked, whatever the size of a bucket.  Links only say which nodes meet:
the linked groups are cut into blocks, and every pair of blocks is verified exactly on the
full sets.  Pairs are counted and classes formed there; pairs are never written out.

Result: per document its class (the least doc_id connected by links), and its number of
links (documents of similarity ``threshold`` or more, equal ones included).

Defined results: null, empty and word-free texts have no links and are their own class; a
text of fewer than five words is one shingle; rows without doc_id are not compared (class
null, no links); a repeated row is another document with the same id; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import materialize, python_ready, shuffle_partitions, table
from spanlake.llm.components import components
from spanlake.llm.shingles import mix, shingle_sets

THRESHOLD = 0.8
WIDTH = 5
RUNS, SHALLOW, DEEP, SMALL = 12, 2, 4, 256
BINS = 64
LINK, LEAD = 0.5, 0.8
#: Nodes and shingles of a verification block.
BLOCK, BLOCK_SHINGLES = 512, 400_000
CHUNK = 1 << 16
NODES_BROADCAST = 100_000


def node_of(s: np.ndarray) -> int:
    """The 64-bit id of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def sketch(s: np.ndarray) -> bytes:
    """One byte for each of ``BINS`` equal ranges of the hash space: of the least hash there, or 0."""
    edge = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 6)
    at = np.searchsorted(s, edge)
    end = np.append(at[1:], len(s))
    out = np.zeros(BINS, np.uint8)
    full = at < end
    out[full] = mix(s[at[full]]) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def paths(s: np.ndarray, threshold: float = THRESHOLD, runs: int = RUNS, shallow: int = SHALLOW,
          deep: int = DEEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths of the shallow length; of the extended paths their shallow part, and themselves."""
    limit = np.uint64(min(2.0 ** 64 / (threshold * len(s)), 2.0 ** 64 - 2048))
    path = mix(np.arange(1, runs + 1, dtype=np.uint64))
    top = path
    short = path[:0]
    for depth in range(1, deep + 1):
        # multiplication by an odd number that depends on the path: uniform, as shingles are
        factor, shift = mix(path) | np.uint64(1), path[:, None]
        found = [np.nonzero(s[i:i + CHUNK] * factor[:, None] + shift < limit) for i in range(0, len(s), CHUNK)]
        at = np.concatenate([r for r, _ in found])
        chosen = np.concatenate([s[c + i * CHUNK] for i, (_, c) in enumerate(found)])
        path, first = np.unique(mix(mix(chosen + path[at]) ^ np.uint64(depth)), return_index=True)
        top = path if depth <= shallow else top[at][first]
        if depth == shallow:
            short = path
    return short.view(np.int64), top.view(np.int64), path.view(np.int64)


def _describe(batches):
    for b in batches:
        nodes, sizes, sketches, short, far_a, far_b = [], [], [], [], [], []
        for s in shingle_sets(b.column(1), WIDTH):
            sizes.append(len(s))
            nodes.append(node_of(s))
            if len(s):
                a, b_top, b_all = paths(s)
                sketches.append(sketch(s))
            else:
                a = b_top = b_all = np.zeros(0, np.int64)
                sketches.append(b"")
            short.append(a)
            far_a.append(b_top)
            far_b.append(b_all)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()),
             pa.array(short, longs), pa.array(far_a, longs), pa.array(far_b, longs)],
            names=["doc_id", "node", "n", "sketch", "short", "far_a", "far_b"])


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    full = ((a != 0) | (b != 0)).sum(axis=-1)
    return ((a == b) & (a != 0)).sum(axis=-1) / np.maximum(full, 1)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index connected to each of ``n`` by the pairs (i, j)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _link(batches):
    """Linked nodes of each bucket, from rows sorted by bucket, as edges to the first node of
    their group: one row per member at most.  Leaders of the last bucket are carried on."""
    last, held_nodes, held = None, np.zeros(0, np.int64), np.zeros((0, BINS), np.uint8)
    for b in batches:
        if not b.num_rows:
            continue
        bucket, node = np.asarray(b.column(0)), np.asarray(b.column(1))
        sk = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, BINS)
        alive = np.ones(len(node), bool)
        if bucket[0] != last:
            held_nodes, held = held_nodes[:0], held[:0]
        # places: held leaders first, then the rows
        before, place = len(held), np.concatenate([held_nodes, node])
        us, vs = [], []
        own = np.flatnonzero(bucket == last) if before else np.zeros(0, np.int64)
        for at in range(0, len(own), 256):
            part = own[at:at + 256]
            for k in range(0, before, 1024):
                sim = _similar(sk[part][:, None, :], held[None, k:k + 1024])
                r, c = np.nonzero(sim >= LINK)
                us.append(before + part[r])
                vs.append(k + c)
                alive[part[(sim >= LEAD).any(axis=1)]] = False
        if bucket[-1] != last:
            held_nodes, held = held_nodes[:0], held[:0]
        last = bucket[-1]
        rows = np.flatnonzero(alive)
        while len(rows):
            head = np.concatenate([[True], bucket[rows[1:]] != bucket[rows[:-1]]])
            lead = rows[head][np.cumsum(head) - 1]
            keep = rows[head][bucket[rows[head]] == last]
            held_nodes, held = np.concatenate([held_nodes, node[keep]]), np.concatenate([held, sk[keep]])
            rows, lead = rows[~head], lead[~head]
            if not len(rows):
                break
            sim = _similar(sk[rows], sk[lead])
            near = sim >= LINK
            us.append(before + rows[near])
            vs.append(before + lead[near])
            rows = rows[sim < LEAD]
        if us:
            root = _roots(len(place), np.concatenate(us), np.concatenate(vs))
            moved = root != np.arange(len(place))
            pairs = np.unique(np.column_stack([place[moved], place[root[moved]]]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _sets(batches):
    for b in batches:
        sets = list(shingle_sets(b.column(1), WIDTH))
        ok = np.array([node_of(s) for s in sets], np.int64) == np.asarray(b.column(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(b.column(0))[ok]), b.column(2).filter(pa.array(ok)),
             pa.array([s.tobytes() for s, o in zip(sets, ok, strict=True) if o], pa.binary())],
            names=["node", "copies", "shingles"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of blocks of the incidence matrix."""
    sizes = [len(s) for s in sets]
    row = np.repeat(np.arange(len(sets)), sizes)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    wide = max(1, 4_000_000 // len(sets))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
        a, z = np.searchsorted(col, [start, start + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[row[a:z], col[a:z] - start] = 1
        out += m @ m.T
    out[np.arange(len(sets)), np.arange(len(sets))] = sizes
    return out


def _verify_group(node, copies, side, cross, sets, threshold):
    """(links, root) of each node: links within the group's pairs, root the least node
    reached by them."""
    n = np.array([len(s) for s in sets], np.float64)
    common = overlaps(sets).astype(np.float64)
    linked = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    if cross:
        linked &= side[:, None] != side[None, :]
    root = np.arange(len(node))
    by_node = np.argsort(node, kind="stable")
    rank = np.empty(len(node), np.int64)
    rank[by_node] = np.arange(len(node))
    root = rank.copy()
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(node)).min(axis=1))
        least = np.minimum(least, least[by_node[least]])
        if (least == root).all():
            break
        root = least
    return (linked * copies[None, :]).sum(axis=1), node[by_node[root]]


def _verify(threshold):
    def run(batches):
        key, held = None, []

        def flush():
            if not held:
                return None
            rows = {}
            for r in held:
                rows[r["node"]] = r
            rows = list(rows.values())
            node = np.array([r["node"] for r in rows], np.int64)
            copies = np.array([r["copies"] for r in rows], np.int64)
            side = np.array([r["side"] for r in rows])
            cross = rows[0]["i"] != rows[0]["j"]
            links, root = _verify_group(node, copies, side, cross, [np.frombuffer(r["shingles"], np.uint64) for r in rows], threshold)
            return node, links, root

        def batch(done):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*done, strict=True)],
                                              names=["node", "links", "root"])

        done, n = [], 0
        for b in batches:
            for r in b.to_pylist():
                k = (r["comp"], r["i"], r["j"])
                if k != key:
                    if (got := flush()) is not None:
                        done.append(got)
                        n += len(got[0])
                        if n >= 20_000:
                            yield batch(done)
                            done, n = [], 0
                    key, held = k, []
                held.append(r)
        if (got := flush()) is not None:
            done.append(got)
        if done:
            yield batch(done)

    return run


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of all buckets with several nodes."""
    near = nodes.select("node", F.explode("short").alias("a"))
    count = near.groupBy("a").agg(F.count("*").alias("in_a")).where("in_a > 1")
    count = materialize(count, "join-buckets")
    small = near.join(count.where(F.col("in_a") <= SMALL), "a").select(F.col("a").alias("bucket"), "node")
    big = count.where(F.col("in_a") > SMALL).select("a")
    n_big = big.count()
    if not n_big:
        return small
    far = nodes.select("node", F.explode(F.arrays_zip("far_a", "far_b")).alias("p")).select(
        "node", F.col("p.far_a").alias("a"), F.col("p.far_b").alias("bucket"))
    split = far.join(F.broadcast(big) if n_big <= NODES_BROADCAST else big, "a", "left_semi").select("bucket", "node")
    return small.unionByName(split)


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of every row of ``docs`` (doc_id, text)."""
    python_ready(docs)
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(base.mapInArrow(
        _describe, "doc_id long, node long, n long, sketch binary, short array<long>, far_a array<long>, far_b array<long>"),
        "join-rows")
    real = rows.where("n > 0 and doc_id is not null")
    nodes = materialize(real.groupBy("node").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"),
        F.first(F.struct("sketch", "short", "far_a", "far_b")).alias("x")).select("node", "copies", "first_id", "n", "x.*"), "join-nodes")
    members = materialize(_buckets(nodes), "join-members")
    linked = (members.join(nodes.select("node", "sketch"), "node").select("bucket", "node", "sketch")
              .repartition(parts, "bucket").sortWithinPartitions("bucket", "node").mapInArrow(_link, "u long, v long"))
    comps = materialize(components(linked), "join-comps")
    sized = comps.join(nodes.select("node", "copies", "first_id", "n"), "node")
    blocks = (sized.groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("all_n"))
              .withColumn("nb", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("all_n") / BLOCK_SHINGLES), F.lit(1)).cast("int"))
              .withColumn("nb", F.least(F.col("nb"), F.col("m")).cast("int")).select("label", "nb"))
    sized = materialize(sized.join(blocks, "label").withColumn(
        "own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("nb")).cast("int")), "join-sized")
    sets = (base.where("doc_id is not null").join(sized.select(F.col("first_id").alias("doc_id"), "node", "copies").hint("merge"), "doc_id")
            .select("node", "text", "copies").mapInArrow(_sets, "node long, copies long, shingles binary"))
    placed = sets.join(sized.select("node", F.col("label").alias("comp"), "nb", "own"), "node")
    # block pair (i, j), i <= j; block i meets itself in (i, i)
    met = (placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
           .select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                   (F.col("own") > F.col("other")).alias("side"), "node", "copies", "shingles"))
    checked = materialize(met.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
                          .mapInArrow(_verify(threshold), "node long, links long, root long"), "join-verified")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = nodes.select("node", "copies", "first_id").join(links, "node", "left").join(classes, "node", "left").select(
        "node", "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        F.coalesce("label", "node").alias("label"))
    named = materialize(named, "join-classes")
    least = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    of = named.join(least, "label").select("node", "class_id", "links")
    compared = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return (rows.select("doc_id", "n", "node").where(compared).join(of, "node")
            .select("doc_id", "class_id", F.col("links").alias("n_links"))
            .unionByName(rows.where(~compared).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
