"""DataFrame operators on hand-made rows and random cases vs brute force."""

import random

from pyspark.sql import functions as F

from spanlake.operators import aggregates as D
from spanlake.operators import sampling as S
from spanlake.operators.sequences import compose_twostep, split_windows, stitch_windows


def cyclic_draw(buckets, size=20):
    """Reference behaviour restated: take from the current bucket when it has files left,
    else from the next bucket that has; continue after the bucket drawn from."""
    pos, out, b = [0] * 4, [], 0
    total = sum(len(x) for x in buckets)
    while len(out) < min(size, total):
        for step in range(4):
            k = (b + step) % 4
            if pos[k] < len(buckets[k]):
                out.append(buckets[k][pos[k]])
                pos[k] += 1
                b = k + 1
                break
    return out


def test_stratified_sample_matches_cursor_draw(spark):
    rnd = random.Random(3)
    cases = [[0, 0, 0, 0], [5, 0, 0, 0], [0, 0, 0, 7], [1, 0, 30, 2], [5, 5, 5, 5], [30, 30, 30, 30]]
    cases += [[rnd.choice([0, 1, 2, 3, 6, 12, 25]) for _ in range(4)] for _ in range(150)]
    rows, expected = [], {}
    for q, sizes in enumerate(cases):
        buckets = []
        for b, n in enumerate(sizes):
            names = [f"q{q}/b{b}/f{i}" for i in range(n)]
            buckets.append(names)
            for i, name in enumerate(names):
                em = 1 if b in (0, 2) else 0
                et = 1 if b in (0, 1) else 0
                rows.append((f"q{q}", name, em, et, rnd.randint(0, 10**6) * 1000 + i, 10))
        # first-seen order inside a bucket is by first_row_id
        expected[f"q{q}"] = buckets
    df = spark.createDataFrame(rows, "query_name string, code_file_path string, em int, example_type int, "
                                     "first_row_id long, file_tokens int")
    got = {}
    for r in S.stratified_sample(df).collect():
        got.setdefault(r["query_name"], []).append((r["draw_order"], r["code_file_path"]))
    by_path = {r[1]: r[4] for r in rows}
    for q, buckets in expected.items():
        ordered = [sorted(b, key=lambda p: (by_path[p], p)) for b in buckets]
        want = cyclic_draw(ordered)
        assert [p for _, p in sorted(got.get(q, []))] == want, (q, [len(b) for b in buckets])


def test_split_stitch_identity_and_rejects(spark):
    W = 8
    seqs = {
        1: [4, 4, 0, 1, 2],                     # shorter than W: one window as is
        2: [4, 4] + [2] * 5,                    # W - 1
        3: [4, 4] + [2] * 6,                    # exactly W: split path, one window
        4: [4, 4] + [0, 1, 1, 2, 3, 1, 2],      # W + 1
        5: [4, 4, 4] + [2] * 10,                # body an exact multiple of W - prefix
        6: [4] * 8 + [2, 2],                    # prefix >= W: rejected
        7: [2] * 12,                            # no prefix: rejected
        8: [4, 4] + [1, 0, 1] * 9,
    }
    df = spark.createDataFrame([(k, v, [x + 10 for x in v]) for k, v in seqs.items()],
                               "example_id long, labels array<int>, ids array<int>")
    w, rej = split_windows(df, W, ["labels", "ids"])
    assert {r["example_id"] for r in rej.collect()} == {6, 7}
    counts = {r["example_id"]: r["n"] for r in w.groupBy("example_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 8: 5}
    assert all(len(r["labels"]) <= W for r in w.collect())
    back = {r["example_id"]: (r["labels"], r["ids"]) for r in stitch_windows(w, ["labels", "ids"]).collect()}
    for k, v in seqs.items():
        if k in (6, 7):
            continue
        assert back[k] == (v, [x + 10 for x in v])


def test_file_answer_agg_edges(spark):
    rows = [
        (1, "q", "a.py", 0, [], []),                        # no spans -> N/A
        (3, "q", "b.py", 1, ["x", "y"], ["f"]),
        (2, "q", "b.py", 1, ["z"], []),                     # row order 2 then 3, no separator
        (4, "q", "c.py", 1, [""], []),                      # an empty string span
    ]
    df = spark.createDataFrame(
        [(r, q, p, t, [(s,) for s in a], [(s,) for s in f]) for r, q, p, t, a, f in rows],
        "row_id long, query_name string, code_file_path string, example_type int, "
        "answer_spans array<struct<span:string>>, supporting_fact_spans array<struct<span:string>>")
    got = {r["code_file_path"]: (r["answer_spans"], r["supporting_fact_spans"])
           for r in D.file_answer_agg(df).collect()}
    assert got["a.py"] == ("N/A", "")
    assert got["b.py"] == ("zx:::-:::y", "f")
    assert got["c.py"] == ("N/A", "")


def _blocks(spark, blocks):
    rows = [(i, "q", "f.py", 1, ord_, bi, pr, rl, ["q", "[SEP]_"] + toks, [4, 4] + labs)
            for i, (ord_, bi, pr, rl, toks, labs) in enumerate(blocks)]
    return spark.createDataFrame(rows, "row_id long, query_name string, code_file_path string, example_type int, "
                                       "block_ordinal int, block_index int, predicted int, relevance_label int, "
                                       "subtokenized_input_sequence array<string>, label_sequence array<int>")


def _prov(c):
    return [(x["label"], x["block_index"], x["block_offset"]) for x in c]


def test_compose_twostep_edges(spark):
    one = compose_twostep(_blocks(spark, [(0, 7, 0, 0, ["a", "b"], [0, 1])]))[0].first()
    # a single block skips prediction: chosen on both sides even with relevance 0
    assert one["tokens"] == ["q", "[SEP]_", "a", "b"]
    assert _prov(one["predicted"]) == [(4, -1, -1), (4, -1, -1), (0, 7, 0), (1, 7, 1)]
    assert _prov(one["target"]) == _prov(one["predicted"])
    none = compose_twostep(_blocks(spark, [(0, 1, 0, 1, ["a"], [0]), (1, 2, 0, 0, ["b"], [2])]))[0].first()
    assert none["tokens"] == ["q", "[SEP]_"]                       # header only
    assert _prov(none["target"]) == [(4, -1, -1), (4, -1, -1), (0, 1, 0)]
    both = compose_twostep(_blocks(spark, [(1, 2, 1, 1, ["b"], [2]), (0, 1, 1, 1, ["a", "c"], [3, 1])]))[0].first()
    assert both["tokens"] == ["q", "[SEP]_", "a", "c", "[SEP]_", "b"]
    assert both["segments"] == [0, 0, 1, 1, 1, 1] and both["mask"] == [1] * 6
    assert _prov(both["predicted"]) == [(4, -1, -1), (4, -1, -1), (3, 1, 0), (1, 1, 1), (4, -1, -1), (2, 2, 0)]


def test_pass_at_k_and_any_match(spark):
    rows = [(0, "q", "ans", "ans", " ans ", "zzz", "", "", "", "", "", "", ""),
            (1, "q", "", "", "", "", "", "", "", "", "", "", "")]
    cols = "i int, query string, ans_spans string, " + ", ".join(f"ans_{j} string" for j in range(10))
    df = spark.createDataFrame(rows, cols)
    pk = {r["k"]: r["pass_at_k"] for r in D.pass_at_k(df).collect()}
    # row 0: c = 2 of n = 10; row 1: c = 0 (blank candidates are dropped)
    assert pk[1] == round((1 - 8 / 10) / 2, 9)
    assert pk[10] == 0.5
    am = {r["query"]: r["any_match"] for r in D.any_match_rate(df).collect()}
    assert am["q"] == 0.5


def test_union_topup_only_for_short_queries(spark):
    schema = "query_name string, row_id long, answer_spans array<struct<span:string>>"
    pool = spark.createDataFrame(
        [("a", i, [("x",), ("y",)] if i % 2 else [("x",)]) for i in range(12)]
        + [("b", 100 + i, [("x",), ("y",)]) for i in range(3)], schema)
    sampled = S.seeded_sample_n(pool, 10).select("query_name", "row_id", "answer_spans")
    out = S.union_topup(sampled, pool, 10)
    n = {r["query_name"]: r["n"] for r in out.groupBy("query_name").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 10, "b": 6}  # b drew 3 (< 10) and gets its 3 multi-span rows again


def test_group_row_number_spreads_hot_group(spark):
    from pyspark.sql import Window
    from spanlake.operators.windows import group_row_number
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 20)}", rnd.randint(0, 10**9), i)
            for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, k long, i long").repartition(16)
    got = group_row_number(df, ["g"], ["k", "i"], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k", "i")))
    a = sorted((r["i"], r["rn"]) for r in got.select("i", "rn").collect())
    b = sorted((r["i"], r["rn"]) for r in want.select("i", "rn").collect())
    assert a == b
    # the hot group is numbered in several partitions (AQE would merge this tiny input)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sorted_parts = df.orderBy("g", "k", "i").withColumn("p", F.spark_partition_id())
        assert sorted_parts.where("g = 'hot'").select("p").distinct().count() > 1
        got2 = group_row_number(df, ["g"], ["k", "i"], "rn")
        assert sorted((r["i"], r["rn"]) for r in got2.select("i", "rn").collect()) == b
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_partition_by_query_spreads_a_hot_query(spark):
    from spanlake.operators.filters import partition_by_query
    name = F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("q"), F.col("id") % 5))
    df = spark.range(0, 3500, 1, 16).select(name.alias("query_name"), F.col("id").alias("row_id"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    try:  # the split follows the bytes: with a small target size the hot query takes many tasks
        rows = partition_by_query(df).withColumn("pid", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len({r["pid"] for r in rows if r["query_name"] == "hot"}) > 4
    assert sorted(r["row_id"] for r in rows) == list(range(3500))


def test_metrics_on_empty_input(spark):
    cols = "i int, query string, ans_spans string, " + ", ".join(f"ans_{j} string" for j in range(10))
    empty = spark.createDataFrame([], cols)
    rows = {r["k"]: r for r in D.pass_at_k(empty).collect()}
    assert set(rows) == {1, 2, 5, 10}
    assert all(r["total"] == 0 and r["pass_at_k"] is None for r in rows.values())
    assert D.any_match_rate(empty).count() <= 1  # runs; Spark emits no rollup row for empty input


def test_span_cut_by_padding_fails_exact_match(spark):
    """The target is compared untruncated with a 1024-position output: a span crossing
    position 1024 cannot match, one ending before it can."""
    from spanlake.functions.sequences import pad_truncate
    inside = [2] * 1000 + [0, 1, 1] + [2] * 21
    crossing = [2] * 1022 + [0, 1, 1, 1] + [2] * 4
    df = spark.createDataFrame([(1, inside), (2, crossing)], "example_id long, labels array<int>")
    out = df.withColumn("output", pad_truncate("labels", 1024, 4))
    got = {r["example_id"]: r["exact"] for r in D.exact_match_rate(out, "labels", "output", by=["example_id"]).collect()}
    assert got == {1: 1, 2: 0}


def test_global_row_number_matches_row_number(spark):
    from pyspark.sql import Window
    from spanlake.operators.windows import global_row_number
    rnd = random.Random(9)
    rows = [(rnd.choice("abcdefgh"), rnd.randint(0, 10**6), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, k long, i long").repartition(12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = global_row_number(df, ["g", "k", "i"], "rn")
        assert got.select("rn").distinct().count() == len(rows)
        a = sorted((r["i"], r["rn"]) for r in got.select("i", "rn").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = df.withColumn("rn", F.row_number().over(Window.orderBy("g", "k", "i")) - 1)
    assert a == sorted((r["i"], r["rn"]) for r in want.select("i", "rn").collect())


def test_numbering_of_ties_nulls_and_equal_rows(spark):
    from spanlake.operators.windows import global_row_number, group_row_number, row_index
    rows = [(g, k, v) for g in ("a", None, "b") for k in (1, None, 2, 2) for v in ("x", "x", None)]
    df = spark.createDataFrame(rows, "g string, k int, v string").repartition(5)
    got = global_row_number(df, ["g", "k"], "rn")
    assert got.columns == ["g", "k", "v", "rn"] and sorted(r["rn"] for r in got.collect()) == list(range(36))
    low = lambda x: (x is not None, x)  # noqa: E731 - nulls first
    assert [(r["g"], r["k"]) for r in got.orderBy("rn").collect()] == sorted(((g, k) for g, k, _ in rows), key=lambda r: (low(r[0]), low(r[1])))
    for r in (group_row_number(df, ["g"], ["k"], "rn"), row_index(df, "g", ("k",)).withColumn("rn", F.col("i") + 1)):
        by = {}
        for x in sorted(r.collect(), key=lambda x: x["rn"]):
            by.setdefault(x["g"], []).append((x["rn"], x["k"]))
        assert all(v == list(zip(range(1, 13), [None] * 3 + [1] * 3 + [2] * 6)) for v in by.values()) and len(by) == 3
    down = global_row_number(df, [F.desc_nulls_last("k")], "rn", keys=["k"])
    assert {r["rn"] for r in down.where("k is null").collect()} == set(range(27, 36))
    assert global_row_number(df.limit(0), ["g"]).count() == 0


def test_numbering_stores_keys_only(spark):
    import glob
    import os

    from spanlake.operators.windows import global_row_number
    from spanlake.session import ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark).replace("file:", "")
    before = set(glob.glob(f"{root}/rdd-*"))
    df = spark.range(2000).select("id", F.concat(F.repeat(F.sha2(F.col("id").cast("string"), 512), 40), F.lit("payload")).alias("text"))
    assert global_row_number(df, ["id"]).where("rn = id").count() == 2000
    new = set(glob.glob(f"{root}/rdd-*")) - before
    size = sum(os.path.getsize(f) for d in new for f in glob.glob(f"{d}/*"))
    assert 0 < size < 1_000_000  # the rows take 10 MB


def _losses(spark, ordinals):
    rows = [(o, [[0.1 * i, 1.0, -0.5 * i], [2.0, 0.0, 0.3]], [i % 3, 2]) for i, o in enumerate(ordinals)]
    return spark.createDataFrame(rows, "row_id long, logits array<array<double>>, targets array<int>").repartition(3)


def test_batches_are_consecutive_rows_whatever_the_ordinals(spark):
    import math
    dense = D.batch_loss(_losses(spark, range(10))).first()
    gapped = D.batch_loss(_losses(spark, [4 * i + i * i for i in range(10)])).first()
    assert dense == gapped and dense["n_batches"] == 3
    ce = []
    for i in range(10):
        for l, t in zip([[0.1 * i, 1.0, -0.5 * i], [2.0, 0.0, 0.3]], [i % 3, 2]):
            ce.append(math.log(sum(map(math.exp, l))) - l[t])
    means = [sum(c) / len(c) for c in (ce[0:8], ce[8:16], ce[16:20])]
    assert abs(dense["total_loss"] - sum(means)) < 1e-8 and abs(dense["mean_loss"] - sum(ce) / 20) < 1e-8
    # null ordinals come last, repeated ones are rows of their own
    odd = D.batch_loss(_losses(spark, [None, 1, 1, 1, 1, 7, 7, None, 9])).first()
    assert odd["n_batches"] == 3
    assert D.batch_loss(_losses(spark, [1]).limit(0)).first()["n_batches"] == 0


def test_topup_in_one_pass_equals_the_union(spark):
    from spanlake.operators import windows as E
    rnd = random.Random(3)
    rows = [(f"q{rnd.randint(0, 6) if i % 3 else 9}", f"f{rnd.randint(0, 90)}", i, [(str(j),) for j in range(rnd.randint(0, 3))]) for i in range(260)]
    df = spark.createDataFrame(rows, "query_name string, code_file_path string, row_id long, answer_spans array<struct<span:string>>").repartition(6)
    pool = E.singleton_files(df)
    for n in (1, 10, 40):
        two = S.union_topup(S.seeded_sample_n(pool, n).select(*df.columns), pool.select(*df.columns), n)
        one = S.sample_with_topup(df, n)
        assert one.columns == df.columns and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    plan = S.sample_with_topup(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "WindowGroupLimit" in plan


def test_spans_with_block_ids(spark):
    from spanlake.functions.spans import extract_block_spans
    df = spark.createDataFrame([(1, [2, 0, 1, 1, 3, 2, 1, 0], [5, 5, 5, 6, 6, 6, 7, 7]), (2, [], []), (3, [0, 1], [1]), (4, None, None)],
                               "i int, l array<int>, b array<int>")
    got = {r["i"]: r["s"] and [tuple(x) for x in r["s"]] for r in df.select("i", extract_block_spans("l", "b").alias("s")).collect()}
    assert got == {1: [(1, 3, 0, [5, 5, 6]), (4, 1, 3, [6]), (7, 1, 0, [7])], 2: [], 3: None, 4: None}
