"""Vocabulary encoding: both strategies give the same rows."""

from spanlake.operators import joins as C
from spanlake.plans import fixtures as fx


def test_vocab_strategies_agree(spark):
    vocab = spark.createDataFrame([("'a'", 1), ("'a'", 7), ("'[UNK]_'", 0), ("'b'", 2)], "token string, id int")
    unk = fx.UNK_TOKEN
    vocab = vocab.where("id > 0").unionByName(spark.createDataFrame([(f"'{unk}'", 0)], "token string, id int"))
    rows = [(1, ["a", "b"]), (1, ["b"]), (None, ["a", "zz", None]), (2, None), (3, []), (None, ["b"])]
    df = spark.createDataFrame(rows, "k int, tokens array<string>")
    got = [sorted(map(repr, C.vocab_encode(df, vocab, "k", "tokens", strategy=s).select("k", "tokens", "ids").collect()))
           for s in ("map", "join")]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    ids = {(r["k"], tuple(r["tokens"]) if r["tokens"] is not None else None): r["ids"]
           for r in C.vocab_encode(df, vocab, "k", "tokens", strategy="join").collect()}
    assert ids[(1, ("a", "b"))] == [7, 2] and ids[(2, None)] is None and ids[(3, ())] == [] and ids[(None, ("a", "zz", None))] == [7, 0, 0]


def test_join_form_shuffles_no_occurrences(spark):
    words = [f"w{i}" for i in range(300)]
    vocab = spark.createDataFrame([(f"'{w}'", i) for i, w in enumerate(words[:250])] + [(f"'{fx.UNK_TOKEN}'", 999)], "token string, id int")
    rows = [(i, ["the"] * 50 + [words[i * j % 300] for j in range(40)] if i % 7 else None, f"payload {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, tokens array<string>, other string").repartition(6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = C._encode_join(df, vocab, "tokens", "ids", block_tokens=700)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan  # the lookup ran before, on distinct tokens
        by_join = sorted(map(repr, got.select("k", "tokens", "other", "ids").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_map = C.vocab_encode(df, vocab, "k", "tokens", strategy="map").select("k", "tokens", "other", "ids")
    assert by_join == sorted(map(repr, by_map.collect())) and len(by_join) == 500
    assert got.where("k = 1").first()["ids"][0] == 999 and got.where("k = 7").first()["ids"] is None
    assert C.vocab_encode(df.limit(0), vocab, "k", "tokens", strategy="join").count() == 0
