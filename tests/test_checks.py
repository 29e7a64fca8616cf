"""The data-quality checks find hand-made violations and stay silent on clean rows."""

import pytest
from pyspark.sql import functions as F

from spanlake.operators import checks as J
from spanlake.operators.sequences import split_windows


def _keys(df):
    return sorted(r["key"] for r in df.collect())


def test_lengths_padding_and_separator(spark):
    df = spark.createDataFrame([(1, ["q", "[SEP]_", "a"], [4, 4, 0]), (2, ["q", "a"], [4, 0, 1]),
                                (3, ["a", "b"], [4, 0])], "k long, toks array<string>, labs array<int>")
    assert _keys(J.chk_lengths(df, ["k"], ["toks", "labs"])) == ["2"]
    assert _keys(J.chk_padded(df, ["k"], ["toks"], 3)) == ["2", "3"]
    got = {r["key"]: r["detail"] for r in J.chk_has_sep(df, ["k"], "toks", "labs").collect()}
    assert got == {"2": "no separator", "3": "no separator"}


def test_prefix_and_windows(spark):
    seqs = spark.createDataFrame([(1, [4, 4] + [2] * 10), (2, [4, 4, 4] + [1] * 9)],
                                 "example_id long, labels array<int>")
    w, _ = split_windows(seqs, 6, ["labels"])
    assert J.chk_windows(w, seqs, 6).count() == 0
    broken = w.where(~((F.col("example_id") == 1) & (F.col("split_id") == 1)))
    assert _keys(J.chk_windows(broken, seqs, 6)) == ["1"]
    bad_prefix = spark.createDataFrame([("a", [4, 2, 4, 0]), ("b", [4, 4, 0])], "k string, labels array<int>")
    assert _keys(J.chk_prefix(bad_prefix, ["k"])) == []  # first separator decides the prefix
    grouped = spark.createDataFrame([("f", [4, 4, 0]), ("f", [4, 0])], "k string, labels array<int>")
    assert _keys(J.chk_prefix(grouped, ["k"], group=["k"])) == ["f"]  # two prefix lengths in one file


def test_class_negative_sample_and_counts(spark):
    rows = spark.createDataFrame(
        [("q", "a.py", 1, [("s",)], []), ("q", "a.py", 0, [], []),        # mixed types
         ("q", "b.py", 0, [("s",)], []),                                    # spans on a negative
         ("q", "c.py", 1, [], []),                                          # positive without spans
         ("q", "d.py", 1, [("s",)], [])],
        "query_name string, code_file_path string, example_type int, "
        "answer_spans array<struct<span:string>>, supporting_fact_spans array<struct<span:string>>")
    got = {r["key"]: r["detail"] for r in J.chk_class_per_file(rows).collect()}
    assert got == {"q|a.py": "mixed example types", "q|b.py": "spans on a negative file",
                   "q|c.py": "positive file without spans"}
    picks = rows.withColumn("row_id", F.monotonically_increasing_id())
    assert J.chk_negative_empty(picks).count() == 1
    assert J.chk_positive(picks.withColumn("row_id", F.lit(1))).count() == 2
    sample = spark.createDataFrame([("q", f"f{i}") for i in range(20)] + [("r", "x")], "query_name string, p string")
    avail = spark.createDataFrame([("q", f"f{i}") for i in range(25)] + [("r", "x")], "query_name string, p string")
    got = {r["key"]: r["detail"] for r in J.chk_sample_size(sample, avail, 20).collect()}
    assert got == {"r": "only 1 available"}
    counts = spark.createDataFrame([(0, 3), (1, 11)], "i int, c int")
    assert _keys(J.chk_pass_count(counts, 10)) == ["1"]


def test_group_counts_and_schema(spark):
    blocks = spark.createDataFrame([("q", "a", 0, 1), ("q", "a", 1, 0), ("q", "b", 0, 1)],
                                   "query_name string, code_file_path string, block_ordinal int, relevance_label int")
    preds = blocks.where("code_file_path = 'a'")
    got = {r["key"]: r["detail"] for r in J.chk_group_counts(blocks, preds).collect()}
    assert got == {"q|b": "1/0/1"}
    assert J.chk_schema_equal(blocks, preds) and not J.chk_schema_equal(blocks, blocks.drop("relevance_label"))


def test_lookups_split_into_rows_and_rejects(spark):
    from spanlake.operators import joins as C
    ex = spark.createDataFrame([("q1", "f1", 1), ("q2", "f9", 2), ("q9", "f1", 3), (None, "f9", 4)],
                               "query_name string, code_file_path string, row_id int")
    meta = spark.createDataFrame([("q1", "d1", "r1"), ("q2", "d2", None)], "query_name string, desc string, reccomendation string")
    files = spark.createDataFrame([("f1", "text")], "code_file_path string, content string")
    both = C.join_source_text(C.join_query_meta(ex, meta), files)
    assert [(r["row_id"], r["desc"], r["content"]) for r in C.found(both).collect()] == [(1, "d1", "text")]
    got = {(r["check"], r["key"], r["detail"]) for r in C.rejects(both, ["row_id"]).collect()}
    assert got == {("source_text", "2", "no matching row"), ("query_meta", "3", "no matching row"), ("query_meta", "4", "no matching row")}
    assert {r["row_id"] for r in C.join_query_meta(ex, meta, "drop").collect()} == {1, 2}
    assert "missing" not in C.join_query_meta(ex, meta, "fail").columns
    with pytest.raises(ValueError):
        C.lookup(ex, meta, ["query_name"], "x", "ignore")


def test_a_miss_stops_the_write(spark, tmp_path):
    from spanlake.operators import joins as C
    ex = spark.createDataFrame([("q1", 1), ("q9", 2)], "query_name string, row_id int")
    meta = spark.createDataFrame([("q1", "d1", "r1")], "query_name string, desc string, reccomendation string")
    with pytest.raises(Exception, match="query_meta: no matching row for q9"):
        C.join_query_meta(ex, meta, "fail").write.parquet(str(tmp_path / "out"))
    assert not (tmp_path / "out" / "_SUCCESS").exists()
    assert C.join_query_meta(ex.where("row_id = 1"), meta, "fail").first()["desc"] == "d1"


def test_rules_share_one_scan(spark):
    from spanlake.plans.catalog import all_queries
    for name in ("chk_sequences", "chk_examples"):
        df = all_queries()[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 1, name
    df = spark.createDataFrame([(1, [1], [1, 2]), (2, [1], [1]), (None, None, [1])], "id int, a array<int>, b array<int>")
    got = J.evaluate(df, [J.lengths_rule(["id"], ["a", "b"]), J.padded_rule(["id"], ["b"], 2)]).collect()
    assert {(r["check"], r["key"], r["detail"]) for r in got} >= {("chk_lengths", "1", "1,2"), ("chk_padded", "2", "1")}
    assert J.evaluate(df.limit(0), [J.lengths_rule(["id"], ["a", "b"])]).count() == 0


def test_examples_are_checked_by_row_and_by_file(spark):
    df = spark.createDataFrame([("q", "f", 1, 1, ["a"]), ("q", "f", 2, 0, []), ("q", "g", 3, 1, []), ("q", "h", 4, 0, ["x"]), ("q", "i", 5, 1, ["x"])],
                               "query_name string, code_file_path string, row_id long, example_type int, answer_spans array<string>")
    got = {(r["check"], r["key"], r["detail"]) for r in J.check_examples(df).collect()}
    want = {(r["check"], r["key"], r["detail"]) for r in J.chk_class_per_file(df).unionByName(J.chk_positive(df)).collect()}
    assert got == want and len(got) == 5
