"""Windows of sequences and two-step composition."""

from pyspark.sql import functions as F


def test_twostep_without_separator_is_rejected(spark):
    from spanlake.operators.sequences import compose_twostep
    row = ("q", "f", 0, 0, 0, 1, 1, 1, ["a", "b"], [0, 1])
    df = spark.createDataFrame(
        [row], "query_name string, code_file_path string, row_id long, block_ordinal int, block_index int, predicted int, "
        "relevance_label int, example_type int, subtokenized_input_sequence array<string>, label_sequence array<int>")
    good, bad = compose_twostep(df)
    assert good.count() == 0 and [(r["code_file_path"], r["detail"]) for r in bad.collect()] == [("f", "no separator")]


def test_padded_windows_hold_the_length_rule(spark):
    from spanlake.operators.checks import chk_windows
    from spanlake.operators.sequences import split_windows
    seqs = spark.createDataFrame([(1, [4, 4] + [2] * 9)], "example_id long, labels array<int>")
    w, _ = split_windows(seqs, 6, ["labels"])
    padded = w.withColumn("labels", F.slice(F.concat("labels", F.array_repeat(F.lit(4), 6)), 1, 6))
    assert chk_windows(padded, seqs, 6).count() == 0 and chk_windows(w, seqs, 6).count() == 0
    cut = w.withColumn("labels", F.when(F.col("split_id") == 1, F.slice("labels", 1, 5)).otherwise(F.col("labels")))
    assert [r["detail"] for r in chk_windows(cut, seqs, 6).collect()] == ["stitched length"]


def test_long_groups_are_reported_and_rejected(spark):
    from spanlake.operators.limits import group_sizes, split_oversized
    from spanlake.operators.sequences import stitch_windows
    rows = spark.range(20_000).select(
        F.when(F.col("id") < 19_000, "long").when(F.col("id") < 19_990, "fits").otherwise(F.lit(None).cast("string")).alias("example_id"),
        F.when(F.col("id") < 19_000, F.col("id")).when(F.col("id") < 19_990, F.col("id") - 19_000).otherwise(F.col("id") - 19_990)
        .cast("int").alias("split_id"), F.lit(1).alias("plen"), F.array(F.lit(4), (F.col("id") % 5).cast("int"), F.lit(2)).alias("labels")).repartition(6)
    assert {r["example_id"]: (r["n_rows"], r["length"]) for r in group_sizes(rows, ["example_id"], F.size("labels")).collect()} == {
        "long": (19_000, 57_000), "fits": (990, 2970), None: (10, 30)}
    ok, bad = split_oversized(rows, ["example_id"], F.size("labels"), 3000)
    assert [(r["check"], r["key"], r["detail"]) for r in bad.collect()] == [("group_size", "long", "19000 rows, length 57000")]
    got = {r["example_id"]: r for r in stitch_windows(ok, ["labels"]).collect()}
    assert set(got) == {"fits", None} and got["fits"]["n_windows"] == 990 and not got["fits"]["split_gap"]
    assert got["fits"]["labels"][:5] == [4, 19_000 % 5, 2, 19_001 % 5, 2] and len(got["fits"]["labels"]) == 3 + 989 * 2
    # a file of many thousand windows is stitched whole below the limit
    whole = stitch_windows(split_oversized(rows, ["example_id"], F.size("labels"), 100_000)[0], ["labels"])
    assert whole.where("example_id = 'long'").select(F.size("labels")).first()[0] == 3 + 18_999 * 2


def test_sequences_of_ids_need_no_encoding(spark):
    import pytest

    from spanlake.plans import lifecycle as L
    vocab = spark.createDataFrame([("'a'", 5), ("'b'", 6), ("'[SEP]_'", 7), ("'[UNK]_'", 0)], "token string, id int")
    rows = [(1, 1, ["a", "[SEP]_", "b", "[SEP]_"], [4, 4, 0, 1]), (2, 0, ["a", "zz"], [4, 2]), (3, 1, ["[SEP]_"], [4, 4])]
    texts = spark.createDataFrame(rows, "row_id long, example_type int, subtokenized_input_sequence array<string>, label_sequence array<int>")
    code = {"a": 5, "b": 6, "[SEP]_": 7, "zz": 0}
    ids = spark.createDataFrame([(i, e, [code[t] for t in ts], ls) for i, e, ts, ls in rows],
                                "row_id long, example_type int, subtokenized_input_sequence array<int>, label_sequence array<int>")
    for mode in ("all", "positive", "negative"):
        got = []
        for df, setting in ((texts, "tokens"), (ids, "prefix")):
            ok, bad = L.sequence_inputs(df, vocab, mode=mode, setting=setting)
            got.append((sorted(map(tuple, ok.select("row_id", "ids", "segments", "mask").collect())), sorted(map(tuple, bad.collect()))))
        assert got[0] == got[1]
        if mode == "all":
            assert got[0] == ([(1, [5, 7, 6, 7], [0, 0, 1, 1], [1] * 4)],
                              [("sequence_inputs", "2", "no separator"), ("sequence_inputs", "3", "labels of another length")])
    with pytest.raises(ValueError):
        L.sequence_inputs(ids, vocab, setting="suffix")
