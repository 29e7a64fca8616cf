"""Empty tables, nulls, empty and repeated rows, clashing columns for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanlake.llm import ann, decontaminate, jaccard, langid, maxent, mixing, pii, suffixes, urlfilter, warc
from spanlake.session import scratch_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "und der die ist von mit " * 400
ROWS = [(1, "the cat sat on the mat with a hat and a bat", "en", "a", 43), (1, "the cat sat on the mat with a hat and a bat", "en", "a", 43),
        (2, None, None, None, None), (3, "", "en", "b", 0), (None, "le chat est la", "fr", None, 14), (4, LONG, "de", "a", len(LONG)),
        (5, "12345 !!", None, "b", 8), (6, LONG, "de", "c", len(LONG))]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("x"), "size": F.lit("y"), "n_hit": F.lit(1), "copies": F.lit(9)})


def bench(spark, rows=((1, "on the mat with a hat and a bat"), (2, None), (None, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


CASES = {
    "op1": lambda s, d: suffixes.remove_repeats(d),
    "op2": lambda s, d: langid.predict(d, langid.fit_documents(d)).select("doc_id", "lang_pred", "score"),
    "op4": lambda s, d: decontaminate.contamination(d, bench(s)),
    "op6": lambda s, d: maxent.score(d, F.lit(False), F.col("doc_id").isNotNull()),
    "op7": lambda s, d: pii.with_spans(pii.with_candidates(d), pii.Model()),
    "op9": lambda s, d: jaccard.join(d),
    "op10": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", CASES)
def test_documents(spark, name):
    assert CASES[name](spark, docs(spark)).count() == len(ROWS)
    assert CASES[name](spark, docs(spark, [])).count() == 0


def test_repeats_and_copies(spark):
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs(spark)).collect()}
    assert got[4]["n_removed"] == 0 and got[6]["n_removed"] == got[6]["n_bytes"] == len(LONG) and got[6]["n_spans"] == 1
    assert got[2]["n_bytes"] == 0 and got[1]["n_removed"] == 0
    links = {(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.join(docs(spark)).collect()}
    assert (6, 4, 1) in links and (4, 4, 1) in links and (1, 1, 1) in links and (None, None, 0) in links and (3, 3, 0) in links


def test_language_without_letters(spark):
    got = {r["doc_id"]: r for r in langid.predict(docs(spark), langid.fit(docs(spark))).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[5]["lang_pred"] == "und" and got[5]["score"] == 0
    assert got[4]["lang_pred"] == "de" and got[None]["lang_pred"] == "fr"


def test_decontamination_cases(spark):
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs(spark), bench(spark)).collect()}
    assert got[1]["n_hit"] == 9 and got[1]["n_items"] == 1 and got[1]["contaminated"] and not got[4]["contaminated"]
    assert decontaminate.contamination(docs(spark), bench(spark, [])).where("contaminated").count() == 0
    assert decontaminate.remove_contaminated(docs(spark), bench(spark)).columns == docs(spark).columns
    mine = docs(spark).withColumns({"_hit": F.lit("mine"), "_items": F.lit(7), "__hit": F.lit(8)})
    kept = decontaminate.remove_contaminated(mine, bench(spark))
    assert kept.columns == mine.columns and {(r["_hit"], r["_items"]) for r in kept.collect()} == {("mine", 7)}
    # several blocks of windows give the same rows as one
    many = bench(spark, [(k, "on the mat with a hat and a bat") for k in range(5)] + [(9, "von mit")])
    one = decontaminate.contamination(docs(spark), many).toPandas().sort_values(["doc_id", "n_words"]).reset_index(drop=True)
    two = decontaminate.contamination(docs(spark), many, block_windows=2).toPandas().sort_values(["doc_id", "n_words"]).reset_index(drop=True)
    assert one.equals(two) and one["n_items"].max() == 5


def test_pages(spark):
    rows = [(1, "https://A.example.org/en/1x?q", "x"), (2, None, None), (3, "no host", ""), (4, "http://b.com/de/7", "x"), (4, "http://b.com/de/7", "x"),
            (None, "http://b.com/fr/\r\n7", "x" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r for r in urlfilter.judge(pages).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/en/1x", "example.org/en/1", "block")
    assert got[2]["host"] == got[3]["path"] == "" and got[4]["rule"] == "com/de/" and got[None]["rule"] == "com/fr/"
    assert urlfilter.judge(pages.limit(0)).count() == 0
    root = scratch_dir(spark, "warc-test")
    back = warc.read_archives(warc.write_archives(pages, root, archive_bytes=100), root).collect()
    kind = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back if r["page_id"] in (1, 4, None))
    assert kind == [(0, "response", None, 200_000), (1, "response", None, 1), (4, "revisit", 1, 1), (4, "revisit", 1, 1)]
    assert {r["payload"] for r in back if r["page_id"] == 1} == {b"x"}
    empty = scratch_dir(spark, "warc-empty")
    assert warc.read_archives(warc.write_archives(pages.limit(0), empty), empty).count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]),
            (5, [None, 1.0]), (6, [1.0, 0.0]), (40, [1.0]), (None, [1.0, 1.0]), (7, [float("inf"), 0.0]), (8, [])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    got = [tuple(r) for r in ann.nearest(t, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 1.0), (0, 2, 20, 1.0), (0, 3, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 6, 1.0), (20, 3, 1, 0.5)]
    assert ann.nearest(t.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, tmp_path, stage):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    base = spark.createDataFrame(ROWS, DOCS)
    for rows in (base, base.limit(0)):
        out = run(spark, rows, str(tmp_path))
        n = out.count()
        assert n <= 3 * rows.count()
        if stage != "mixture":
            assert out.columns == base.columns
    kept = {r["doc_id"] for r in run(spark, base, str(tmp_path)).collect()}
    expect = {"language_id": {1, None, 4, 6}, "near_duplicates": {1, 2, 3, None, 4, 5}, "decontamination": {2, 3, None, 4, 5, 6},
              "personal_data": {1, 2, 3, None, 4, 5, 6}}
    if stage in expect:
        assert kept == expect[stage]
