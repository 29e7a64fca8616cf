"""Generation: clients, stored answers, prompts and their rejects, templates."""

import pytest
from pyspark.sql import functions as F

from spanlake.operators import inference as I


def _client(answer):
    def factory():
        return lambda prompts, n, instructions: [{"text": answer, "finish_reason": "stop"} for _ in range(len(prompts) * n)]
    return factory


def test_each_call_gets_its_own_client(spark):
    df = spark.range(6).select(F.concat(F.lit("p"), "id").alias("prompt")).repartition(1)
    for answer in "ABCDEFGH":
        out = I.generate_candidates(df, _client(answer), n=1, timeout=0.0, sleep=lambda s: None)
        assert {r["cands"][0]["text"] for r in out.collect()} == {answer}


def test_nothing_is_asked_twice(spark, tmp_path):
    from spanlake.plans import lifecycle as L

    def random_client():
        import uuid
        return lambda prompts, n, instructions: [{"text": uuid.uuid4().hex, "finish_reason": "stop"} for _ in range(len(prompts) * n)]

    spans = F.lit("x")
    prompts = spark.range(6).select(F.lit("q").alias("query_name"), F.concat(F.lit("f"), "id").alias("code_file_path"),
                                    F.col("id").cast("int").alias("consume_order"), spans.alias("answer_spans"),
                                    F.concat(F.lit("p"), "id").alias("prompt"))
    lost = prompts.withColumn("query_name", F.lit("unknown"))
    meta = spark.createDataFrame([("q", "d", "r", "fold")], "query_name string, desc string, reccomendation string, folder string")
    store = str(tmp_path / "store")
    opts = dict(n=2, store=store, timeout=0.0, sleep=lambda s: None)
    rows = L.generate_logs(prompts.unionByName(lost).where("code_file_path <> 'f5' or query_name = 'q'"), meta, random_client, str(tmp_path / "a"), on_miss="skip", **opts)
    first = sorted(map(repr, rows.collect()))
    assert first == sorted(map(repr, rows.collect())) and len(first) == 6
    with pytest.raises(ValueError, match="unknown"):  # no call was made for the others either
        L.generate_logs(prompts.unionByName(lost), meta, random_client, str(tmp_path / "c"), **{**opts, "store": str(tmp_path / "none")})
    assert not (tmp_path / "none").exists() and not (tmp_path / "c").exists()
    again = L.generate_logs(prompts, meta, random_client, str(tmp_path / "b"), **opts)
    assert sorted(map(repr, again.collect())) == first and spark.read.parquet(store).count() == 6


def test_prompt_rejects_carry_their_reason(spark):
    from spanlake.plans import lifecycle as L
    names = ["ok", "no_meta", "no_text", "no_rows"]
    sample = spark.createDataFrame([(n if n == "no_meta" else "q", n, 0, 1, i) for i, n in enumerate(names)],
                                   "query_name string, code_file_path string, bucket int, rank_in_bucket int, consume_order int")
    rows = spark.createDataFrame(
        [(i, n if n == "no_meta" else "q", n, [("code", 0)], [("span",)], [], 1) for i, n in enumerate(names[:3])],
        "row_id long, query_name string, code_file_path string, context_blocks array<struct<content:string,index:int>>, "
        "answer_spans array<struct<span:string>>, supporting_fact_spans array<struct<span:string>>, example_type int")
    meta = spark.createDataFrame([("q", None, "fix")], "query_name string, desc string, reccomendation string")
    files = spark.createDataFrame([(n, "text of " + n) for n in names if n != "no_text"], "code_file_path string, content string")
    ok, bad = L.build_prompts(sample, rows, rows, meta, files)
    assert [r["code_file_path"] for r in ok.collect()] == ["ok"] and "N/A" in ok.first()["prompt"]
    assert {r["code_file_path"]: r["reason"] for r in bad.collect()} == {
        "no_meta": "no metadata", "no_text": "no source file", "no_rows": "no example rows"}
    assert [r["reason"] for r in L.build_prompts(sample, rows, rows, meta, files, max_tokens=1)[1].where("code_file_path = 'ok'").collect()] == ["over budget"]
    whole = {r["row_id"]: (r["input_code"], r["missing"]) for r in L.row_inputs(rows, meta, files).collect()}
    assert whole == {0: ("text of ok", None), 1: ("text of no_meta", "query_meta"), 2: (None, "source_text")}


def test_template_trimming(spark):
    from spanlake.functions.text import render_prompt
    df = spark.createDataFrame([(["a", "b"], "v")], "xs array<string>, x string")
    t = "head\n{%- for s in xs -%}\n [{{ s }}] \n{%- endfor %}\ntail {{- x -}}  end\n"
    assert df.select(render_prompt(t, {"xs": "xs", "x": "x"}).alias("p")).first()["p"] == "head[a][b]\ntailvend"
