"""Registered queries for joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.spans import extract_spans, spans_to_string
from spanlake.operators import joins as C
from spanlake.operators.sampling import few_shot_pick
from spanlake.plans import fixtures as fx
from spanlake.plans.oracle_fixtures import with_fx
from spanlake.plans.shared import ints, rows_test, rows_train, sample_files, sql_sample, sql_spans

QUERIES, SQL = {}, {}


def reg(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


ROWS_TEST = "fx_rows_test AS (SELECT * FROM fx_rows WHERE split = 'test')"
ROWS_TRAIN = "fx_rows_train AS (SELECT * FROM fx_rows WHERE split = 'train' AND file_tokens < 1000)"
PICKS = """picks AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_name, example_type
                                              ORDER BY md5(CAST(row_id AS VARCHAR) || '|42'), row_id) AS rk
                 FROM fx_rows_train) WHERE rk = 1)"""


# The metadata of these lookups lacks the nations of one region and the source folder one
# language, so each has rows without a match.
KNOWN_META = "known_meta AS (SELECT * FROM fx_meta WHERE reccomendation <> 'ASIA')"


def known_meta(spark, d):
    return fx.fx_meta(spark, d).where("reccomendation <> 'ASIA'")


@reg("join_query_meta", with_fx(["fx_files", "fx_meta"], """
SELECT f.row_id, f.query_name, m."desc" AS "desc", m.reccomendation,
       CASE WHEN m.query_name IS NULL THEN 'query_meta' END AS missing
FROM fx_files f LEFT JOIN known_meta m ON f.query_name = m.query_name""", KNOWN_META))
def q_join_query_meta(spark, d):
    """Rows and rejects: ``missing`` names the lookup that failed."""
    return C.join_query_meta(fx.fx_files(spark, d), known_meta(spark, d)).select(
        "row_id", "query_name", "desc", "reccomendation", "missing")


@reg("join_source_text", with_fx(["fx_files"], """
SELECT f.row_id, f.code_file_path, CAST(coalesce(length(s.text), 0) AS INTEGER) AS n_chars,
       CASE WHEN s.code_file_path IS NULL THEN 'source_text' END AS missing
FROM fx_files f LEFT JOIN (SELECT 'src/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS code_file_path, text
                           FROM documents WHERE lang <> 'es') s ON f.code_file_path = s.code_file_path"""))
def q_join_source_text(spark, d):
    docs = fx.table(spark, d, "documents").where("lang <> 'es'").select(
        F.concat(F.lit("src/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        .alias("code_file_path"), F.col("text").alias("content"))
    j = C.join_source_text(fx.fx_files(spark, d).select("row_id", "code_file_path"), docs)
    return j.select("row_id", "code_file_path", F.coalesce(F.length("content"), F.lit(0)).alias("n_chars"), "missing")


@reg("vocab_encode", with_fx(["fx_seq", "fx_vocab"], f"""
SELECT example_id, array_to_string(list(CAST(coalesce(v.id, unk.id) AS VARCHAR) ORDER BY t.pos), ',') AS ids
FROM (SELECT example_id, unnest(tokens) AS tok, unnest(range(0, len(tokens))) AS pos FROM fx_seq) t
LEFT JOIN fx_vocab v ON v.token = '''' || t.tok || ''''
CROSS JOIN (SELECT id FROM fx_vocab WHERE token = '''[UNK]_''') unk
GROUP BY example_id"""))
def q_vocab_encode(spark, d):
    seq = fx.fx_seq(spark, d).select("example_id", "tokens")
    enc = C.vocab_encode(seq, fx.fx_vocab(spark, d), "example_id", "tokens")
    return enc.select("example_id", ints("ids").alias("ids"))


@reg("join_folder_map", with_fx(["fx_files", "fx_meta"], """
SELECT f.row_id, m.folder, CASE WHEN m.query_name IS NULL THEN 'folder_map' END AS missing
FROM fx_files f LEFT JOIN known_meta m ON f.query_name = m.query_name""", KNOWN_META))
def q_join_folder_map(spark, d):
    return C.join_folder_map(fx.fx_files(spark, d), known_meta(spark, d)).select("row_id", "folder", "missing")


@reg("join_sample_examples", with_fx(["fx_rows"], """
SELECT s.query_name, s.code_file_path, s.bucket, s.draw_order, r.row_id
FROM smp s LEFT JOIN fx_rows_test r ON s.query_name = r.query_name AND s.code_file_path = r.code_file_path""",
                                     ROWS_TEST + ",\n" + sql_sample("fx_rows_test")))
def q_join_sample_examples(spark, d):
    rows = rows_test(spark, d)
    s = sample_files(rows).select("query_name", "code_file_path", "bucket", "draw_order")
    return C.join_sample_examples(s, rows.select("query_name", "code_file_path", "row_id"))


@reg("join_few_shot", with_fx(["fx_rows"], """
SELECT s.query_name, s.code_file_path,
       max(CASE WHEN p.example_type = 1 THEN p.row_id END) AS pos_row_id,
       max(CASE WHEN p.example_type = 0 THEN p.row_id END) AS neg_row_id
FROM smp s LEFT JOIN picks p ON s.query_name = p.query_name
GROUP BY s.query_name, s.code_file_path""",
                              ROWS_TEST + ",\n" + ROWS_TRAIN + ",\n" + PICKS + ",\n" + sql_sample("fx_rows_test")))
def q_join_few_shot(spark, d):
    s = sample_files(rows_test(spark, d)).select("query_name", "code_file_path")
    picks = few_shot_pick(rows_train(spark, d))
    shots = picks.groupBy("query_name").agg(
        F.max(F.when(F.col("example_type") == 1, F.col("row_id"))).alias("pos_row_id"),
        F.max(F.when(F.col("example_type") == 0, F.col("row_id"))).alias("neg_row_id"))
    return C.join_few_shot(s, shots)


@reg("join_relevance_pred", with_fx(["fx_blocks"], """
SELECT query_name, code_file_path, block_ordinal, predicted, relevance_label FROM fx_blocks"""))
def q_join_relevance_pred(spark, d):
    b = fx.fx_blocks(spark, d)
    preds = b.select("query_name", "code_file_path", "block_ordinal", "predicted")
    return C.join_relevance_pred(b.select("query_name", "code_file_path", "block_ordinal", "relevance_label"),
                                 preds).select("query_name", "code_file_path", "block_ordinal",
                                               "predicted", "relevance_label")


@reg("semi_join_files", with_fx(["fx_rows"], """
SELECT r.row_id, r.query_name FROM fx_rows_test r
WHERE (r.query_name, r.code_file_path) IN (SELECT query_name, code_file_path FROM smp)""",
                                ROWS_TEST + ",\n" + sql_sample("fx_rows_test")))
def q_semi_join_files(spark, d):
    rows = rows_test(spark, d)
    return C.semi_join_files(rows, sample_files(rows)).select("row_id", "query_name")


@reg("join_pred_target", with_fx(["fx_seq"], f"""
SELECT example_id, {sql_spans('labels')} = {sql_spans('output')} AS same_spans,
       {sql_spans('labels')} AS target_spans, {sql_spans('output')} AS output_spans
FROM fx_seq"""))
def q_join_pred_target(spark, d):
    s = fx.fx_seq(spark, d)
    t = s.select("example_id", extract_spans("labels").alias("t"))
    o = s.select("example_id", extract_spans("output").alias("o"))
    j = C.join_pred_target(t, o)
    return j.select("example_id", (F.col("t") == F.col("o")).alias("same_spans"),
                    spans_to_string("t").alias("target_spans"), spans_to_string("o").alias("output_spans"))
