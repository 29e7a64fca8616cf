"""Registered queries for windows (E1-E5), sorting/sampling (F1-F5) and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.spans import extract_spans, span_set_equal
from spanlake.operators import sampling as S
from spanlake.operators import windows as E
from spanlake.operators.aggregates import file_rollup, with_bucket
from spanlake.operators.filters import filter_file_budget
from spanlake.operators.sequences import split_windows
from spanlake.plans import fixtures as fx
from spanlake.plans.oracle_fixtures import with_fx
from spanlake.plans.shared import rows_test, rows_train, sample_files, sql_sample, sql_spans

QUERIES, SQL = {}, {}


def reg(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


def _files_meta(spark, d):
    return filter_file_budget(file_rollup(fx.fx_files(spark, d), max_tokens=3000))


BLOCK_ROWS = "br AS (SELECT * FROM fx_blocks)"
SINGLE = """single AS (
  SELECT * FROM br WHERE (query_name, code_file_path) IN (
    SELECT query_name, code_file_path FROM br GROUP BY 1, 2 HAVING count(*) = 1))"""
SEEDED = """seeded AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_name
                      ORDER BY md5(CAST(row_id AS VARCHAR) || '|42'), row_id) AS INTEGER) AS sample_rank
                 FROM single) WHERE sample_rank <= 10)"""


def _block_rows(spark, d):
    """Rows grouped into files of several blocks (one file per conversation and role)."""
    return fx.fx_blocks(spark, d)


# E1-E5 ---------------------------------------------------------------------------
@reg("rank_in_bucket", with_fx(["fx_files"], """
SELECT query_name, bucket, code_file_path, CAST(rank_in_bucket AS BIGINT) AS rank_in_bucket FROM smp_fr""", sql_sample("fx_files")))
def q_rank_in_bucket(spark, d):
    r = E.rank_in_bucket(with_bucket(_files_meta(spark, d)))
    return r.select("query_name", "bucket", "code_file_path", "rank_in_bucket")


@reg("singleton_files", with_fx(["fx_blocks"], "SELECT row_id, query_name FROM single",
                                BLOCK_ROWS + ",\n" + SINGLE))
def q_singleton_files(spark, d):
    return E.singleton_files(_block_rows(spark, d)).select("row_id", "query_name")


@reg("row_index", with_fx(["fx_rows"], """
SELECT query_name, row_id, row_number() OVER (PARTITION BY query_name ORDER BY row_id) - 1 AS i
FROM fx_rows WHERE split = 'test' AND example_type = 1"""))
def q_row_index(spark, d):
    r = rows_test(spark, d).where(F.col("example_type") == 1)
    return E.row_index(r, "query_name", ("row_id",)).select("query_name", "row_id", "i")


@reg("split_index", with_fx(["fx_seq"], """
SELECT example_id, CAST(unnest(range(0, n)) AS INTEGER) AS split_id, p AS plen
FROM (SELECT example_id, plen,
             CAST(coalesce(list_filter(range(1, len(labels)), lambda i: labels[i] = 4 AND labels[i + 1] <> 4)[1], -1)
                  AS INTEGER) AS p,
             CAST(CASE WHEN len(labels) < 16 THEN 1 ELSE ceil((len(labels) - plen) / (16 - plen)) END AS INTEGER) AS n
      FROM fx_seq)"""))
def q_split_index(spark, d):
    w, _ = split_windows(fx.fx_seq(spark, d).select("example_id", "labels"), 16, ["labels"])
    return w.select("example_id", "split_id", F.coalesce(F.col("plen").cast("int"), F.lit(-1)).alias("plen"))


@reg("example_index", with_fx(["fx_seq"], """
SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) - 1 AS example_index FROM fx_seq"""))
def q_example_index(spark, d):
    return E.example_index(fx.fx_seq(spark, d).select("doc_id", "lang"), ["lang", "doc_id"],
                           "example_index").select("doc_id", "example_index")


# F1-F5 -----------------------------------------------------------------------------
@reg("stratified_sample", with_fx(["fx_files"], """
SELECT query_name, bucket, rank_in_bucket, draw_order, code_file_path FROM smp""", sql_sample("fx_files")))
def q_stratified_sample(spark, d):
    return sample_files(fx.fx_files(spark, d)).select("query_name", "bucket", "rank_in_bucket",
                                                      "draw_order", "code_file_path")


@reg("seeded_sample_n", with_fx(["fx_blocks"], "SELECT query_name, row_id, sample_rank FROM seeded",
                                BLOCK_ROWS + ",\n" + SINGLE + ",\n" + SEEDED))
def q_seeded_sample_n(spark, d):
    s = S.seeded_sample_n(E.singleton_files(_block_rows(spark, d)), 10)
    return s.select("query_name", "row_id", "sample_rank")


@reg("few_shot_pick", with_fx(["fx_rows"], """
SELECT query_name, example_type, row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_name, example_type
                               ORDER BY md5(CAST(row_id AS VARCHAR) || '|42'), row_id) AS rk
  FROM fx_rows WHERE split = 'train' AND file_tokens < 1000) WHERE rk = 1"""))
def q_few_shot_pick(spark, d):
    return S.few_shot_pick(rows_train(spark, d)).select("query_name", "example_type", "row_id")


@reg("first_seen_order", with_fx(["fx_rows"], """
SELECT query_name, code_file_path, min(row_id) AS first_row_id FROM fx_rows GROUP BY 1, 2"""))
def q_first_seen_order(spark, d):
    return S.first_seen_order(fx.fx_rows(spark, d))


@reg("bucket_major_order", with_fx(["fx_files"], """
SELECT query_name, code_file_path, bucket, rank_in_bucket,
       CAST(row_number() OVER (PARTITION BY query_name ORDER BY bucket, rank_in_bucket) AS INTEGER) AS consume_order
FROM smp""", sql_sample("fx_files")))
def q_bucket_major_order(spark, d):
    s = S.bucket_major_order(sample_files(fx.fx_files(spark, d)))
    return s.select("query_name", "code_file_path", "bucket", "rank_in_bucket", "consume_order")


# G1-G3 -------------------------------------------------------------------------------
@reg("union_topup", with_fx(["fx_blocks"], """
SELECT query_name, row_id, CAST(len(answer_texts) AS INTEGER) AS n_answers FROM seeded
UNION ALL
SELECT query_name, row_id, CAST(len(answer_texts) AS INTEGER) AS n_answers FROM single
WHERE len(answer_texts) > 1
  AND query_name IN (SELECT query_name FROM single GROUP BY 1
                     HAVING (SELECT count(*) FROM seeded s WHERE s.query_name = single.query_name) < 10)""",
                            BLOCK_ROWS + ",\n" + SINGLE + ",\n" + SEEDED))
def q_union_topup(spark, d):
    rows = _block_rows(spark, d).select("query_name", "code_file_path", "row_id", "answer_spans")
    return S.sample_with_topup(rows, 10).select("query_name", "row_id", F.size("answer_spans").alias("n_answers"))


@reg("distinct_files", with_fx(["fx_rows"], "SELECT DISTINCT query_name, code_file_path FROM fx_rows"))
def q_distinct_files(spark, d):
    return S.distinct_files(fx.fx_rows(spark, d))


@reg("span_set_equal", with_fx(["fx_seq"], f"""
SELECT example_id, {sql_spans('labels')} = {sql_spans('output')} AS equal FROM fx_seq"""))
def q_span_set_equal(spark, d):
    s = fx.fx_seq(spark, d)
    return s.select("example_id", span_set_equal(extract_spans("labels"), extract_spans("output")).alias("equal"))
