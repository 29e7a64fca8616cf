"""Registered queries for aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import aggregates as D
from spanlake.operators.aggregates import with_bucket
from spanlake.operators.filters import filter_file_budget
from spanlake.operators.sequences import compose_twostep, split_windows, stitch_windows
from spanlake.plans import fixtures as fx
from spanlake.plans.oracle_fixtures import with_fx
from spanlake.plans.shared import (
    SQL_CANDS_LONG, ints, rows_test, sample_files, sql_ints, sql_match, sql_pass, sql_sample, sql_strip,
)

QUERIES, SQL = {}, {}


def reg(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


@reg("count_by_query", with_fx(["fx_rows"], """
SELECT query_name, count(*) AS n, CAST(GROUPING(query_name) AS INTEGER) AS is_total
FROM fx_rows WHERE split = 'test' GROUP BY ROLLUP (query_name)"""))
def q_count_by_query(spark, d):
    return D.count_by_query(rows_test(spark, d))


@reg("file_rollup", with_fx(["fx_rows"], """
SELECT query_name, code_file_path, CAST(min(em) AS INTEGER) AS em,
       CAST(max(example_type) AS INTEGER) AS example_type, CAST(min(example_type) AS INTEGER) AS min_example_type,
       CAST(max(file_tokens) AS INTEGER) AS file_tokens, min(row_id) AS first_row_id, count(*) AS n_rows
FROM fx_rows GROUP BY query_name, code_file_path"""))
def q_file_rollup(spark, d):
    return D.file_rollup(fx.fx_rows(spark, d))


def _files_meta(spark, d):
    return filter_file_budget(D.file_rollup(fx.fx_files(spark, d), max_tokens=3000))


@reg("bucket_counts", with_fx(["fx_files"], """
SELECT query_name, count(*) AS total, CAST(count_if(bucket = 0) AS BIGINT) AS suc_pos, CAST(count_if(bucket = 2) AS BIGINT) AS suc_neg,
       CAST(count_if(bucket = 1) AS BIGINT) AS unsuc_pos, CAST(count_if(bucket = 3) AS BIGINT) AS unsuc_neg,
       CAST(GROUPING(query_name) AS INTEGER) AS is_total,
       round(CASE WHEN count(*) > 0 THEN (count_if(bucket = 0) + count_if(bucket = 2)) / count(*) END, 9)
         AS success_share
FROM smp_fr GROUP BY ROLLUP (query_name)""", sql_sample("fx_files")))
def q_bucket_counts(spark, d):
    return D.bucket_counts(_files_meta(spark, d))


@reg("bucket_lists", with_fx(["fx_files"], """
SELECT query_name, bucket, code_file_path, first_row_id FROM smp_fr""", sql_sample("fx_files")))
def q_bucket_lists(spark, d):
    return with_bucket(_files_meta(spark, d)).select("query_name", "bucket", "code_file_path", "first_row_id")


@reg("sample_summary", with_fx(["fx_files"], """
SELECT query_name, count(*) AS sampled, CAST(count_if(bucket = 0) AS BIGINT) AS b0, CAST(count_if(bucket = 1) AS BIGINT) AS b1,
       CAST(count_if(bucket = 2) AS BIGINT) AS b2, CAST(count_if(bucket = 3) AS BIGINT) AS b3, CAST(GROUPING(query_name) AS INTEGER) AS is_total,
       round(CASE WHEN count(*) > 0 THEN (count_if(bucket = 0) + count_if(bucket = 2)) / count(*) END, 9)
         AS success_share,
       GROUPING(query_name) = 0 AND count(*) < 20 AS under_filled
FROM smp GROUP BY ROLLUP (query_name)""", sql_sample("fx_files")))
def q_sample_summary(spark, d):
    return D.sample_summary(sample_files(fx.fx_files(spark, d)))


@reg("sample_distinct_check", with_fx(["fx_files"], """
SELECT a.query_name, a.distinct_by_bucket, b.distinct_all,
       a.distinct_by_bucket = 20 AND b.distinct_all = 20 AS ok
FROM (SELECT query_name, CAST(sum(dd) AS BIGINT) AS distinct_by_bucket
      FROM (SELECT query_name, bucket, count(DISTINCT code_file_path) AS dd FROM smp GROUP BY 1, 2)
      GROUP BY 1) a
JOIN (SELECT query_name, count(DISTINCT code_file_path) AS distinct_all FROM smp GROUP BY 1) b
  ON a.query_name = b.query_name""", sql_sample("fx_files")))
def q_sample_distinct_check(spark, d):
    return D.sample_distinct_check(sample_files(fx.fx_files(spark, d)))


@reg("file_answer_agg", with_fx(["fx_rows"], """
SELECT query_name, code_file_path,
       CASE WHEN string_agg(a, '' ORDER BY row_id) = '' THEN 'N/A' ELSE string_agg(a, '' ORDER BY row_id) END
         AS answer_spans,
       string_agg(f, '' ORDER BY row_id) AS supporting_fact_spans,
       CAST(min(example_type) AS INTEGER) AS example_type, min(example_type) <> max(example_type) AS class_conflict
FROM (SELECT *, array_to_string(answer_texts, ':::-:::') AS a, array_to_string(fact_texts, ':::-:::') AS f
      FROM fx_rows)
GROUP BY query_name, code_file_path"""))
def q_file_answer_agg(spark, d):
    return D.file_answer_agg(fx.fx_rows(spark, d))


def _sql_em(by: str | None) -> str:
    from spanlake.plans.shared import sql_spans
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return with_fx(["fx_seq"], f"""
SELECT {sel}count(*) AS n, CAST(sum(hit) AS BIGINT) AS exact, round(avg(hit), 9) AS exact_match
FROM (SELECT *, CAST({sql_spans('labels')} = {sql_spans('output')} AS INTEGER) AS hit FROM fx_seq){grp}""")


@reg("exact_match_rate", _sql_em("lang"))
def q_exact_match_rate(spark, d):
    return D.exact_match_rate(fx.fx_seq(spark, d), "labels", "output", by=["lang"])


# --- two-step composition (D14) and its metric (D9) --------------------------------
def _sql_body(b: str, prov: bool) -> str:
    if prov:
        return (f"list_transform(list_slice({b}.labels, p + 1, len({b}.labels)), "
                f"lambda x, j: {{'label': x, 'bi': {b}.bi, 'bo': CAST(j - 1 AS INTEGER)}})")
    return f"list_slice({b}.tokens, p + 1, len({b}.tokens))"


def _sql_joined(sel: str, prov: bool) -> str:
    sep = "[{'label': 4, 'bi': -1, 'bo': -1}]" if prov else "['[SEP]_']"
    return (f"flatten(list_transform({sel}, lambda b, i: CASE WHEN i < len({sel}) "
            f"THEN list_concat({_sql_body('b', prov)}, {sep}) ELSE {_sql_body('b', prov)} END))")


_PSEL = "list_filter(bl, lambda b: (CASE WHEN nb = 1 THEN 1 ELSE b.pr END) = 1)"
_TSEL = "list_filter(bl, lambda b: (CASE WHEN nb = 1 THEN 1 ELSE b.rl END) = 1)"
_HEAD = "list_transform(list_slice(bl[1].labels, 1, p), lambda x: {'label': x, 'bi': -1, 'bo': -1})"

SQL_TWOSTEP = """ts_g AS (
  SELECT query_name, code_file_path,
         list({'ord': block_ordinal, 'bi': block_index, 'pr': predicted, 'rl': relevance_label,
               'tokens': tokens, 'labels': labels} ORDER BY block_ordinal, row_id) AS bl
  FROM fx_blocks GROUP BY query_name, code_file_path),
ts_p AS (
  SELECT *, len(bl) AS nb,
         list_filter(range(1, len(bl[1].labels)),
                     lambda i: bl[1].labels[i] = 4 AND bl[1].labels[i + 1] <> 4)[1] AS p
  FROM ts_g),
ts AS (
  SELECT query_name, code_file_path, p, nb,
         list_concat(list_slice(bl[1].tokens, 1, p), """ + _sql_joined(_PSEL, False) + """) AS tokens,
         list_concat(""" + _HEAD + ", " + _sql_joined(_PSEL, True) + """) AS predicted,
         list_concat(""" + _HEAD + ", " + _sql_joined(_TSEL, True) + """) AS target
  FROM ts_p)"""


def _sql_prov(P: str) -> str:
    return f"array_to_string(list_transform({P}, lambda x: CAST(x.label AS VARCHAR) || ':' || CAST(x.bi AS VARCHAR) || ':' || CAST(x.bo AS VARCHAR)), ',')"


def _sql_spans2(P: str) -> str:
    runs = f"regexp_extract_all(array_to_string(list_transform({P}, lambda x: x.label), ''), '[03]1*')"
    starts = f"list_filter(range(0, len({P})), lambda i: {P}[i + 1].label IN (0, 3))"
    item = (f"array_to_string(list_transform(list_slice({P}, z[1] + 1, z[1] + length(z[2])), "
            f"lambda x: CAST(x.bi AS VARCHAR) || '.' || CAST(x.bo AS VARCHAR)), ',') || '|' || "
            f"CAST({P}[z[1] + 1].label AS VARCHAR)")
    return (f"array_to_string(list_sort(list_distinct(list_transform(list_zip({starts}, {runs}), "
            f"lambda z: {item}))), ';')")


def _prov_str(c):
    return F.array_join(F.transform(c, lambda x: F.concat_ws(
        ":", x["label"].cast("string"), x["block_index"].cast("string"), x["block_offset"].cast("string"))), ",")


@reg("compose_twostep", with_fx(["fx_blocks"], f"""
SELECT query_name, code_file_path, CAST(p AS INTEGER) AS p, CAST(nb AS INTEGER) AS nb,
       array_to_string(tokens, '~') AS tokens, {_sql_prov('predicted')} AS predicted,
       {_sql_prov('target')} AS target
FROM ts""", SQL_TWOSTEP))
def q_compose_twostep(spark, d):
    c, _ = compose_twostep(fx.fx_blocks(spark, d))
    return c.select("query_name", "code_file_path", F.col("p").cast("int"), F.col("nb").cast("int"),
                    F.array_join("tokens", "~").alias("tokens"), _prov_str(F.col("predicted")).alias("predicted"),
                    _prov_str(F.col("target")).alias("target"))


@reg("twostep_exact_match_rate", with_fx(["fx_blocks"], f"""
SELECT count(*) AS n, CAST(sum(hit) AS BIGINT) AS exact, round(avg(hit), 9) AS exact_match
FROM (SELECT CAST({_sql_spans2('predicted')} = {_sql_spans2('target')} AS INTEGER) AS hit FROM ts)""",
                                         SQL_TWOSTEP))
def q_twostep_exact_match_rate(spark, d):
    return D.twostep_exact_match_rate(compose_twostep(fx.fx_blocks(spark, d))[0], "target", "predicted")


@reg("any_match_rate", with_fx(["fx_cands"], f"""
SELECT query, count(*) AS total, CAST(sum(hit) AS BIGINT) AS correct, round(avg(hit), 9) AS any_match,
       CAST(GROUPING(query) AS INTEGER) AS is_total
FROM (SELECT i, query, max(CASE WHEN {sql_strip('cand')} <> '' AND {sql_match('ans_spans', 'cand')}
                                THEN 1 ELSE 0 END) AS hit
      FROM cl GROUP BY i, query)
GROUP BY ROLLUP (query)""", SQL_CANDS_LONG))
def q_any_match_rate(spark, d):
    return D.any_match_rate(fx.fx_cands(spark, d))


@reg("pass_at_k", with_fx(["fx_cands"], f"""
SELECT k, count(*) AS total, round(sum(pass), 9) AS pass_sum, round(sum(pass) / count(*), 9) AS pass_at_k
FROM (SELECT k, {sql_pass('c', 'k')} AS pass
      FROM (SELECT i, CAST(sum(CASE WHEN {sql_strip('cand')} <> '' AND {sql_match('ans_spans', 'cand')}
                                    THEN 1 ELSE 0 END) AS INTEGER) AS c
            FROM cl GROUP BY i) r
      CROSS JOIN (VALUES (1), (2), (5), (10)) ks(k))
GROUP BY k""", SQL_CANDS_LONG))
def q_pass_at_k(spark, d):
    return D.pass_at_k(fx.fx_cands(spark, d))


@reg("group_blocks", with_fx(["fx_blocks"], """
SELECT query_name, code_file_path,
       array_to_string(list(CAST(block_index AS VARCHAR) ORDER BY row_id), ',') AS blocks, count(*) AS n_blocks
FROM fx_blocks GROUP BY query_name, code_file_path"""))
def q_group_blocks(spark, d):
    g = D.group_blocks(fx.fx_blocks(spark, d), "all")
    return g.select("query_name", "code_file_path",
                    F.array_join(F.transform("blocks", lambda x: x["block_index"].cast("string")), ",").alias("blocks"),
                    "n_blocks")


@reg("stitch_windows", with_fx(["fx_seq"], f"""
SELECT example_id,
       CAST(CASE WHEN len(labels) < 16 THEN 1 ELSE ceil((len(labels) - plen) / (16 - plen)) END AS BIGINT) AS n_windows,
       CAST(coalesce(list_filter(range(1, len(labels)), lambda i: labels[i] = 4 AND labels[i + 1] <> 4)[1], -1)
            AS INTEGER) AS plen,
       {sql_ints('labels')} AS labels, {sql_ints('output')} AS output, false AS split_gap
FROM fx_seq"""))
def q_stitch_windows(spark, d):
    """Split at width 16 and stitch back: the identity on every sequence."""
    w, _ = split_windows(fx.fx_seq(spark, d).select("example_id", "labels", "output"), 16, ["labels", "output"])
    s = stitch_windows(w, ["labels", "output"])
    # plen -1: no query prefix (a short sequence kept whole)
    return s.select("example_id", "n_windows", F.coalesce(F.col("plen").cast("int"), F.lit(-1)).alias("plen"),
                    ints("labels").alias("labels"),
                    ints("output").alias("output"), "split_gap")


@reg("batch_loss", with_fx(["fx_logits"], """
SELECT count(*) AS n_batches, round(sum(batch_mean), 9) AS total_loss,
       round(sum(ce_sum) / sum(positions), 9) AS mean_loss
FROM (SELECT batch_id, sum(ce_sum) / sum(positions) AS batch_mean, sum(ce_sum) AS ce_sum,
             sum(positions) AS positions
      FROM (SELECT (row_number() OVER (ORDER BY ordinal NULLS LAST) - 1) // 4 AS batch_id,
                   list_sum(list_transform(range(1, len(targets) + 1), lambda p:
                       list_max(logits[p]) + ln(list_sum(list_transform(logits[p], lambda x: exp(x - list_max(logits[p])))))
                       - logits[p][targets[p] + 1])) AS ce_sum,
                   len(targets) AS positions
            FROM fx_logits)
      GROUP BY batch_id)"""))
def q_batch_loss(spark, d):
    return D.batch_loss(fx.fx_logits(spark, d), ordinal="ordinal")
