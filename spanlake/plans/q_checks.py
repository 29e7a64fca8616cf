"""Registered queries for the data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import checks as J
from spanlake.operators.aggregates import file_rollup, match_count
from spanlake.operators.filters import filter_file_budget
from spanlake.operators.sampling import few_shot_pick
from spanlake.operators.sequences import pad_span_inputs, split_windows
from spanlake.plans import fixtures as fx
from spanlake.plans.oracle_fixtures import TOKEN_RE, with_fx
from spanlake.plans.shared import (
    SQL_CANDS_LONG, rows_test, rows_train, sample_files, sql_match, sql_sample, sql_strip,
)

QUERIES, SQL = {}, {}



def reg(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


@reg("chk_lengths", f"""
SELECT 'chk_lengths' AS "check", CAST(doc_id AS VARCHAR) AS key,
       CAST(w AS VARCHAR) || ',' || CAST(t AS VARCHAR) AS detail
FROM (SELECT doc_id, len(string_split(text, ' ')) AS w, len(regexp_extract_all(text, '{TOKEN_RE}')) AS t
      FROM documents)
WHERE w <> t""")
def q_chk_lengths(spark, d):
    """The fixtures' parallel arrays (which agree), and words between blanks against lexer
    tokens of the same text (which differ wherever there is a sign)."""
    s = fx.fx_seq(spark, d)
    b = fx.fx_blocks(spark, d)
    t = fx.table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("words"),
                                               F.regexp_extract_all("text", F.lit(TOKEN_RE), F.lit(0)).alias("toks"))
    return (J.chk_lengths(s, ["example_id"], ["tokens", "labels", "output"])
            .unionByName(J.chk_lengths(b, ["row_id"], ["subtokenized_input_sequence", "label_sequence"]))
            .unionByName(J.chk_lengths(t, ["doc_id"], ["words", "toks"])))


@reg("chk_padded", with_fx(["fx_seq"], """
SELECT 'chk_padded' AS "check", CAST(example_id AS VARCHAR) AS key,
       CAST(len(tokens) AS VARCHAR) || ',' || CAST(len(labels) AS VARCHAR) AS detail
FROM fx_seq WHERE len(tokens) <> 1024 OR len(labels) <> 1024"""))
def q_chk_padded(spark, d):
    """The padded inputs (which hold the rule) and the sequences before padding."""
    raw = fx.fx_seq(spark, d)
    s = raw.withColumn("ids", F.col("labels")).withColumn("segments", F.col("labels")) \
        .withColumn("mask", F.col("labels"))
    p = pad_span_inputs(s)
    return J.chk_padded(p, ["example_id"], ["ids", "segments", "mask", "labels"], 1024).unionByName(
        J.chk_padded(raw, ["example_id"], ["tokens", "labels"], 1024))


_FIRST_SEP_OUT = "list_filter(range(1, len(output)), lambda i: output[i] = 4 AND output[i + 1] <> 4)[1]"


@reg("chk_has_sep", with_fx(["fx_seq"], f"""
SELECT 'chk_has_sep' AS "check", CAST(example_id AS VARCHAR) AS key,
       CASE WHEN list_position(tokens, '[SEP]_') IS NULL THEN 'no separator'
            ELSE 'separator label not on separator token' END AS detail
FROM fx_seq WHERE list_position(tokens, '[SEP]_') IS NULL OR coalesce(tokens[{_FIRST_SEP_OUT}] <> '[SEP]_', true)"""))
def q_chk_has_sep(spark, d):
    """Separator check against the *output* labels: outputs whose first separator label
    moved off the separator token are reported."""
    return J.chk_has_sep(fx.fx_seq(spark, d), ["example_id"], "tokens", "output")


@reg("chk_prefix", with_fx(["fx_seq"], f"""
SELECT 'chk_prefix' AS "check", CAST(example_id AS VARCHAR) || '|' || CAST(s AS VARCHAR) AS key,
       'prefix not all pad' AS detail
FROM (SELECT example_id, s, list_filter(range(1, len(w)), lambda i: w[i] = 4 AND w[i + 1] <> 4)[1] AS p, w
      FROM (SELECT example_id, s,
                   CASE WHEN len(output) < 16 THEN output
                        ELSE list_concat(list_slice(output, 1, plen),
                                         list_slice(output, plen + 1 + s * (16 - plen), plen + (s + 1) * (16 - plen)))
                   END AS w
            FROM (SELECT *, unnest(range(0, CAST(CASE WHEN len(labels) < 16 THEN 1
                        ELSE ceil((len(labels) - plen) / (16 - plen)) END AS BIGINT))) AS s FROM fx_seq)))
WHERE p IS NULL OR len(list_filter(list_slice(w, 1, p), lambda x: x <> 4)) > 0
UNION ALL
SELECT 'chk_prefix', CAST(example_id AS VARCHAR), 'prefix not all pad' FROM pfx
WHERE p IS NULL OR len(list_filter(list_slice(output, 1, p), lambda x: x <> 4)) > 0 OR p > plen
   OR len(list_filter(list_slice(tokens, 1, p), lambda t: length(t) = 0)) > 0
UNION ALL
SELECT 'chk_prefix', lang, 'prefix lengths: ' || CAST(count(DISTINCT p) AS VARCHAR) FROM pfx
GROUP BY lang HAVING count(DISTINCT p) > 1""", f"pfx AS (SELECT *, {_FIRST_SEP_OUT} AS p FROM fx_seq)"))
def q_chk_prefix(spark, d):
    """Prefix check on the output-label windows (split with the target's prefix); then on
    whole sequences with the target's segments, a mask that leaves out empty tokens, and
    one prefix length asked of each language."""
    w, _ = split_windows(fx.fx_seq(spark, d).select("example_id", "labels", "output"), 16, ["labels", "output"])
    w = w.withColumn("k", F.concat_ws("|", F.col("example_id").cast("string"), F.col("split_id").cast("string")))
    seq = (fx.fx_seq(spark, d)
           .withColumn("segments", F.transform("tokens", lambda t, i: (i >= F.col("plen")).cast("int")))
           .withColumn("mask", F.transform("tokens", lambda t: (F.length(t) > 0).cast("int"))))
    return J.chk_prefix(w, ["k"], labels="output").unionByName(
        J.chk_prefix(seq, ["example_id"], "output", "segments", "mask", ["lang"]))


@reg("chk_windows", with_fx(["fx_seq"], """
SELECT 'chk_windows' AS "check", CAST(example_id AS VARCHAR) AS key, 'window count' AS detail
FROM (SELECT example_id, CASE WHEN n < 16 THEN 1 ELSE ceil((n - plen) / (16 - plen)) END AS n16,
             CASE WHEN n < 32 THEN 1 ELSE ceil((n - plen) / (32 - plen)) END AS n32
      FROM (SELECT example_id, plen, len(labels) AS n FROM fx_seq))
WHERE n16 <> n32"""))
def q_chk_windows(spark, d):
    """Windows of width 16, checked against the rule for 16 (which holds) and for 32."""
    s = fx.fx_seq(spark, d).select("example_id", "labels")
    w, _ = split_windows(s, 16, ["labels"])
    return J.chk_windows(w, s, 16).unionByName(J.chk_windows(w, s, 32))


@reg("chk_class_per_file", with_fx(["fx_rows"], """
SELECT 'chk_class_per_file' AS "check", query_name || '|' || code_file_path AS key,
       CASE WHEN lo <> hi THEN 'mixed example types'
            WHEN max_spans > 0 AND lo <> 1 THEN 'spans on a negative file'
            ELSE 'positive file without spans' END AS detail
FROM (SELECT query_name, code_file_path, min(example_type) AS lo, max(example_type) AS hi,
             max(len(answer_texts)) AS max_spans FROM fx_rows GROUP BY 1, 2
      UNION ALL
      SELECT query_name, code_file_path, min(em), max(em), max(len(answer_texts)) FROM fx_rows GROUP BY 1, 2)
WHERE lo <> hi OR (max_spans > 0 AND lo <> 1) OR (max_spans = 0 AND lo = 1)"""))
def q_chk_class_per_file(spark, d):
    """The rows by their class (which hold the rule), and with the match flag for the class,
    which mixes classes in a file and gives spans to negative ones."""
    r = fx.fx_rows(spark, d)
    return J.chk_class_per_file(r).unionByName(J.chk_class_per_file(r.withColumn("example_type", F.col("em"))))


@reg("chk_negative_empty", with_fx(["fx_rows"], """
SELECT 'chk_negative_empty' AS "check", query_name || '|' || CAST(row_id AS VARCHAR) AS key,
       'negative with spans' AS detail
FROM picks WHERE em = 0 AND len(answer_texts) + len(fact_texts) > 0
UNION ALL
SELECT 'chk_negative_empty', query_name, CASE WHEN min(em) = 1 THEN 'no negative example' ELSE 'no positive example' END
FROM picks GROUP BY query_name HAVING min(em) = max(em)""", """picks AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_name, em
                                              ORDER BY md5(CAST(row_id AS VARCHAR) || '|42'), row_id) AS rk
                 FROM fx_rows WHERE split = 'train' AND file_tokens < 1000) WHERE rk = 1)"""))
def q_chk_negative_empty(spark, d):
    """The picks by class (which hold the rule; their queries have both classes), and picks
    that take the match flag for the class."""
    train = rows_train(spark, d)
    own = J.chk_negative_empty(few_shot_pick(train))
    return own.unionByName(J.chk_negative_empty(few_shot_pick(train.withColumn("example_type", F.col("em")))))


@reg("chk_sample_size", with_fx(["fx_files", "fx_cands"], """
SELECT 'chk_sample_size' AS "check", a.query_name AS key,
       CASE WHEN a.avail <= 20 THEN 'only ' || CAST(a.avail AS VARCHAR) || ' available'
            ELSE 'drawn ' || CAST(coalesce(s.drawn, 0) AS VARCHAR) END AS detail
FROM (SELECT query_name, count(*) AS avail FROM smp_fr GROUP BY 1) a
LEFT JOIN (SELECT query_name, count(*) AS drawn FROM smp GROUP BY 1) s ON a.query_name = s.query_name
WHERE a.avail <= 20 OR coalesce(s.drawn, 0) <> 20
UNION ALL
SELECT 'chk_sample_size', query, 'logged ' || CAST(count(*) AS VARCHAR) FROM fx_cands
GROUP BY query HAVING count(*) <> 20""", sql_sample("fx_files")))
def q_chk_sample_size(spark, d):
    """The sample's size per query, and the rows per query of the response logs."""
    f = fx.fx_files(spark, d)
    avail = filter_file_budget(file_rollup(f, max_tokens=3000)).where(F.col("em").isin(0, 1))
    return J.chk_sample_size(sample_files(f), avail, 20).unionByName(J.chk_log_size(fx.fx_cands(spark, d), 20))


@reg("chk_pass_count", with_fx(["fx_cands"], f"""
SELECT 'chk_pass_count' AS "check", CAST(i AS VARCHAR) AS key, CAST(c AS VARCHAR) AS detail
FROM (SELECT i, CAST(sum(CASE WHEN {sql_strip('cand')} <> '' AND {sql_match('ans_spans', 'cand')}
                              THEN 1 ELSE 0 END) AS INTEGER) AS c FROM cl GROUP BY i)
WHERE c > 5""", SQL_CANDS_LONG))
def q_chk_pass_count(spark, d):
    """More than 5 of the 10 candidates match (10 itself cannot be passed)."""
    return J.chk_pass_count(match_count(fx.fx_cands(spark, d)), 5)


@reg("chk_positive", with_fx(["fx_rows"], """
SELECT 'chk_positive' AS "check", CAST(row_id AS VARCHAR) AS key, CAST(example_type AS VARCHAR) AS detail
FROM fx_rows WHERE split = 'test' AND example_type <> 1"""))
def q_chk_positive(spark, d):
    return J.chk_positive(rows_test(spark, d))


@reg("chk_group_counts", with_fx(["fx_blocks"], """
SELECT 'chk_group_counts' AS "check", b.query_name || '|' || b.code_file_path AS key,
       CAST(b.n AS VARCHAR) || '/' || CAST(coalesce(p.n, 0) AS VARCHAR) || '/' || CAST(b.n AS VARCHAR) AS detail
FROM (SELECT query_name, code_file_path, count(*) AS n FROM fx_blocks GROUP BY 1, 2) b
LEFT JOIN (SELECT query_name, code_file_path, count(*) AS n FROM fx_blocks
           WHERE conv_id IN (SELECT doc_id FROM labels) GROUP BY 1, 2) p
  ON b.query_name = p.query_name AND b.code_file_path = p.code_file_path
WHERE b.n <> coalesce(p.n, 0)"""))
def q_chk_group_counts(spark, d):
    """Predictions exist for the conversations whose number has a label: files without
    predictions are reported."""
    b = fx.fx_blocks(spark, d)
    labelled = fx.table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"))
    preds = b.join(labelled, "conv_id", "left_semi").select("query_name", "code_file_path", "block_ordinal")
    return J.chk_group_counts(b, preds)


# several rules over one table in one scan ------------------------------------------------
@reg("chk_sequences", with_fx(["fx_seq"], f"""
SELECT 'chk_lengths' AS "check", CAST(example_id AS VARCHAR) AS key, CAST(len(tokens) AS VARCHAR) || ',' || CAST(w AS VARCHAR) AS detail
FROM (SELECT *, len(list_filter(tokens, lambda t: length(t) > 0)) AS w FROM fx_seq) WHERE len(tokens) <> w
UNION ALL SELECT 'chk_padded', CAST(example_id AS VARCHAR), CAST(len(labels) AS VARCHAR) FROM fx_seq WHERE len(labels) <> 1024
UNION ALL SELECT 'chk_has_sep', CAST(example_id AS VARCHAR),
  CASE WHEN list_position(tokens, '[SEP]_') IS NULL THEN 'no separator' ELSE 'separator label not on separator token' END
FROM fx_seq WHERE list_position(tokens, '[SEP]_') IS NULL OR coalesce(tokens[{_FIRST_SEP_OUT}] <> '[SEP]_', true)
UNION ALL SELECT 'chk_prefix', CAST(example_id AS VARCHAR), 'prefix not all pad' FROM (SELECT *, {_FIRST_SEP_OUT} AS p FROM fx_seq)
WHERE p IS NULL OR len(list_filter(list_slice(output, 1, p), lambda x: x <> 4)) > 0 OR p > plen"""))
def q_chk_sequences(spark, d):
    """J1 to J4 over the sequences: the words that are not empty, the unpadded length, and the
    outputs' separators and prefixes, all in one scan."""
    s = (fx.fx_seq(spark, d).withColumn("words", F.filter("tokens", lambda t: F.length(t) > 0))
         .withColumn("segments", F.transform("tokens", lambda t, i: (i >= F.col("plen")).cast("int"))))
    key = ["example_id"]
    return J.evaluate(s, [J.lengths_rule(key, ["tokens", "words"]), J.padded_rule(key, ["labels"], 1024),
                          J.sep_rule(key, "tokens", "output"), J.prefix_rule(key, "output", "segments")])


@reg("chk_examples", with_fx(["fx_rows"], """
SELECT 'chk_class_per_file' AS "check", query_name || '|' || code_file_path AS key,
       CASE WHEN lo <> hi THEN 'mixed example types' WHEN max_spans > 0 AND lo <> 1 THEN 'spans on a negative file'
            ELSE 'positive file without spans' END AS detail
FROM (SELECT query_name, code_file_path, min(em) AS lo, max(em) AS hi, max(len(answer_texts)) AS max_spans FROM fx_rows GROUP BY 1, 2)
WHERE lo <> hi OR (max_spans > 0 AND lo <> 1) OR (max_spans = 0 AND lo = 1)
UNION ALL SELECT 'chk_positive', CAST(row_id AS VARCHAR), CAST(em AS VARCHAR) FROM fx_rows WHERE em <> 1"""))
def q_chk_examples(spark, d):
    """J6 and J11 with the match flag for the class, in one scan."""
    return J.check_examples(fx.fx_rows(spark, d).withColumn("example_type", F.col("em")))
