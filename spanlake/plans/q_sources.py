"""Registered queries for sources/sinks (A1-A8) and projections/filters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from spanlake.functions.text import model_alias, token_count
from spanlake.operators import filters as B
from spanlake.plans import fixtures as fx
from spanlake.plans.oracle_fixtures import TOKEN_RE, with_fx
from spanlake.plans.shared import sql_strip
from spanlake.session import scratch_dir
from spanlake.sources import readers as R
from spanlake.sources import writers as W
from spanlake.sources.schemas import EXAMPLES
from spanlake.sources.stages import RuleBroken, read_stage, write_stage

QUERIES, SQL = {}, {}


def reg(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


def as_examples(df):
    """fx_rows in the declared example schema."""
    words = F.split("text", " ")
    return df.select(
        "row_id", "split", "query_name", "code_file_path", "context_blocks", "answer_spans",
        "supporting_fact_spans", "example_type",
        F.concat(F.array(F.col("query_name"), F.lit("[SEP]_")), words).alias("subtokenized_input_sequence"),
        F.concat(F.array(F.lit(4), F.lit(4)), F.transform(words, lambda t: (F.length(t) % 4).cast("int")))
        .alias("label_sequence"))


# A1 ---------------------------------------------------------------------------
@reg("read_examples", with_fx(["fx_rows"], """
SELECT row_id, split, query_name, code_file_path, example_type,
       CAST(len(answer_texts) AS INTEGER) AS n_answers, 1 AS n_blocks
FROM fx_rows WHERE split = 'test'"""))
def read_examples(spark, d):
    path = scratch_dir(spark, "examples")
    W.materialize(as_examples(fx.fx_rows(spark, d)), path, ["split", "query_name"])
    ex = R.read_examples(spark, path, "test", EXAMPLES)
    return ex.select("row_id", "split", "query_name", "code_file_path", "example_type",
                     F.size("answer_spans").alias("n_answers"), F.size("context_blocks").alias("n_blocks"))


# A2 ---------------------------------------------------------------------------
@reg("read_query_meta", with_fx(["fx_meta"], """
SELECT query_name, CASE WHEN query_name LIKE 'q%' THEN upper("desc") ELSE "desc" END AS "desc",
       reccomendation, folder
FROM fx_meta"""))
def read_query_meta(spark, d):
    """Metadata written as JSON arrays in several files, plus a later file that repeats the
    'q' names with new descriptions; read back, the last entry of a name wins."""
    root = scratch_dir(spark, "meta")
    meta = fx.fx_meta(spark, d).select(F.col("query_name").alias("name"), "desc", "reccomendation", "folder")

    def write_arrays(df, path, buckets):
        (df.withColumn("b", F.abs(F.hash("name")) % buckets)
         .groupBy("b").agg(F.to_json(F.collect_list(F.struct("name", "desc", "reccomendation", "folder")))
                           .alias("value"))
         .write.mode("overwrite").partitionBy("b").text(path))
    write_arrays(meta, os.path.join(root, "a_base"), 3)
    over = meta.where(F.col("name").startswith("q")).withColumn("desc", F.upper("desc"))
    write_arrays(over, os.path.join(root, "b_override"), 1)
    return R.read_query_meta(spark, root)


# A3 ---------------------------------------------------------------------------
@reg("read_source_files", """
SELECT page_id, CAST(length(html) + 1 AS INTEGER) AS n_chars, true AS relative FROM pages""")
def read_source_files(spark, d):
    """Pages written one file per page (the text sink ends each file with a newline), read
    back whole and keyed by the relative path ``page_id=<id>/part-...``."""
    root = scratch_dir(spark, "files")
    # Hadoop's local files: each file made, a checksum file too, starts a chmod process
    raw = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    (fx.fx_pages(spark, d).repartition("page_id").select("page_id", "content")
     .write.mode("overwrite").options(**{"mapreduce.fileoutputcommitter.algorithm.version": "2"}, **raw)
     .partitionBy("page_id").text(root))
    files = R.read_source_files(spark, root)
    return files.select(F.regexp_extract("code_file_path", r"^page_id=(\d+)/", 1).cast("long").alias("page_id"),
                        F.length("content").alias("n_chars"),
                        F.col("code_file_path").startswith("page_id=").alias("relative"))


# A4 ---------------------------------------------------------------------------
@reg("read_vocab", """
WITH w AS (
  SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[^ \t\r\n]+'),
                                        lambda x, i: {'w': x, 'pos': i})) AS e
  FROM benchmark),
l AS (SELECT '''' || e.w || '''' AS token, row_number() OVER (ORDER BY item_id, e.pos) - 1 AS line_no FROM w)
SELECT token, CAST(max(line_no) AS INTEGER) AS id FROM l GROUP BY token""")
def read_vocab(spark, d):
    """Vocabulary lines (every blank-separated word occurrence of the benchmark texts, quoted, repeats
    included) written over several files, then read back: id = last line number."""
    path = scratch_dir(spark, "vocab")
    b = fx.table(spark, d, "benchmark")
    lines = b.select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0)))
                     .alias("pos", "w"))
    lines = lines.select("item_id", "pos", F.concat(F.lit("  '"), F.col("w"), F.lit("' ")).alias("token"))
    W.write_vocab(lines, path, ("item_id", "pos"), files=4)
    return R.read_vocab(spark, path)


# A5 / A6 ------------------------------------------------------------------------
_LOG_COLS = ["i", "query", "file_path", "prompt", "ans_spans"] + [f"ans_{j}" for j in range(10)]


@reg("read_response_logs", with_fx(["fx_cands"], f"SELECT CAST(i AS BIGINT) AS i, {', '.join(_LOG_COLS[1:])} FROM fx_cands"))
def read_response_logs(spark, d):
    """Logs written as CRLF CSV (quotes, commas, newlines, blanks) and read back."""
    path = scratch_dir(spark, "logs")
    c = fx.fx_cands(spark, d).withColumn("query_folder", F.col("query"))
    W.write_response_logs(c, path, 10)
    return R.read_response_logs(spark, path, 10).select(*_LOG_COLS)


@reg("write_response_logs", with_fx(["fx_cands"], """
SELECT query AS query_folder, count(*) AS n_rows FROM fx_cands GROUP BY query"""))
def write_response_logs(spark, d):
    """One folder per query: rows found under each folder after writing."""
    path = scratch_dir(spark, "logs")
    c = fx.fx_cands(spark, d).withColumn("query_folder", F.col("query"))
    W.write_response_logs(c, path, 10)
    back = (spark.read.option("multiLine", "true").option("escape", '"').option("lineSep", "\r\n")
            .schema("c0 string").csv(path))
    return back.groupBy("query_folder").agg(F.count(F.lit(1)).alias("n_rows"))


# A7 ---------------------------------------------------------------------------
@reg("write_prompts", with_fx(["fx_files"], """
SELECT query_name AS query_folder, replace(code_file_path, '/', '_') AS file_name,
       CAST(length('File ' || code_file_path || chr(10) || content) AS INTEGER) AS prompt_chars
FROM fx_files"""))
def write_prompts(spark, d):
    path = scratch_dir(spark, "prompts")
    f = fx.fx_files(spark, d).select(
        F.col("query_name").alias("query_folder"), "code_file_path",
        F.concat(F.lit("File "), F.col("code_file_path"), F.lit("\n"), F.col("content")).alias("prompt"))
    W.write_prompts(f, path)
    back = spark.read.parquet(path)
    return back.select("query_folder", "file_name", F.length("prompt").alias("prompt_chars"))


# A8 ---------------------------------------------------------------------------
@reg("materialize", with_fx(["fx_files"], """
SELECT row_id, query_name, code_file_path, em, example_type, file_tokens FROM fx_files"""))
def materialize(spark, d):
    """A stage written twice: the second version is refused by its rule (a file
    has its match flag), so the first one is what is read."""
    path = scratch_dir(spark, "stage")
    files = fx.fx_files(spark, d)
    write_stage(files, path, ["query_name"], {"no path": F.col("code_file_path").isNull()})
    try:
        write_stage(files.withColumn("em", F.lit(None).cast("int")), path, ["query_name"], {"no em": F.col("em").isNull()})
    except RuleBroken:
        pass
    return read_stage(spark, path).select("row_id", "query_name", "code_file_path", "em",
                                        "example_type", "file_tokens")


# B1 / B2 ------------------------------------------------------------------------
@reg("token_count", with_fx([], f"""
SELECT doc_id AS row_id, CAST(len(regexp_extract_all(text, '{TOKEN_RE}')) AS INTEGER) AS file_tokens
FROM documents"""))
def q_token_count(spark, d):
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"),
                                                  token_count("text").alias("file_tokens"))


_MODEL_SQL = """CASE row_id % 4 WHEN 0 THEN 'gpt-4' WHEN 1 THEN 'gpt-35-turbo'
                 WHEN 2 THEN 'gpt-35-tunro' ELSE 'm-' || query_name END"""


@reg("model_alias", with_fx(["fx_files"], f"""
SELECT row_id, {_MODEL_SQL} AS model,
       CASE WHEN {_MODEL_SQL} IN ('gpt-4', 'gpt-35-turbo', 'gpt-35-tunro') THEN 'gpt-3.5-turbo'
            ELSE {_MODEL_SQL} END AS tokenizer
FROM fx_files"""))
def q_model_alias(spark, d):
    f = fx.fx_files(spark, d)
    m = (F.when(F.col("row_id") % 4 == 0, "gpt-4").when(F.col("row_id") % 4 == 1, "gpt-35-turbo")
         .when(F.col("row_id") % 4 == 2, "gpt-35-tunro").otherwise(F.concat(F.lit("m-"), F.col("query_name"))))
    return f.select("row_id", m.alias("model")).withColumn("tokenizer", model_alias("model"))


# B3 / B4 ------------------------------------------------------------------------
@reg("filter_query_budget", with_fx(["fx_files"], """
SELECT row_id, query_name, file_tokens FROM fx_files WHERE file_tokens < 3000"""))
def q_filter_query_budget(spark, d):
    return B.filter_query_budget(fx.fx_files(spark, d)).select("row_id", "query_name", "file_tokens")


@reg("filter_file_budget", with_fx(["fx_files"], """
SELECT row_id, query_name, file_tokens FROM fx_files WHERE file_tokens < 2000"""))
def q_filter_file_budget(spark, d):
    return B.filter_file_budget(fx.fx_files(spark, d)).select("row_id", "query_name", "file_tokens")


# B5-B9 ----------------------------------------------------------------------------
@reg("filter_example_type", with_fx(["fx_rows"], """
SELECT 'positive' AS mode, row_id FROM fx_rows WHERE example_type = 1
UNION ALL SELECT 'negative', row_id FROM fx_rows WHERE example_type = 0
UNION ALL SELECT 'all', row_id FROM fx_rows"""))
def q_filter_example_type(spark, d):
    r = fx.fx_rows(spark, d)
    parts = [B.filter_example_type(r, m).select(F.lit(m).alias("mode"), "row_id")
             for m in ("positive", "negative", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@reg("partition_by_query", with_fx(["fx_files"], """
SELECT query_name, count(*) AS n, CAST(count(DISTINCT code_file_path) AS BIGINT) AS n_files
FROM fx_files GROUP BY query_name"""))
def q_partition_by_query(spark, d):
    """The sub-datasets stored one folder per query, then counted from the folders."""
    path = scratch_dir(spark, "by-query")
    rows = fx.fx_files(spark, d).select("row_id", "query_name", "code_file_path")
    B.partition_by_query(rows).write.partitionBy("query_name").parquet(path)
    p = spark.read.parquet(path)
    return p.groupBy("query_name").agg(F.count(F.lit(1)).alias("n"),
                                       F.countDistinct("code_file_path").alias("n_files"))


@reg("positive_partition", with_fx(["fx_rows"], """
SELECT row_id, query_name, code_file_path FROM fx_rows WHERE example_type = 1"""))
def q_positive_partition(spark, d):
    return B.positive_partition(fx.fx_rows(spark, d)).select("row_id", "query_name", "code_file_path")


@reg("filter_span_count", with_fx(["fx_rows"], """
SELECT row_id, CAST(len(answer_texts) AS INTEGER) AS n_answers FROM fx_rows WHERE len(answer_texts) > 1"""))
def q_filter_span_count(spark, d):
    return B.filter_span_count(fx.fx_rows(spark, d)).select("row_id", F.size("answer_spans").alias("n_answers"))


@reg("filter_known_queries", with_fx(["fx_files", "fx_rows", "fx_meta"], """
SELECT row_id, query_name FROM fx_files WHERE query_name IN (SELECT query_name FROM fx_meta)
UNION ALL
SELECT row_id, 'q' || CAST(conv_id % 40 AS VARCHAR) FROM fx_rows
WHERE 'q' || CAST(conv_id % 40 AS VARCHAR) IN (SELECT query_name FROM fx_meta)"""))
def q_filter_known_queries(spark, d):
    meta = fx.fx_meta(spark, d)
    a = B.filter_known_queries(fx.fx_files(spark, d), meta).select("row_id", "query_name")
    # names by conversation: 40 of them, of which the metadata knows one per nation
    named = fx.fx_rows(spark, d).withColumn(
        "query_name", F.concat(F.lit("q"), (F.col("conv_id") % 40).cast("string")))
    b = B.filter_known_queries(named, meta).select("row_id", "query_name")
    return a.unionByName(b)


# B10 / B11 ------------------------------------------------------------------------
@reg("filter_nonblank", with_fx(["fx_cands"], f"""
SELECT i, j, cand FROM (
  SELECT i, unnest(range(0, 10)) AS j,
         unnest([ans_0, ans_1, ans_2, ans_3, ans_4, ans_5, ans_6, ans_7, ans_8, ans_9]) AS cand
  FROM fx_cands) WHERE {sql_strip('cand')} <> ''"""))
def q_filter_nonblank(spark, d):
    c = fx.fx_cands(spark, d)
    long = c.select("i", F.posexplode(F.array(*[F.col(f"ans_{j}") for j in range(10)])).alias("j", "cand"))
    return B.filter_nonblank(long).select("i", F.col("j").cast("bigint").alias("j"), "cand")


@reg("log_row", with_fx(["fx_cands"], f"""
SELECT row_number() OVER (PARTITION BY query ORDER BY i) - 1 AS i, query, file_path,
       '' AS prompt, ans_spans,
       {', '.join(sql_strip(f'ans_{j}') + f' AS ans_{j}' for j in range(9))}, '' AS ans_9
FROM fx_cands"""))
def q_log_row(spark, d):
    """Responses as structs (the last one a failure with null text) -> log rows; the row
    counter i restarts per query (E3)."""
    from spanlake.operators.windows import row_index
    c = fx.fx_cands(spark, d)
    cands = F.array(*[F.struct(F.col(f"ans_{j}").alias("text"), F.lit("stop").alias("finish_reason"),
                               F.lit(True).alias("success")) for j in range(9)],
                    F.struct(F.lit(None).cast("string").alias("text"), F.lit("Error").alias("finish_reason"),
                             F.lit(False).alias("success")))
    resp = c.select(F.col("query").alias("query_name"), F.col("file_path").alias("code_file_path"),
                    F.col("i").alias("item"), "ans_spans", cands.alias("cands"))
    resp = row_index(resp, "query_name", ("item",))
    return B.log_row(resp, 10)


# B12 --------------------------------------------------------------------------------
@reg("relevance_project", with_fx(["fx_blocks"], """
SELECT query_name, code_file_path, block_ordinal, CAST(relevance_label AS VARCHAR) AS target FROM fx_blocks"""))
def q_relevance_project(spark, d):
    from spanlake.plans.shared import ints
    r = B.relevance_project(fx.fx_blocks(spark, d))
    return r.select("query_name", "code_file_path", "block_ordinal", ints("target").alias("target"))
