"""Registered queries for scalar, string and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions import matching as M
from spanlake.functions import sequences as SQ
from spanlake.functions import spans as SP
from spanlake.functions import text as T
from spanlake.operators import joins as C
from spanlake.operators.sequences import compose_twostep, pad_relevance_inputs, span_inputs, split_windows
from spanlake.plans import fixtures as fx
from spanlake.plans import lifecycle as L
from spanlake.plans.oracle_fixtures import TOKEN_RE, with_fx
from spanlake.plans.q_aggregates import SQL_TWOSTEP, _sql_spans2
from spanlake.plans.q_joins import KNOWN_META, known_meta
from spanlake.plans.shared import (
    SQL_CANDS_LONG, ints, rows_test, rows_train, sample_files, sql_ints, sql_match, sql_pass, sql_sample,
    sql_spans, sql_strip,
)
from spanlake.plans.templates import SPAN_PROMPT

QUERIES, SQL = {}, {}


def reg(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


NL = "chr(10)"
SQL_SANITIZE = f"(array_to_string(list_filter(string_split(text, {NL}), lambda l: l <> ''), {NL}) || {NL})"


@reg("sanitize_blocks", with_fx(["fx_rows"], f"SELECT row_id, {SQL_SANITIZE} AS sanitized FROM fx_rows"))
def q_sanitize_blocks(spark, d):
    r = fx.fx_rows(spark, d)
    return r.select("row_id", T.sanitize_blocks(F.col("context_blocks.content")).alias("sanitized"))


@reg("flatten_path", with_fx(["fx_files"], "SELECT row_id, replace(code_file_path, '/', '_') AS file_name FROM fx_files"))
def q_flatten_path(spark, d):
    return fx.fx_files(spark, d).select("row_id", T.flatten_path("code_file_path").alias("file_name"))


@reg("join_spans", with_fx(["fx_rows"], """
SELECT row_id, array_to_string(answer_texts, ':::-:::') AS answers, array_to_string(fact_texts, ':::-:::') AS facts
FROM fx_rows"""))
def q_join_spans(spark, d):
    r = fx.fx_rows(spark, d)
    return r.select("row_id", T.join_spans(F.col("answer_spans.span")).alias("answers"),
                    T.join_spans(F.col("supporting_fact_spans.span")).alias("facts"))


PICKS = """picks AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_name, example_type
                                              ORDER BY md5(CAST(row_id AS VARCHAR) || '|42'), row_id) AS rk
                 FROM fx_rows WHERE split = 'train' AND file_tokens < 1000) WHERE rk = 1)"""
SHOTS = f"""shots AS (
  SELECT query_name,
         max(CASE WHEN example_type = 1 THEN {SQL_SANITIZE} END) AS positive_context,
         max(CASE WHEN example_type = 1 THEN answer_texts END) AS positive_spans,
         max(CASE WHEN example_type = 0 THEN {SQL_SANITIZE} END) AS negative_context
  FROM picks GROUP BY query_name)"""


@reg("few_shot_values", with_fx(["fx_rows"], """
SELECT query_name, positive_context, array_to_string(positive_spans, '|') AS positive_spans, negative_context
FROM shots""", PICKS + ",\n" + SHOTS))
def q_few_shot_values(spark, d):
    v = L.few_shot_values(rows_train(spark, d))
    return v.select("query_name", "positive_context", F.array_join("positive_spans", "|").alias("positive_spans"),
                    "negative_context")


@reg("segment_ids", with_fx(["fx_seq"], """
SELECT unnest(['tokens', 'prefix']) AS setting, example_id,
       CASE WHEN list_position(tokens, '[SEP]_') IS NOT NULL THEN
         array_to_string(list_transform(tokens, lambda t, i: CASE WHEN i - 1 >= list_position(tokens, '[SEP]_')
                                                             THEN '1' ELSE '0' END), ',') END AS segments,
       CAST(len(tokens) AS INTEGER) AS mask_ones, list_position(tokens, '[SEP]_') IS NOT NULL AS has_sep
FROM fx_seq"""))
def q_segment_ids(spark, d):
    vocab = fx.fx_vocab(spark, d)
    enc = C.vocab_encode(fx.fx_seq(spark, d).select("example_id", "tokens"), vocab, "example_id", "tokens")
    s = span_inputs(enc, "ids", C.sep_id(vocab)).select(F.lit("tokens").alias("setting"), "example_id", "segments", "mask", "has_sep")
    # the other setting: the sequences hold ids, and rejects come as rows of their own
    ok, bad = L.sequence_inputs(enc.select("example_id", F.col("ids").alias("seq"), F.col("ids").alias("labels")), vocab, "example_id",
                                "seq", "labels", setting="prefix")
    none = F.lit(None).cast("array<int>")
    s = (s.unionByName(ok.select(F.lit("prefix").alias("setting"), "example_id", "segments", "mask", F.lit(True).alias("has_sep")))
         .unionByName(bad.select(F.lit("prefix").alias("setting"), F.col("key").cast("long").alias("example_id"), none.alias("segments"),
                                 none.alias("mask"), F.lit(False).alias("has_sep"))
                      .join(enc.select("example_id", F.transform("ids", lambda x: F.lit(1)).alias("ones")), "example_id")
                      .withColumn("mask", F.col("ones")).drop("ones")))
    return s.select("setting", "example_id", ints("segments").alias("segments"),
                    F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("mask_ones"), "has_sep")


@reg("pad_truncate", with_fx(["fx_seq"], """
SELECT example_id, CAST(len(list_resize(labels, 1024, 4)) AS INTEGER) AS n,
       array_to_string(list_transform(list_resize(labels, 1024, 4), lambda v: CAST(v AS VARCHAR)), ',') AS labels,
       CAST(list_sum(list_resize(list_transform(tokens, lambda t: 1), 1024, 0)) AS BIGINT) AS mask_ones
FROM fx_seq"""))
def q_pad_truncate(spark, d):
    """Labels padded with 4 / cut to 1024 positions (long documents are cut), mask with 0."""
    s = fx.fx_seq(spark, d)
    labels = SQ.pad_truncate("labels", SQ.SPAN_MAX_LEN, SQ.LABEL_PAD)
    mask = SQ.pad_truncate(SQ.input_mask("tokens"), SQ.SPAN_MAX_LEN, 0)
    return s.select("example_id", F.size(labels).alias("n"), ints(labels).alias("labels"),
                    F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_ones"))


VOCAB_ENC_BLOCKS = """enc AS (
  SELECT row_id, list(coalesce(v.id, unk.id) ORDER BY t.pos) AS ids
  FROM (SELECT row_id, unnest(tokens) AS tok, unnest(range(0, len(tokens))) AS pos FROM fx_blocks) t
  LEFT JOIN fx_vocab v ON v.token = '''' || t.tok || ''''
  CROSS JOIN (SELECT id FROM fx_vocab WHERE token = '''[UNK]_''') unk
  GROUP BY row_id)"""


@reg("pad_truncate_relevance", with_fx(["fx_blocks", "fx_vocab"], """
SELECT e.row_id, CAST(len(list_resize(e.ids, 512, 0)) AS INTEGER) AS n,
       CAST(list_sum(list_resize(e.ids, 512, 0)) AS BIGINT) AS ids_sum,
       CAST(list_sum(list_resize(list_transform(e.ids, lambda x, i: CASE WHEN i - 1 >= list_position(e.ids, s.id)
                                                                       THEN 1 ELSE 0 END), 512, 0)) AS BIGINT) AS seg_sum,
       CAST(list_sum(list_resize(list_transform(e.ids, lambda x: 1), 512, 0)) AS BIGINT) AS mask_sum,
       b.relevance_label
FROM enc e JOIN fx_blocks b ON e.row_id = b.row_id
CROSS JOIN (SELECT id FROM fx_vocab WHERE token = '''[SEP]_''') s""", VOCAB_ENC_BLOCKS))
def q_pad_truncate_relevance(spark, d):
    vocab = fx.fx_vocab(spark, d)
    blocks = fx.fx_blocks(spark, d).select("row_id", "subtokenized_input_sequence", "relevance_label")
    enc = C.vocab_encode(blocks, vocab, "row_id", "subtokenized_input_sequence")
    p = pad_relevance_inputs(span_inputs(enc, "ids", C.sep_id(vocab)))

    def total(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("row_id", F.size("ids").alias("n"), total("ids").alias("ids_sum"),
                    total("segments").alias("seg_sum"), total("mask").alias("mask_sum"), "relevance_label")


def _sql_first_sep(L):
    return (f"CAST(coalesce(list_filter(range(1, len({L})), lambda i: {L}[i] = 4 AND {L}[i + 1] <> 4)[1] - 1, -1)"
            f" AS INTEGER)")


@reg("first_sep_index", with_fx(["fx_seq"], f"""
SELECT example_id, {_sql_first_sep('labels')} AS sep_target, {_sql_first_sep('output')} AS sep_output FROM fx_seq"""))
def q_first_sep_index(spark, d):
    s = fx.fx_seq(spark, d)
    # -1: no separator
    return s.select("example_id", F.coalesce(SQ.first_sep_index("labels"), F.lit(-1)).alias("sep_target"),
                    F.coalesce(SQ.first_sep_index("output"), F.lit(-1)).alias("sep_output"))


@reg("extract_spans", with_fx(["fx_seq"], f"""
SELECT example_id, spans_target, spans_output, (
    SELECT coalesce(string_agg(array_to_string(list_slice(blocks, CAST(split_part(z, ':', 1) AS INT) + 1,
               CAST(split_part(z, ':', 1) AS INT) + CAST(split_part(z, ':', 2) AS INT)), ','), ';' ORDER BY k), '')
    FROM (SELECT unnest(string_split(spans_target, ';')) AS z, unnest(range(len(string_split(spans_target, ';')))) AS k)
    WHERE z <> '') AS span_blocks
FROM (SELECT example_id, {sql_spans('labels')} AS spans_target, {sql_spans('output')} AS spans_output,
             list_transform(range(len(labels)), lambda i: i // 100) AS blocks FROM fx_seq)"""))
def q_extract_spans(spark, d):
    """Spans of both label arrays, and the block (of 100 positions) of every position of the target's."""
    s = fx.fx_seq(spark, d).withColumn("blocks", F.transform("labels", lambda x, i: F.floor(i / 100).cast("int")))
    blocks = F.transform(SP.extract_block_spans("labels", "blocks"), lambda x: F.array_join(x["blocks"].cast("array<string>"), ","))
    return s.select("example_id", SP.spans_to_string(SP.extract_spans("labels")).alias("spans_target"),
                    SP.spans_to_string(SP.extract_spans("output")).alias("spans_output"), F.array_join(blocks, ";").alias("span_blocks"))


@reg("extract_spans_twostep", with_fx(["fx_blocks"], f"""
SELECT query_name, code_file_path, {_sql_spans2('predicted')} AS spans_predicted,
       {_sql_spans2('target')} AS spans_target
FROM ts""", SQL_TWOSTEP))
def q_extract_spans_twostep(spark, d):
    c, _ = compose_twostep(fx.fx_blocks(spark, d))
    return c.select("query_name", "code_file_path",
                    SP.twostep_spans_to_string(SP.extract_spans_twostep("predicted")).alias("spans_predicted"),
                    SP.twostep_spans_to_string(SP.extract_spans_twostep("target")).alias("spans_target"))


def _sql_win(L):
    return (f"CASE WHEN len({L}) < 16 THEN {L} ELSE list_concat(list_slice({L}, 1, plen), "
            f"list_slice({L}, plen + 1 + s * (16 - plen), plen + s * (16 - plen) + (16 - plen))) END")


@reg("split_windows", with_fx(["fx_seq"], f"""
SELECT example_id, CAST(s AS INTEGER) AS split_id, {sql_ints(_sql_win('labels'))} AS labels,
       {sql_ints(_sql_win('output'))} AS output
FROM (SELECT *, unnest(range(0, CAST(CASE WHEN len(labels) < 16 THEN 1
                                         ELSE ceil((len(labels) - plen) / (16 - plen)) END AS BIGINT))) AS s
      FROM fx_seq)"""))
def q_split_windows(spark, d):
    w, _ = split_windows(fx.fx_seq(spark, d).select("example_id", "labels", "output"), 16, ["labels", "output"])
    return w.select("example_id", "split_id", ints("labels").alias("labels"), ints("output").alias("output"))


@reg("argmax_labels", with_fx(["fx_logits"], """
SELECT vec_id, array_to_string(list_transform(logits, lambda v: CAST(list_position(v, list_max(v)) - 1 AS VARCHAR)), ',')
         AS labels
FROM fx_logits"""))
def q_argmax_labels(spark, d):
    return fx.fx_logits(spark, d).select("vec_id", ints(SQ.argmax_labels("logits")).alias("labels"))


def _long(spark, d):
    c = fx.fx_cands(spark, d)
    return c.select("i", "query", "ans_spans",
                    F.posexplode(F.array(*[F.col(f"ans_{j}") for j in range(10)])).alias("j", "cand"))


@reg("span_match", with_fx(["fx_cands"], f"""
SELECT i, CAST(j AS INTEGER) AS j, {sql_match('ans_spans', 'cand')} AS match FROM cl""", SQL_CANDS_LONG))
def q_span_match(spark, d):
    return _long(spark, d).select("i", "j", M.span_match("ans_spans", "cand").alias("match"))


@reg("pass_at_k_scalar", with_fx(["fx_cands"], f"""
SELECT i, c, round({sql_pass('c', '1')}, 9) AS p1, round({sql_pass('c', '2')}, 9) AS p2,
       round({sql_pass('c', '5')}, 9) AS p5, round({sql_pass('c', '10')}, 9) AS p10
FROM (SELECT i, CAST(sum(CASE WHEN {sql_strip('cand')} <> '' AND {sql_match('ans_spans', 'cand')}
                              THEN 1 ELSE 0 END) AS INTEGER) AS c FROM cl GROUP BY i)""", SQL_CANDS_LONG))
def q_pass_at_k_scalar(spark, d):
    from spanlake.operators.aggregates import match_count
    m = match_count(fx.fx_cands(spark, d))
    return m.select("i", "c", *[F.round(M.pass_at_k_scalar(10, F.col("c"), k), 9).alias(f"p{k}")
                                for k in (1, 2, 5, 10)])


@reg("strip_text", with_fx(["fx_cands"], f"""
SELECT i, CAST(j AS INTEGER) AS j, {sql_strip('cand')} AS stripped FROM cl""", SQL_CANDS_LONG))
def q_strip_text(spark, d):
    return _long(spark, d).select("i", "j", T.strip_text("cand").alias("stripped"))


# --- prompts (H16-H19) -------------------------------------------------------------
def source_files_rows(spark, d):
    """The 'source file' of each fx_rows path: its turns joined by newlines in turn order."""
    r = fx.fx_rows(spark, d)
    g = r.groupBy("code_file_path").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return g.select("code_file_path", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("content"))


SQL_SOURCE = f"""src AS (
  SELECT code_file_path, string_agg(text, {NL} ORDER BY turn) AS content FROM fx_rows GROUP BY code_file_path)"""
SQL_FILE_INPUT = """fin AS (
  SELECT s.query_name, s.code_file_path, m."desc" AS description, f.content AS input_code,
         a.answer_spans, a.supporting_fact_spans
  FROM smp s
  JOIN fx_meta m ON s.query_name = m.query_name
  JOIN src f ON s.code_file_path = f.code_file_path
  JOIN (SELECT query_name, code_file_path,
               CASE WHEN string_agg(array_to_string(answer_texts, ':::-:::'), '' ORDER BY row_id) = '' THEN 'N/A'
                    ELSE string_agg(array_to_string(answer_texts, ':::-:::'), '' ORDER BY row_id) END AS answer_spans,
               string_agg(array_to_string(fact_texts, ':::-:::'), '' ORDER BY row_id) AS supporting_fact_spans
        FROM fx_rows_test GROUP BY 1, 2) a
    ON s.query_name = a.query_name AND s.code_file_path = a.code_file_path)"""
ROWS_TEST = "fx_rows_test AS (SELECT * FROM fx_rows WHERE split = 'test')"
PROMPT_CTES = ",\n".join([ROWS_TEST, sql_sample("fx_rows_test"), SQL_SOURCE, SQL_FILE_INPUT, PICKS, SHOTS])


def file_inputs(spark, d):
    """File-level prompt inputs for the sampled files: D7 answers, description, file text."""
    rows = rows_test(spark, d)
    sample = sample_files(rows).select("query_name", "code_file_path")
    return L.file_inputs(sample, rows, fx.fx_meta(spark, d), source_files_rows(spark, d)).where("reason IS NULL")


def _sql_prompt() -> str:
    """SPAN_PROMPT as a SQL concat (hand-aligned with the template text)."""
    from spanlake.functions.text import template_parts
    out = []
    for p in template_parts(SPAN_PROMPT):
        if p[0] == "text":
            out.append("'" + p[1].replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        elif p[0] == "var":
            out.append(f"coalesce(CAST({p[1]} AS VARCHAR), '')")
        else:
            out.append(f"coalesce(array_to_string(list_transform({p[2]}, lambda s: chr(10) || s || chr(10)), ''), '')")
    return " || ".join(out)


def prompts(spark, d):
    """H16 over the file-level inputs and the per-query few-shot values."""
    p = L.render(file_inputs(spark, d), rows_train(spark, d))
    return p.select("query_name", "code_file_path", "answer_spans", "prompt", "n_tokens")


@reg("render_prompt", with_fx(["fx_rows", "fx_meta"], f"""
SELECT query_name, fin.code_file_path, {_sql_prompt()} AS prompt
FROM fin LEFT JOIN shots USING (query_name)""", PROMPT_CTES))
def q_render_prompt(spark, d):
    return prompts(spark, d).select("query_name", "code_file_path", "prompt")


@reg("prompt_budget", with_fx(["fx_rows", "fx_meta"], f"""
SELECT query_name, code_file_path, n_tokens, n_tokens > 4000 AS over_budget FROM (
  SELECT query_name, fin.code_file_path,
         CAST(len(regexp_extract_all({_sql_prompt()}, '{TOKEN_RE}')) AS INTEGER) AS n_tokens
  FROM fin LEFT JOIN shots USING (query_name))""", PROMPT_CTES))
def q_prompt_budget(spark, d):
    p = prompts(spark, d)
    return p.select("query_name", "code_file_path", "n_tokens", (F.col("n_tokens") > 4000).alias("over_budget"))


def _sql_row_input(mode: str, code: str, missing: str, files: str = "") -> str:
    return f"""
SELECT '{mode}' AS mode, r.row_id, r.query_name, m."desc" AS description, m.reccomendation AS recommendation,
       {code} AS input_code, array_to_string(answer_texts, ':::-:::') AS answer_spans,
       array_to_string(fact_texts, ':::-:::') AS supporting_fact_spans, {missing} AS missing
FROM fx_rows r LEFT JOIN known_meta m ON r.query_name = m.query_name {files}
WHERE r.split = 'test' AND r.example_type = 1"""


@reg("prompt_input_row", with_fx(["fx_rows", "fx_meta"], _sql_row_input(
    "blocks", SQL_SANITIZE, "CASE WHEN m.query_name IS NULL THEN 'query_meta' END") + " UNION ALL " + _sql_row_input(
    "file", "s.content", "CASE WHEN m.query_name IS NULL THEN 'query_meta' WHEN s.content IS NULL THEN 'source_text' END",
    "LEFT JOIN src s ON r.code_file_path = s.code_file_path AND length(s.content) > 800"), SQL_SOURCE + ",\n" + KNOWN_META))
def q_prompt_input_row(spark, d):
    """The example's blocks, and the entire file, as the code of a row-level prompt; metadata of
    one region and files up to 800 characters are missing, their examples say so."""
    r = rows_test(spark, d).where(F.col("example_type") == 1)
    meta, files = known_meta(spark, d), source_files_rows(spark, d).where(F.length("content") > 800)
    blocks = L.row_inputs(r, meta).select(F.lit("blocks").alias("mode"), "*")
    return blocks.unionByName(L.row_inputs(r, meta, files).select(F.lit("file").alias("mode"), "*"))


@reg("prompt_input_file", with_fx(["fx_rows", "fx_meta"], """
SELECT query_name, code_file_path, description, CAST(length(input_code) AS INTEGER) AS code_chars,
       answer_spans, supporting_fact_spans
FROM fin""", ",\n".join([ROWS_TEST, sql_sample("fx_rows_test"), SQL_SOURCE, SQL_FILE_INPUT])))
def q_prompt_input_file(spark, d):
    f = file_inputs(spark, d)
    return f.select("query_name", "code_file_path", "description", F.length("input_code").alias("code_chars"),
                    "answer_spans", "supporting_fact_spans")


# H20-H22 ---------------------------------------------------------------------------------
@reg("candidates_wide_long", with_fx(["fx_cands"], f"""
SELECT i, {', '.join(f'ans_{j}' for j in range(10))} FROM fx_cands"""))
def q_candidates_wide_long(spark, d):
    """Wide -> long (posexplode) -> wide (pivot on the candidate number)."""
    long = _long(spark, d)
    wide = long.groupBy("i").pivot("j", list(range(10))).agg(F.max("cand"))
    return wide.select("i", *[F.col(str(j)).alias(f"ans_{j}") for j in range(10)])


@reg("regroup_choices", with_fx(["fx_cands"], """
SELECT i, CAST(g AS INTEGER) AS g, flat[g * 5 + 1] AS first, flat[g * 5 + 5] AS last
FROM (SELECT i, [ans_0, ans_1, ans_2, ans_3, ans_4, ans_5, ans_6, ans_7, ans_8, ans_9] AS flat,
             unnest(range(0, 2)) AS g FROM fx_cands)"""))
def q_regroup_choices(spark, d):
    c = fx.fx_cands(spark, d)
    flat = F.array(*[F.col(f"ans_{j}") for j in range(10)])
    g = c.select("i", F.posexplode(SQ.regroup(flat, 5)).alias("g", "grp"))
    return g.select("i", "g", F.get("grp", 0).alias("first"), F.get("grp", 4).alias("last"))


@reg("run_stamp", "SELECT event_id, strftime(ts, '%m-%d-%Y-%H-%M-%S') AS stamp FROM events")
def q_run_stamp(spark, d):
    return fx.table(spark, d, "events").select("event_id", T.run_stamp("ts").alias("stamp"))
