"""Registered queries for the batch-inference surface (I1-I4), with deterministic fakes.

Generation (I5, I6) and tokenizer plug-ins (I7) call user code only; they are library code
under tests and have no query of their own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from spanlake.operators import inference as I
from spanlake.operators import joins as C
from spanlake.operators.sequences import pad_relevance_inputs, pad_span_inputs, span_inputs
from spanlake.plans import fakes
from spanlake.plans import fixtures as fx
from spanlake.plans.oracle_fixtures import with_fx
from spanlake.plans.shared import ints, sql_ints, sql_spans

QUERIES, SQL = {}, {}


def reg(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


def _add_lines(b: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"row_id": b["row_id"], "n_lines": b["text"].map(lambda t: t.count("\n") + 1).astype("int32")})


@reg("user_map_filter", with_fx(["fx_rows"], """
SELECT row_id, n_lines FROM (
  SELECT row_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS n_lines FROM fx_rows)
WHERE n_lines > 2"""))
def q_user_map_filter(spark, d):
    r = fx.fx_rows(spark, d).select("row_id", "text")
    m = I.map_rows(r, _add_lines, "row_id long, n_lines int")
    return I.filter_rows(m, lambda b: b["n_lines"] > 2)


def _classes(vocab) -> dict:
    """The model's table: a vocabulary word's class is its length mod 4 (the vocabulary is
    within the bounds of ``vocab_encode``'s map strategy)."""
    word = F.length("token") - 2  # without the quotes
    rows = vocab.where(~F.col("token").isin("'[UNK]_'", "'[SEP]_'")).select("id", (word % 4).alias("c")).collect()
    return {r["id"]: r["c"] for r in rows}


# the table's answer for each of the 1024 positions, from the words and not from ids
SQL_PREDICTED = """
pred AS (
  SELECT example_id, list(CASE WHEN k.word IS NULL THEN 2 ELSE length(t.tok) % 4 END ORDER BY t.pos) AS cls
  FROM (SELECT example_id, unnest(tokens) AS tok, unnest(range(0, len(tokens))) AS pos FROM fx_seq) t
  LEFT JOIN (SELECT token AS word FROM fx_vocab_base) k ON k.word = '''' || t.tok || ''''
  GROUP BY example_id),
model AS (
  SELECT s.*, list_transform(list_resize(p.cls, 1024, 4), lambda c, i: CAST(CASE
           WHEN list_position(tokens, '[SEP]_') IS NULL OR i <= list_position(tokens, '[SEP]_') THEN 4
           ELSE c END AS INTEGER)) AS predicted
  FROM fx_seq s JOIN pred p ON s.example_id = p.example_id)"""


@reg("predict_labels", with_fx(["fx_seq", "fx_vocab"], f"""
SELECT example_id, {sql_ints('predicted')} AS predicted, 1024 AS n_positions FROM model""", SQL_PREDICTED))
def q_predict_labels(spark, d):
    """Predictions over the padded / cut 1024-position inputs (C3 -> H5 -> H6)."""
    vocab = fx.fx_vocab(spark, d)
    seq = fx.fx_seq(spark, d).select("example_id", "tokens", "labels")
    enc = C.vocab_encode(seq, vocab, "example_id", "tokens")
    s = pad_span_inputs(span_inputs(enc, "ids", C.sep_id(vocab)))
    p = I.predict_labels(s.select("example_id", "ids", "segments", "mask"), fakes.table_predictor(_classes(vocab)), batch_size=4)
    return p.select("example_id", ints("predicted").alias("predicted"), F.size("predicted").alias("n_positions"))


@reg("predict_relevance", with_fx(["fx_blocks", "fx_vocab"], """
SELECT row_id, CAST(sum(CASE WHEN pos > 1 AND pos < 512 THEN coalesce(v.id, unk.id) ELSE 0 END) % 2 AS INTEGER) AS predicted
FROM (SELECT row_id, unnest(tokens) AS tok, unnest(range(0, len(tokens))) AS pos FROM fx_blocks) t
LEFT JOIN fx_vocab v ON v.token = '''' || t.tok || ''''
CROSS JOIN (SELECT id FROM fx_vocab WHERE token = '''[UNK]_''') unk
GROUP BY row_id"""))
def q_predict_relevance(spark, d):
    vocab = fx.fx_vocab(spark, d)
    blocks = fx.fx_blocks(spark, d).select("row_id", "subtokenized_input_sequence")
    enc = C.vocab_encode(blocks, vocab, "row_id", "subtokenized_input_sequence")
    s = pad_relevance_inputs(span_inputs(enc, "ids", C.sep_id(vocab)))
    return I.predict_relevance(s.select("row_id", "ids", "segments", "mask"), fakes.parity_relevance, batch_size=16).select("row_id", "predicted")


@reg("example_em", with_fx(["fx_seq", "fx_vocab"], f"""
SELECT example_id,
       CASE WHEN list_position(tokens, '[SEP]_') IS NULL THEN -1
            ELSE CAST({sql_spans('labels')} = {sql_spans('predicted')} AS INTEGER) END AS em
FROM model""", SQL_PREDICTED))
def q_example_em(spark, d):
    """em of every example at once: encode, inputs, pad, predict, spans, compare with the
    complete (untruncated) target."""
    from spanlake.plans.lifecycle import example_em
    vocab = fx.fx_vocab(spark, d)
    seq = fx.fx_seq(spark, d).select("example_id", "tokens", "labels")
    out = example_em(seq, vocab, fakes.table_predictor(_classes(vocab)), key="example_id", tokens="tokens",
                     labels="labels")
    # -1: no separator (the benchmark rejects such an example)
    return out.select("example_id", F.coalesce(F.col("em"), F.lit(-1)).alias("em"))
