"""Explicit schemas for the benchmark tables (nothing is inferred at read time)."""

from __future__ import annotations

from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("span", T.StringType())])
BLOCK = T.StructType([T.StructField("content", T.StringType()),
                      T.StructField("index", T.IntegerType())])

EXAMPLES = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("split", T.StringType()),
    T.StructField("query_name", T.StringType()),
    T.StructField("code_file_path", T.StringType()),
    T.StructField("context_blocks", T.ArrayType(BLOCK)),
    T.StructField("answer_spans", T.ArrayType(SPAN)),
    T.StructField("supporting_fact_spans", T.ArrayType(SPAN)),
    T.StructField("example_type", T.IntegerType()),
    T.StructField("subtokenized_input_sequence", T.ArrayType(T.StringType())),
    T.StructField("label_sequence", T.ArrayType(T.IntegerType())),
])

QUERY_META = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("desc", T.StringType()),
    T.StructField("reccomendation", T.StringType()),
    T.StructField("folder", T.StringType()),
])

RESPONSE_LOG_FIXED = ["i", "query", "file_path", "prompt", "ans_spans"]


def response_log_schema(n: int) -> T.StructType:
    """``i, query, file_path, prompt, ans_spans, ans_0 .. ans_{n-1}`` (headerless CSV)."""
    fields = [T.StructField("i", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in RESPONSE_LOG_FIXED[1:]]
    fields += [T.StructField(f"ans_{j}", T.StringType()) for j in range(n)]
    return T.StructType(fields)
