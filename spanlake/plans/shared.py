"""Shared query fragments: the sampling chain and file-level inputs, Spark and SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators.aggregates import file_rollup
from spanlake.operators.filters import TEST_BUDGET, filter_file_budget
from spanlake.operators.sampling import stratified_sample
from spanlake.plans import fixtures as fx


def ints(col) -> F.Column:
    """array<int> as a comma-joined string (for reports / value hashing)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(c.cast("array<string>"), ",")


def sample_files(files: DataFrame) -> DataFrame:
    """Test-side sample: B3 (inside the rollup) -> D2 -> B4 -> buckets -> F1."""
    return stratified_sample(filter_file_budget(file_rollup(files, max_tokens=TEST_BUDGET)))


def rows_test(spark: SparkSession, d: str) -> DataFrame:
    return fx.fx_rows(spark, d).where(F.col("split") == "test")


def rows_train(spark: SparkSession, d: str) -> DataFrame:
    """The train partition: train split under the train token budget (B3, < 1000)."""
    from spanlake.operators.filters import TRAIN_BUDGET, filter_query_budget
    return filter_query_budget(fx.fx_rows(spark, d).where(F.col("split") == "train"), TRAIN_BUDGET)


# SQL twins -----------------------------------------------------------------

def sql_sample(src: str, name: str = "smp") -> str:
    """CTEs ``{name}_fm`` (file rollup), ``{name}_fr`` (ranked) and ``{name}`` (drawn)."""
    return f"""{name}_fm AS (
  SELECT query_name, code_file_path, CAST(min(em) AS INTEGER) AS em,
         CAST(max(example_type) AS INTEGER) AS example_type,
         CAST(max(file_tokens) AS INTEGER) AS file_tokens, min(row_id) AS first_row_id
  FROM {src} WHERE file_tokens < 3000 GROUP BY query_name, code_file_path
  HAVING max(file_tokens) < 2000),
{name}_fr AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_name, bucket
                                    ORDER BY first_row_id, code_file_path) AS INTEGER) AS rank_in_bucket
  FROM (SELECT *, CAST(CASE WHEN example_type = 1 THEN 0 ELSE 2 END + (1 - em) AS INTEGER) AS bucket
        FROM {name}_fm WHERE em IN (0, 1))),
{name} AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_name
                                                   ORDER BY rank_in_bucket, bucket) AS INTEGER) AS draw_order
                 FROM {name}_fr) WHERE draw_order <= 20)"""


def sql_strip(x: str) -> str:
    return f"coalesce(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"


def sql_ints(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: CAST(v AS VARCHAR)), ',')"


def sql_spans(L: str) -> str:
    """Span string ``start:len:tag;...`` of an int list expression (start order)."""
    runs = f"regexp_extract_all(array_to_string({L}, ''), '[03]1*')"
    starts = f"list_filter(range(0, len({L})), lambda i: {L}[i + 1] IN (0, 3))"
    # list_zip evaluates both lists once (a lambda body would recompute them per span)
    return (f"array_to_string(list_transform(list_zip({starts}, {runs}), lambda z: CAST(z[1] AS VARCHAR) || ':' || "
            f"CAST(length(z[2]) AS VARCHAR) || ':' || CAST({L}[z[1] + 1] AS VARCHAR)), ';')")


def sql_fuzzy(a: str, c: str) -> str:
    big = f"greatest(length({a}), length({c}))"
    L = f"((9 * {big}) // 10 + 1)"
    small = f"least(length({a}), length({c}))"
    return (f"(length({a}) > 0 AND {small} * 10 > 9 * {big} AND {small} >= {L} AND "
            f"len(list_filter(range(1, length({a}) - {L} + 2), "
            f"lambda i: contains({c}, substr({a}, i, {L})))) > 0)")


def sql_match(a: str, c: str) -> str:
    return f"({sql_strip(a)} = {sql_strip(c)} OR (coalesce({a}, '') <> '' AND {sql_fuzzy(a, c)}))"


def sql_pass(c: str, k: str, n: int = 10) -> str:
    return (f"CASE WHEN {n} - {c} < {k} THEN 1.0 WHEN {c} <= 0 THEN 0.0 ELSE 1.0 - list_reduce("
            f"list_transform(range({n} - {c} + 1, {n} + 1), lambda i: 1.0 - {k} / i), "
            f"lambda x, y: x * y) END")


SQL_CANDS_LONG = """cl AS (
  SELECT i, query, file_path, ans_spans, unnest(range(0, 10)) AS j,
         unnest([ans_0, ans_1, ans_2, ans_3, ans_4, ans_5, ans_6, ans_7, ans_8, ans_9]) AS cand
  FROM fx_cands)"""
