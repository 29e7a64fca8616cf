"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import strip_text

# Token budgets of the benchmark splits (strict '<').
TEST_BUDGET = 3000
TRAIN_BUDGET = 1000
SAMPLE_FILE_BUDGET = 2000


def filter_query_budget(df: DataFrame, budget: int = TEST_BUDGET, col: str = "file_tokens") -> DataFrame:
    """Keep rows with fewer than ``budget`` file tokens (one pass for all queries)."""
    return df.where(F.col(col) < budget)


def filter_file_budget(df: DataFrame, budget: int = SAMPLE_FILE_BUDGET, col: str = "file_tokens") -> DataFrame:
    """The tighter per-file limit applied at bucketing."""
    return df.where(F.col(col) < budget)


def filter_example_type(df: DataFrame, mode: str, col: str = "example_type") -> DataFrame:
    """B5: 'positive' -> type 1, 'negative' -> type 0, 'all' -> every row."""
    if mode == "positive":
        return df.where(F.col(col) == 1)
    if mode == "negative":
        return df.where(F.col(col) == 0)
    if mode == "all":
        return df
    raise ValueError(f"unknown example mode {mode!r}")


def partition_by_query(df: DataFrame, col: str = "query_name") -> DataFrame:
    """Cluster rows by query (the per-query 'sub-datasets' of the benchmark).

    A size-driven rebalance for the step that stores them (``materialize`` partitioned by
    the query): AQE merges small queries and splits a query holding a large share of the
    rows over as many tasks as its bytes need (an aggregate by query placed directly on
    it would hold AQE to one task per query: aggregate the stored table instead)."""
    return df.hint("rebalance", col)


def positive_partition(df: DataFrame) -> DataFrame:
    """Positive rows only."""
    return df.where(F.col("example_type") == 1)


def filter_span_count(df: DataFrame, op: str = ">", n: int = 1, col: str = "answer_spans") -> DataFrame:
    """Rows by number of answer spans (default: more than one)."""
    size = F.size(col)
    cond = {">": size > n, "==": size == n, ">=": size >= n, "<": size < n}[op]
    return df.where(cond)


def filter_known_queries(df: DataFrame, meta: DataFrame, col: str = "query_name") -> DataFrame:
    """Only rows of queries named in the metadata (left semi join; the metadata is a
    dimension with one row per query, so Spark broadcasts it by size)."""
    return df.join(meta.select(F.col("query_name").alias(col)).distinct(), col, "left_semi")


def nonblank_candidates(cands) -> "F.Column":
    """B10 (array form): drop candidates that are empty after strip."""
    c = F.col(cands) if isinstance(cands, str) else cands
    return F.filter(c, lambda x: strip_text(x) != "")


def filter_nonblank(long_df: DataFrame, col: str = "cand") -> DataFrame:
    """B10 (long form): drop blank candidate rows."""
    return long_df.where(strip_text(col) != "")


def log_row(df: DataFrame, n: int = 10, answer_col: str = "ans_spans", cands_col: str = "cands",
            first_span_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``[i, query, file, '', answer, ans_0..]`` with stripped candidate texts.

    ``cands`` is ``array<struct<text,finish_reason,success>>``; a failed response
    (null text) is written as ''.  ``first_span_only`` takes the first answer span
    (legacy row-level path) instead of the joined string; ``keep`` names further columns."""
    ans = F.get(F.col(answer_col), 0) if first_span_only else F.col(answer_col)
    cand = lambda j: strip_text(F.get(F.col(cands_col), j)["text"]).alias(f"ans_{j}")
    return df.select(F.col("i").cast("long"), F.col("query_name").alias("query"),
                     F.col("code_file_path").alias("file_path"), F.lit("").alias("prompt"),
                     ans.alias("ans_spans"), *[cand(j) for j in range(n)], *keep)


def relevance_project(df: DataFrame) -> DataFrame:
    """Relevance label as the one-element target of a block."""
    return df.select("query_name", "code_file_path", "block_ordinal",
                     F.array(F.col("relevance_label")).alias("target"))
