"""Sorting, sampling and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators.aggregates import SAMPLE_SIZE, with_bucket
from spanlake.operators.windows import rank_in_bucket

SEED = 42  # fixed seed of the benchmark's draws


def stratified_sample(files: DataFrame, size: int = SAMPLE_SIZE) -> DataFrame:
    """cyclic draw over the four buckets, one file per turn, skipping empty buckets,
    until min(size, available).  That order is exactly (rank_in_bucket, bucket), so the
    draw is a per-query top-``size``.  Only files ranked <= size in their bucket can be
    drawn, so each bucket is cut to ``size`` first (partial WindowGroupLimit before the
    shuffle): no task ever holds a whole query."""
    ranked = rank_in_bucket(with_bucket(files), top=size)
    w = Window.partitionBy("query_name").orderBy("rank_in_bucket", "bucket")
    return (ranked.withColumn("draw_order", F.row_number().over(w))
            .where(F.col("draw_order") <= size))


def hash_order(key, seed: int = SEED):
    """Deterministic uniform order: md5 of 'key|seed' (same in any SQL engine)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", k.cast("string"), F.lit(str(seed))))


def seeded_sample_n(df: DataFrame, n: int = 10, key: str = "row_id",
                    partition=("query_name",), seed: int = SEED) -> DataFrame:
    """min(n, available) rows per query in seeded hash order (top-n per group)."""
    w = Window.partitionBy(*partition).orderBy(hash_order(key, seed), F.col(key))
    return df.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def few_shot_pick(train: DataFrame, key: str = "row_id", seed: int = SEED) -> DataFrame:
    """one seeded positive and one seeded negative per query; the negative must carry no
    answer or fact spans (rows violating that are reported by chk_negative_empty)."""
    pos = train.where(F.col("example_type") == 1)
    neg = train.where((F.col("example_type") == 0))
    both = pos.unionByName(neg)
    return seeded_sample_n(both, 1, key, ("query_name", "example_type"), seed)


def first_seen_order(df: DataFrame, group=("query_name", "code_file_path"), ordinal: str = "row_id") -> DataFrame:
    """groups in first-seen (dictionary insertion) order: min ordinal as the sort key."""
    return df.groupBy(*group).agg(F.min(ordinal).alias("first_row_id"))


def bucket_major_order(sample: DataFrame) -> DataFrame:
    """the sample consumed bucket 0 -> 3, each bucket in rank order, numbered per query."""
    w = Window.partitionBy("query_name").orderBy("bucket", "rank_in_bucket")
    return sample.withColumn("consume_order", F.row_number().over(w))


def sample_with_topup(rows: DataFrame, n: int = 10, key: str = "row_id", seed: int = SEED) -> DataFrame:
    """E2, F2 and G1 in one pass: of the files with a single row, ``n`` rows per query in seeded
    order; a query that has fewer gives its rows with more than one answer span twice.

    A query short of ``n`` rows has all of them in its first ``n``, so one ranked cut per query
    (a partial limit before the shuffle) holds everything, and a count over the cut tells the
    short ones.  Two shuffles: by file, with partial aggregation, and by query."""
    single = (rows.groupBy("query_name", "code_file_path")
              .agg(F.count(F.lit(1)).alias("n_rows"), F.any_value(F.struct(*rows.columns)).alias("row"))
              .where("n_rows = 1").select("row.*"))
    by_query = Window.partitionBy("query_name")
    drawn = (single.withColumn("_rank", F.row_number().over(by_query.orderBy(hash_order(key, seed), F.col(key)))).where(F.col("_rank") <= n)
             .withColumn("_n", F.count(F.lit(1)).over(by_query)))
    times = F.when((F.col("_n") < n) & (F.size("answer_spans") > 1), 2).otherwise(1)
    return drawn.withColumn("_turn", F.explode(F.sequence(F.lit(1), times))).drop("_rank", "_n", "_turn")


def union_topup(sampled: DataFrame, pool: DataFrame, n: int = 10) -> DataFrame:
    """G1: when a query drew fewer than ``n`` rows, append every pool row with more than one
    answer span (bag union; may repeat rows)."""
    if sampled.schema != pool.schema:
        raise ValueError("union_topup: schemas differ")
    counts = sampled.groupBy("query_name").agg(F.count(F.lit(1)).alias("_n"))
    short = pool.select("query_name").distinct().join(counts, "query_name", "left") \
        .where(F.coalesce(F.col("_n"), F.lit(0)) < n).select("query_name")
    extra = pool.where(F.size("answer_spans") > 1).join(short, "query_name", "left_semi")
    return sampled.unionByName(extra)


def distinct_files(df: DataFrame, cols=("query_name", "code_file_path")) -> DataFrame:
    """The set of paths."""
    return df.select(*cols).dropDuplicates(list(cols))
