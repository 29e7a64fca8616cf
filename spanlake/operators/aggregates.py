"""Aggregations (D1-D12, D15).  Partial + final aggregation comes from Spark; the
only collected lists are per file or per example (bounded by one file / sequence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.matching import N_CANDIDATES, PASS_KS, pass_at_k_scalar, span_match, with_legacy_flags
from spanlake.functions.spans import extract_spans_twostep, same_spans
from spanlake.functions.text import NO_ANSWER, SPAN_JOIN, strip_text
from spanlake.operators.windows import bucket_of, global_row_number

SAMPLE_SIZE = 20


def count_by_query(df: DataFrame) -> DataFrame:
    """Rows per query plus the grand total (``is_total`` = 1)."""
    return (df.rollup("query_name")
            .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("is_total")))


def file_rollup(rows: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """Per (query, file): em = 1 iff every row has em 1; class, tokens, first row.

    With ``max_tokens`` the row-level budget filter (B3, ``file_tokens < max_tokens``)
    is applied inside the aggregation: rows over budget are skipped by conditional
    aggregates and files with no row left are dropped.  Same result as filtering
    first, but the optimizer cannot push a filter below the projection that computes
    ``file_tokens`` - which would evaluate the token count twice per row."""
    keep = F.lit(True) if max_tokens is None else (F.col("file_tokens") < max_tokens)

    def on(c):
        return F.when(keep, F.col(c))
    out = rows.groupBy("query_name", "code_file_path").agg(
        F.min(on("em")).cast("int").alias("em"),
        F.max(on("example_type")).cast("int").alias("example_type"),
        F.min(on("example_type")).cast("int").alias("min_example_type"),
        F.max(on("file_tokens")).cast("int").alias("file_tokens"),
        F.min(on("row_id")).alias("first_row_id"),
        F.count_if(keep).alias("n_rows"))
    return out if max_tokens is None else out.where(F.col("n_rows") > 0)


def with_bucket(files: DataFrame) -> DataFrame:
    """D4 (membership): bucket 0..3 = suc_pos, unsuc_pos, suc_neg, unsuc_neg."""
    return files.where(F.col("em").isin(0, 1)).withColumn("bucket", bucket_of())


def bucket_counts(files: DataFrame) -> DataFrame:
    """D3: 2x2 counts per query and in total, with the success share (null when empty)."""
    b = with_bucket(files)
    agg = b.rollup("query_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("bucket") == 0).alias("suc_pos"),
        F.count_if(F.col("bucket") == 2).alias("suc_neg"),
        F.count_if(F.col("bucket") == 1).alias("unsuc_pos"),
        F.count_if(F.col("bucket") == 3).alias("unsuc_neg"),
        F.grouping_id().cast("int").alias("is_total"))
    share = (F.col("suc_pos") + F.col("suc_neg")) / F.col("total")
    return agg.withColumn("success_share", F.round(F.when(F.col("total") > 0, share), 9))


def sample_summary(sample: DataFrame, size: int = SAMPLE_SIZE) -> DataFrame:
    """Per query and overall: sampled count, per-bucket counts, success share, under-filled."""
    agg = sample.rollup("query_name").agg(
        F.count(F.lit(1)).alias("sampled"),
        *[F.count_if(F.col("bucket") == k).alias(f"b{k}") for k in range(4)],
        F.grouping_id().cast("int").alias("is_total"))
    share = (F.col("b0") + F.col("b2")) / F.col("sampled")
    return (agg.withColumn("success_share", F.round(F.when(F.col("sampled") > 0, share), 9))
            .withColumn("under_filled", (F.col("is_total") == 0) & (F.col("sampled") < size)))


def sample_distinct_check(sample: DataFrame, size: int = SAMPLE_SIZE) -> DataFrame:
    """Distinct files per bucket summed, and distinct over all buckets, per query."""
    per_bucket = (sample.groupBy("query_name", "bucket")
                  .agg(F.countDistinct("code_file_path").alias("d")))
    summed = per_bucket.groupBy("query_name").agg(F.sum("d").cast("long").alias("distinct_by_bucket"))
    overall = sample.groupBy("query_name").agg(
        F.countDistinct("code_file_path").alias("distinct_all"))
    return (summed.join(overall, "query_name")
            .withColumn("ok", (F.col("distinct_by_bucket") == size) & (F.col("distinct_all") == size)))


def file_answer_agg(rows: DataFrame, row_separator: str = "", sep: str = SPAN_JOIN) -> DataFrame:
    """Per (query, file) the answer and fact texts: spans of a row joined with the span
    separator, rows appended in row order with ``row_separator`` (none, as the benchmark
    does); no answers at all gives 'N/A'.  A file is one cell: ``limits.split_oversized`` takes
    out files that no task should hold."""
    per_row = rows.select("query_name", "code_file_path", "row_id", "example_type",
                          F.array_join(F.col("answer_spans.span"), sep).alias("a"),
                          F.array_join(F.col("supporting_fact_spans.span"), sep).alias("f"))
    g = per_row.groupBy("query_name", "code_file_path").agg(
        F.array_sort(F.collect_list(F.struct("row_id", "a", "f"))).alias("r"),
        F.min("example_type").alias("min_type"), F.max("example_type").alias("max_type"))
    ans = F.array_join(F.transform("r", lambda x: x["a"]), row_separator)
    return g.select("query_name", "code_file_path",
                    F.when(ans == "", F.lit(NO_ANSWER)).otherwise(ans).alias("answer_spans"),
                    F.array_join(F.transform("r", lambda x: x["f"]), row_separator)
                    .alias("supporting_fact_spans"),
                    F.col("min_type").cast("int").alias("example_type"),
                    (F.col("min_type") != F.col("max_type")).alias("class_conflict"))


def exact_match_rate(df: DataFrame, target: str = "target", output: str = "output",
                     by: list[str] | None = None) -> DataFrame:
    """Share of sequences whose span sets (complete target vs output) are equal."""
    hit = same_spans(target, output).cast("int")
    return _rate(df, hit, by)


def twostep_exact_match_rate(df: DataFrame, target: str = "target", output: str = "predicted",
                             by: list[str] | None = None) -> DataFrame:
    """The same over provenance-labelled sequences."""
    hit = (extract_spans_twostep(target) == extract_spans_twostep(output)).cast("int")
    return _rate(df, hit, by)


def _rate(df: DataFrame, hit: F.Column, by: list[str] | None) -> DataFrame:
    """n, hits and their share; the (costly) hit expression is referenced once."""
    g = df.groupBy(*by) if by else df.groupBy()
    out = g.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).cast("long").alias("exact"))
    return out.withColumn("exact_match", F.round(F.when(F.col("n") > 0, F.col("exact") / F.col("n")), 9))


def _cands(df: DataFrame, n: int):
    return F.array(*[F.col(f"ans_{j}") for j in range(n)])


def log_metrics(log: DataFrame, ks=PASS_KS, n: int = N_CANDIDATES, legacy_autojunk: bool = False) -> DataFrame:
    """All evaluation sums per query and overall (``is_total``) in one scan and one match:
    total, correct (a candidate matches) and the pass@k sums ``p<k>``."""
    m = match_count(log, n, legacy_autojunk)
    return m.select("query", "c").rollup("query").agg(
        F.count(F.lit(1)).alias("total"), F.sum((F.col("c") > 0).cast("int")).cast("long").alias("correct"),
        *[F.sum(pass_at_k_scalar(n, F.col("c"), k)).alias(f"p{k}") for k in ks],
        F.grouping_id().cast("int").alias("is_total"))


def _stack_ks(sums: DataFrame, ks) -> DataFrame:
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("s")) for k in ks]))
    out = sums.select("total", stack.alias("x"))
    return out.select(F.col("x.k").cast("int").alias("k"), F.col("total").cast("long").alias("total"),
                      F.round(F.coalesce(F.col("x.s"), F.lit(0.0)), 9).alias("pass_sum"),
                      F.round(F.when(F.col("total") > 0, F.col("x.s") / F.col("total")), 9).alias("pass_at_k"))


def metrics_pass_at_k(metrics: DataFrame, ks=PASS_KS) -> DataFrame:
    """D11 from ``log_metrics``."""
    total = metrics.where("is_total = 1").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), *[F.sum(f"p{k}").alias(f"p{k}") for k in ks])
    return _stack_ks(total, ks)


def metrics_any_match(metrics: DataFrame) -> DataFrame:
    """D10 from ``log_metrics``."""
    rate = F.round(F.when(F.col("total") > 0, F.col("correct") / F.col("total")), 9)
    return metrics.select("query", "total", "correct", "is_total", rate.alias("any_match"))


def match_count(df: DataFrame, n: int = N_CANDIDATES, legacy_autojunk: bool = False) -> DataFrame:
    """Per log row: number c of non-blank candidates that match the answer (duplicates count)."""
    if legacy_autojunk:
        staged = with_legacy_flags(df, "ans_spans", [f"ans_{j}" for j in range(n)])
        return staged.withColumn("c", F.size(F.array_remove("_flags", False)).cast("int")).drop("_flags")
    good = F.filter(_cands(df, n), lambda c: (strip_text(c) != "") & span_match(F.col("ans_spans"), c))
    return df.withColumn("c", F.size(good).cast("int"))


def any_match_rate(log: DataFrame, n: int = N_CANDIDATES, legacy_autojunk: bool = False) -> DataFrame:
    """A row is correct if any non-blank candidate matches; per query and total."""
    if legacy_autojunk:
        log = with_legacy_flags(log, "ans_spans", [f"ans_{j}" for j in range(n)])
        hit = F.coalesce(F.array_contains("_flags", True), F.lit(False))
    else:
        hit = F.exists(_cands(log, n), lambda c: (strip_text(c) != "") & span_match(F.col("ans_spans"), c))
    out = log.select("query", hit.cast("int").alias("hit")).rollup("query").agg(
        F.count(F.lit(1)).alias("total"), F.sum("hit").cast("long").alias("correct"),
        F.grouping_id().cast("int").alias("is_total"))
    return out.withColumn("any_match", F.round(F.when(F.col("total") > 0, F.col("correct") / F.col("total")), 9))


def pass_at_k(log: DataFrame, ks=PASS_KS, n: int = N_CANDIDATES, legacy_autojunk: bool = False) -> DataFrame:
    """Mean over rows of the unbiased pass@k, for every k in one scan and one match.

    All k are summed in a single aggregate, then stacked to one row per k."""
    m = match_count(log, n, legacy_autojunk)
    sums = m.agg(F.count(F.lit(1)).alias("total"),
                 *[F.sum(pass_at_k_scalar(n, F.col("c"), k)).alias(f"p{k}") for k in ks])
    return _stack_ks(sums, ks)


def group_blocks(blocks: DataFrame, mode: str = "all") -> DataFrame:
    """Blocks of each (query, file) in input order after the example-type filter."""
    from spanlake.operators.filters import filter_example_type
    b = filter_example_type(blocks, mode)
    return b.groupBy("query_name", "code_file_path").agg(
        F.array_sort(F.collect_list(F.struct("row_id", "block_index"))).alias("blocks"),
        F.count(F.lit(1)).alias("n_blocks"))


def cross_entropy(logits, target) -> F.Column:
    """-log softmax(l)[t] = logsumexp(l) - l[t] (max-shifted)."""
    m = F.array_max(logits)
    lse = m + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    return lse - F.get(logits, target)


def batch_loss(df: DataFrame, batch: int = 4, ordinal: str = "row_id") -> DataFrame:
    """Sum over batches of the mean cross-entropy over all positions of the batch
    (padding positions included), plus the plain mean over all positions.

    A batch is ``batch`` consecutive rows in the order of ``ordinal``, whatever its gaps; the
    last one may be short.  Only (ordinal, loss, positions) of a row is numbered.  Null
    ordinals come last; rows of one ordinal go by positions and loss."""
    per_row = df.select(
        F.col(ordinal).alias("ordinal"), F.size("targets").alias("positions"),
        F.aggregate(F.zip_with("logits", "targets", lambda l, t: cross_entropy(l, t)),
                    F.lit(0.0), lambda a, x: a + x).alias("ce_sum"))
    line = global_row_number(per_row, [F.asc_nulls_last("ordinal"), "positions", "ce_sum"], "place",
                             ["ordinal", "positions", "ce_sum"])
    per_batch = line.groupBy(F.floor(F.col("place") / batch).alias("batch_id")).agg(
        (F.sum("ce_sum") / F.sum("positions")).alias("batch_mean"),
        F.sum("ce_sum").alias("ce_sum"), F.sum("positions").alias("positions"))
    return per_batch.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.round(F.sum("batch_mean"), 9).alias("total_loss"),
        F.round(F.sum("ce_sum") / F.sum("positions"), 9).alias("mean_loss"))
