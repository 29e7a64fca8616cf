"""The benchmark's three entry points as composed Spark plans.

* ``build_samples`` - per-query balanced sample of files (token budget, per-file
  success / class rollup, 2x2 buckets, cyclic draw), with the summary report.
* ``generate_logs`` - file-level prompts for the sample (answers, description, file
  text, few-shot examples), budget check, candidate generation through a user client,
  and the response logs (one folder per query).
* ``evaluate_logs`` - pass@k and any-match over the logs, which are read and matched once.

Each step is a DataFrame transformation; only the client call leaves the JVM."""

from __future__ import annotations

from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.text import join_spans, render_prompt, sanitize_blocks, token_count
from spanlake.operators import aggregates as D
from spanlake.operators import joins as C
from spanlake.operators.filters import (
    SAMPLE_FILE_BUDGET, TEST_BUDGET, TRAIN_BUDGET, filter_file_budget, filter_query_budget, log_row,
)
from spanlake.operators.inference import RESPONSE, generate_candidates
from spanlake.operators.sampling import bucket_major_order, few_shot_pick, stratified_sample
from spanlake.operators.windows import row_index
from spanlake.plans.templates import SPAN_PROMPT
from spanlake.session import scratch_dir
from spanlake.sources.readers import read_response_logs
from spanlake.sources.writers import write_response_logs


def file_tokens(source_files: DataFrame) -> DataFrame:
    """Token count once per source file (not per example row)."""
    return source_files.select("code_file_path", token_count("content").alias("file_tokens"))


def sequence_inputs(examples: DataFrame, vocab: DataFrame, key: str = "row_id", tokens: str = "subtokenized_input_sequence",
                    labels: str = "label_sequence", mode: str = "all", setting: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """H5 with its setting: (inputs, rejects) of the examples of the type ``mode``.

    In the setting ``tokens`` the sequence holds subtokens and is encoded through the
    vocabulary; in ``prefix`` it already holds ids (integers) and only the separator's id comes
    from the vocabulary.  Rejected with their reason: labels of another length, no separator."""
    from spanlake.operators.filters import filter_example_type
    from spanlake.operators.sequences import span_inputs
    if setting not in ("tokens", "prefix"):
        raise ValueError(setting)
    rows = filter_example_type(examples, mode) if mode != "all" else examples
    if setting == "prefix":
        rows = rows.withColumn("ids", F.col(tokens).cast("array<int>"))
    else:
        rows = C.vocab_encode(rows, vocab, key, tokens)
    s = span_inputs(rows, "ids", C.sep_id(vocab))
    detail = (F.when(~F.equal_null(F.size("ids"), F.size(labels)), "labels of another length").when(~F.col("has_sep"), "no separator"))
    s = s.withColumn("detail", detail)
    rejects = s.where("detail IS NOT NULL").select(F.lit("sequence_inputs").alias("check"), F.col(key).cast("string").alias("key"), "detail")
    return s.where("detail IS NULL").drop("detail", "has_sep"), rejects


def example_em(examples: DataFrame, vocab: DataFrame, predictor_factory: Callable, key: str = "row_id",
               tokens: str = "subtokenized_input_sequence", labels: str = "label_sequence",
               extra_inputs: tuple[str, ...] = (), batch_size: int = 4) -> DataFrame:
    """I4 for every example at once: vocabulary ids -> segments / mask -> pad to 1024 ->
    user predictor -> span sets of the complete (untruncated) target vs the prediction.
    Adds ``em`` (0/1); examples without a separator get null."""
    from spanlake.functions.spans import same_spans
    from spanlake.operators.inference import predict_labels
    from spanlake.operators.sequences import pad_span_inputs, span_inputs
    cols = [key, tokens, labels, *extra_inputs]
    enc = C.vocab_encode(examples.select(*cols), vocab, key, tokens)
    s = span_inputs(enc, "ids", C.sep_id(vocab)).withColumn("target", F.col(labels))
    padded = pad_span_inputs(s.withColumnRenamed(labels, "labels"))
    padded = padded.select(*dict.fromkeys([key, "ids", "segments", "mask", *extra_inputs, "target", "has_sep"]))
    p = predict_labels(padded, predictor_factory, inputs=("ids", "segments", "mask", *extra_inputs),
                       batch_size=batch_size)
    em = F.when(F.col("has_sep"), same_spans("target", "predicted").cast("int"))
    return examples.join(p.select(key, em.alias("em")), key, "left")


def build_samples(examples: DataFrame, size: int = 20, budget: int = TEST_BUDGET,
                  file_budget: int = SAMPLE_FILE_BUDGET) -> tuple[DataFrame, DataFrame]:
    """Examples with ``em`` and ``file_tokens`` -> (sample, summary).

    ``em`` is the per-example exact match (e.g. from ``example_em``); ``file_tokens``
    comes from ``file_tokens`` joined on the path."""
    files = filter_file_budget(D.file_rollup(examples, max_tokens=budget), file_budget)
    sample = bucket_major_order(stratified_sample(files, size))
    return sample, D.sample_summary(sample, size)


def few_shot_values(train: DataFrame) -> DataFrame:
    """Seeded positive / negative example per query, as prompt values."""
    p = few_shot_pick(train)
    v = p.select("query_name", "example_type", sanitize_blocks(F.col("context_blocks.content")).alias("ctx"),
                 F.col("answer_spans.span").alias("spans"))
    return v.groupBy("query_name").agg(
        F.max(F.when(F.col("example_type") == 1, F.col("ctx"))).alias("positive_context"),
        F.max(F.when(F.col("example_type") == 1, F.col("spans"))).alias("positive_spans"),
        F.max(F.when(F.col("example_type") == 0, F.col("ctx"))).alias("negative_context"))


def file_inputs(sample: DataFrame, test: DataFrame, meta: DataFrame, source_files: DataFrame) -> DataFrame:
    """One row per sampled file with its answers, description and text.  No file is lost:
    ``reason`` says which lookup failed (null: none)."""
    from spanlake.session import ensure_checkpoint_dir
    # the sample is small (<= size files per query) and feeds several branches:
    # materialize it once instead of re-running its plan in each
    ensure_checkpoint_dir(sample.sparkSession)
    s = sample.checkpoint(eager=True)
    # answers only for the sampled files: semi join with the (small) sample first
    answers = D.file_answer_agg(C.semi_join_files(test, s)).select(
        "query_name", "code_file_path", "answer_spans", "supporting_fact_spans", F.lit(True).alias("_answered"))
    described = meta.select("query_name", F.col("desc").alias("description"),
                            F.col("reccomendation").alias("recommendation"), F.lit(True).alias("_described"))
    texts = source_files.select("code_file_path", F.col("content").alias("input_code"), F.lit(True).alias("_found"))
    j = (s.join(described, "query_name", "left").join(texts, "code_file_path", "left")
         .join(answers, ["query_name", "code_file_path"], "left"))
    reason = (F.when(F.col("_described").isNull(), "no metadata").when(F.col("_found").isNull(), "no source file")
              .when(F.col("_answered").isNull(), "no example rows"))
    return j.withColumn("reason", reason).drop("_described", "_found", "_answered")


def row_inputs(rows: DataFrame, meta: DataFrame, source_files: DataFrame | None = None) -> DataFrame:
    """Prompt inputs of single examples; the code is the example's blocks, or with
    ``source_files`` the entire file.  No example is lost: ``missing`` names the lookup that
    failed (null: none), see ``joins.found`` and ``joins.rejects``."""
    j = C.join_query_meta(rows, meta)
    code = sanitize_blocks(F.col("context_blocks.content"))
    if source_files is not None:
        j, code = C.join_source_text(j, source_files), F.col("content")
    return j.select("row_id", "query_name", F.col("desc").alias("description"),
                    F.col("reccomendation").alias("recommendation"), code.alias("input_code"),
                    join_spans(F.col("answer_spans.span")).alias("answer_spans"),
                    join_spans(F.col("supporting_fact_spans.span")).alias("supporting_fact_spans"), "missing")


def render(inputs: DataFrame, train: DataFrame, template: str = SPAN_PROMPT) -> DataFrame:
    """H16 over ``file_inputs`` and the few-shot values; adds ``prompt`` and ``n_tokens``."""
    j = inputs.join(few_shot_values(train), "query_name", "left")
    vals = {c: F.col(c) for c in ["query_name", "description", "recommendation", "positive_context",
                                  "positive_spans", "negative_context", "input_code"]}
    return j.withColumn("prompt", render_prompt(template, vals)).withColumn("n_tokens", token_count("prompt"))


def build_prompts(sample: DataFrame, test: DataFrame, train: DataFrame, meta: DataFrame,
                  source_files: DataFrame, template: str = SPAN_PROMPT, max_tokens: int = 4000,
                  train_budget: int | None = TRAIN_BUDGET) -> tuple[DataFrame, DataFrame]:
    """(accepted prompts, rejected files with their ``reason``) for the sampled files.  Few-shot
    examples come from the train rows under the train token budget (when they carry
    ``file_tokens``)."""
    if train_budget is not None and "file_tokens" in train.columns:
        train = filter_query_budget(train, train_budget)
    s = sample.select("query_name", "code_file_path", "bucket", "rank_in_bucket", "consume_order")
    p = render(file_inputs(s, test, meta, source_files), train, template)
    p = p.withColumn("reason", F.coalesce("reason", F.when(F.col("n_tokens") > max_tokens, "over budget")))
    keep = ["query_name", "code_file_path", "consume_order", "answer_spans", "prompt", "n_tokens"]
    return p.where("reason IS NULL").select(*keep), p.where("reason IS NOT NULL").select(*keep, "reason")


def generate_logs(prompts: DataFrame, meta: DataFrame, client_factory: Callable, out_path: str,
                  n: int = 10, concurrency: int | None = None, store: str | None = None,
                  on_miss: str = "fail", **client_opts) -> DataFrame:
    """Candidates for every accepted prompt, written as per-query CSV logs; returns the
    log rows.  ``concurrency`` partitions bound the parallel calls to the service.

    Queries without metadata have no folder: they stop the job before any call, or are left
    out with ``on_miss="skip"``.  The answers are
    stored once as Parquet, keyed by ``prompt_hash``, and logs and returned rows are read
    from there, so nothing is asked twice.  ``store`` names that folder: prompts whose hash
    an earlier call stored there are not asked again."""
    spark = prompts.sparkSession
    placed = C.join_folder_map(prompts, meta)
    if on_miss == "fail" and (lost := [r["key"] for r in C.rejects(placed, ["query_name"]).distinct().take(5)]):
        raise ValueError(f"queries without metadata: {lost}")
    asked = C.found(placed).withColumnRenamed("folder", "query_folder").withColumn("prompt_hash", F.sha2("prompt", 256))
    path = store or scratch_dir(spark, "generated")
    answers = T.StructType([T.StructField("prompt_hash", T.StringType()), T.StructField("cands", T.ArrayType(RESPONSE))])
    todo = asked.select("prompt", "prompt_hash").dropDuplicates(["prompt_hash"])
    if store and _has_rows(spark, store, answers):
        todo = todo.join(spark.read.schema(answers).parquet(store).select("prompt_hash"), "prompt_hash", "left_anti")
    todo = todo.select("prompt")
    todo = todo.repartition(concurrency) if concurrency else todo
    generate_candidates(todo, client_factory, n=n, **client_opts).select("prompt_hash", "cands").write.mode("append").parquet(path)
    g = asked.join(spark.read.schema(answers).parquet(path), "prompt_hash").drop("prompt_hash")
    g = row_index(g, "query_name", ("consume_order", "code_file_path"))
    rows = log_row(g.withColumnRenamed("answer_spans", "ans_spans"), n, keep=("query_folder",))
    write_response_logs(rows, out_path, n)
    return rows


def _has_rows(spark: SparkSession, path: str, schema: T.StructType) -> bool:
    try:
        return not spark.read.schema(schema).parquet(path).isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def evaluate_logs(spark: SparkSession, path: str, n: int = 10, legacy_autojunk: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pass@k for k = 1, 2, 5, 10; any-match per query and overall) from the logs: both from
    one stored table of sums per query, so the logs are read and matched once."""
    sums = D.log_metrics(read_response_logs(spark, path, n), n=n, legacy_autojunk=legacy_autojunk)
    store = scratch_dir(spark, "metrics")
    sums.write.parquet(store)
    sums = spark.read.schema(sums.schema).parquet(store)
    return D.metrics_pass_at_k(sums), D.metrics_any_match(sums)
