"""A training corpus from ``documents``: language id, near duplicates, benchmark
decontamination, personal data, mixture.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``.  ``run`` writes each stage's result as Parquet
into the shared scratch folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import decontaminate, jaccard, langid, mixing, pii
from spanlake.llm.common import materialize, table

#: Below this score a text is nearer to no learned language than to any.
MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those too far from every language."""
    found = langid.predict(docs, langid.fit_documents(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the least doc_id stays (once, if its
    row is repeated); documents without id are not compared and stay."""
    first = jaccard.join(docs).where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(first.hint("merge"), "doc_id").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; keeps every document."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy (``copy`` from 1) that the mix takes of a document."""
    mixed = mixing.mix(docs)
    return (mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(*docs.columns, "copy", "size", "source_size", "target"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: The stages are learned, hashed or randomised: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
