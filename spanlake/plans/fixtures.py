"""Benchmark-shaped views derived by Spark from the driver's generic tables.

The benchmark itself ships no data, so each operator is exercised on a view
with the benchmark's logical schema, built from the given tables (documents,
labels, conversations, benchmark, embeddings, pages, nation, region, events).
Every rule is portable so that an independent SQL engine can rebuild it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.sequences import LABEL_PAD, SEP_TOKEN, UNK_TOKEN
from spanlake.functions.text import token_count


ROW_ID_TURNS = 1 << 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fx_files(spark: SparkSession, d: str) -> DataFrame:
    """One example per document: query = source, file = src/<lang>/<id>.txt.  ``em`` is the
    document's label, or for unlabelled ones derived from the text as in ``fx_rows``."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    derived = F.when(F.length("text") % 3 > 0, 1).otherwise(0)
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.lit("test").alias("split"),
        F.col("source").alias("query_name"),
        F.concat(F.lit("src/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"),
                 F.lit(".txt")).alias("code_file_path"),
        F.col("text").alias("content"),
        F.coalesce("quality", derived).cast("int").alias("em"),
        (F.col("doc_id") % 2).cast("int").alias("example_type"),
        token_count("text").alias("file_tokens"))


def fx_rows(spark: SparkSession, d: str) -> DataFrame:
    """Several example rows per file, from conversation turns.  ``row_id`` packs the
    conversation above the turn; 32 bits for the turn keep conversations apart."""
    c = table(spark, d, "conversations")
    lines = F.split(F.col("text"), "\n")
    positive = (F.col("conv_id") % 2) == 1
    empty_spans = F.array().cast("array<struct<span:string>>")
    answers = F.when(positive, F.transform(F.filter(lines, lambda l: F.length(l) % 2 == 1),
                                           lambda s: F.struct(s.alias("span")))).otherwise(empty_spans)
    facts = F.when(positive, F.transform(F.filter(lines, lambda l: F.length(l) % 2 == 0),
                                         lambda s: F.struct(s.alias("span")))).otherwise(empty_spans)
    return c.select(
        (F.col("conv_id") * ROW_ID_TURNS + F.col("turn")).alias("row_id"),
        F.when(F.col("conv_id") % 5 == 0, "train").otherwise("test").alias("split"),
        F.concat(F.lit("q"), ((F.col("conv_id") / 10).cast("long") % 10).cast("string")).alias("query_name"),
        F.concat(F.lit("src/c"), F.col("conv_id").cast("string"), F.lit(".py")).alias("code_file_path"),
        "conv_id", "turn", "role", "text",
        F.array(F.struct(F.col("text").alias("content"), F.col("turn").cast("int").alias("index"))
                ).alias("context_blocks"),
        answers.alias("answer_spans"),
        facts.alias("supporting_fact_spans"),
        (F.col("conv_id") % 2).cast("int").alias("example_type"),
        F.when(F.length("text") % 3 > 0, 1).otherwise(0).cast("int").alias("em"),
        token_count("text").alias("file_tokens"))


def fx_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Code blocks for two-step composition: every turn is a block of the file formed by
    the turns of one role in one conversation; header [query, SEP] + all words of the turn."""
    r = fx_rows(spark, d)
    body = F.split(F.col("text"), " ")
    return r.select(
        "row_id", "split", "query_name", "example_type", "conv_id", "turn", "role", "text",
        "answer_spans",
        F.concat(F.lit("src/c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("role"),
                 F.lit(".py")).alias("code_file_path"),
        F.col("turn").cast("int").alias("block_index"),
        F.col("turn").cast("int").alias("block_ordinal"),
        F.struct(F.col("turn").cast("int").alias("index")).alias("context_block"),
        (F.length("text") % 2 == 0).cast("int").alias("relevance_label"),
        F.when(F.length("text") % 3 > 0, 1).otherwise(0).cast("int").alias("predicted"),
        F.concat(F.array(F.col("query_name"), F.lit(SEP_TOKEN)), body).alias("subtokenized_input_sequence"),
        F.concat(F.array(F.lit(LABEL_PAD), F.lit(LABEL_PAD)),
                 F.transform(body, lambda t: (F.length(t) % 4).cast("int"))).alias("label_sequence"))


def fx_seq(spark: SparkSession, d: str) -> DataFrame:
    """Token/label sequences over the whole text of every document (words split on
    blanks): a query prefix of 3-5 pad labels, the separator token at its end."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    p = (F.lit(3) + F.col("doc_id") % 3).cast("int")
    base = docs.select("doc_id", "lang", F.split(F.col("text"), " ").alias("toks"), p.alias("plen"))
    tokens = F.transform("toks", lambda t, i: F.when(i == F.col("plen") - 1, F.lit(SEP_TOKEN)).otherwise(t))
    labels = F.transform("toks", lambda t, i: F.when(i < F.col("plen"), F.lit(LABEL_PAD))
                         .otherwise(F.length(t) % 4).cast("int"))
    s = base.select(F.col("doc_id").alias("example_id"), "doc_id", "lang", "plen",
                    tokens.alias("tokens"), labels.alias("labels"))
    out = F.transform("labels", lambda x, i: F.when((i + F.col("doc_id")) % 97 == 0, F.lit(2))
                      .otherwise(x).cast("int"))
    return s.withColumn("output", out)


def fx_vocab(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct benchmark word, quoted, id by token order, then the unknown and
    separator tokens (document words outside the benchmark texts are misses)."""
    from spanlake.operators.windows import global_row_number
    b = table(spark, d, "benchmark")
    toks = (b.select(F.explode(F.split("text", " ")).alias("w"))
            .select(F.concat(F.lit("'"), F.col("w"), F.lit("'")).alias("token")).distinct())
    ranked = global_row_number(toks, ["token"], "id")
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    extra = n.select(F.explode(F.array(
        F.struct(F.lit(f"'{UNK_TOKEN}'").alias("token"), F.col("n").alias("id")),
        F.struct(F.lit(f"'{SEP_TOKEN}'").alias("token"), (F.col("n") + 1).alias("id")))).alias("e")
    ).select("e.token", "e.id")
    return ranked.select("token", "id").unionByName(extra).select("token", F.col("id").cast("int"))


def fx_logits(spark: SparkSession, d: str) -> DataFrame:
    """One position per embedding value: the 5 logits of position p are values p..p+4
    (cyclically); target = (vec_id + p) % 5.  ``ordinal`` (3 vec_id, and 1 to 4 more) is
    unique, has gaps and is not in the order of vec_id."""
    e = table(spark, d, "embeddings")
    n = F.size("embedding")
    logits = F.transform(F.sequence(F.lit(0), n - 1),
                         lambda p: F.transform(F.sequence(F.lit(0), F.lit(4)),
                                               lambda c: F.get(F.col("embedding"), (p + c) % n).cast("double")))
    targets = F.transform(F.sequence(F.lit(0), n - 1),
                          lambda p: ((F.col("vec_id") + p) % 5).cast("int"))
    return e.select("vec_id", (F.col("vec_id") * 3 + (F.col("vec_id") % 2) * 4).alias("ordinal"),
                    logits.alias("logits"), targets.alias("targets"))


def fx_cands(spark: SparkSession, d: str) -> DataFrame:
    """Response log rows: answer = benchmark text, ten candidates with exact / fuzzy /
    no matches, blanks, and 'N/A' rows for item_id % 7 = 0."""
    b = table(spark, d, "benchmark")
    na = (F.col("item_id") % 7) == 0
    t = F.col("text")

    def cand(j: int):
        if j == 0:
            c = F.concat(F.lit("  "), t, F.lit("  "))
        elif j == 9:
            c = F.lit("   ")
        elif j % 2 == 1:
            c = F.replace(t, F.lit("the"), F.lit("thx"))
        else:
            c = F.substring(t, 3 * j + 1, 1 << 30)
        if j <= 2:
            c = F.when(na, F.lit("N/A")).otherwise(c)
        return c.alias(f"ans_{j}")

    return b.select(
        F.col("item_id").cast("int").alias("i"),
        F.concat(F.lit("q"), (F.col("item_id") % 4).cast("string")).alias("query"),
        F.concat(F.lit("b/"), F.col("item_id").cast("string"), F.lit(".py")).alias("file_path"),
        F.lit("").alias("prompt"),
        F.when(na, F.lit("N/A")).otherwise(t).alias("ans_spans"),
        *[cand(j) for j in range(10)])


def fx_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", F.col("url").alias("code_file_path"), F.col("html").alias("content"))


def fx_meta(spark: SparkSession, d: str) -> DataFrame:
    """Query metadata: names src<k> and q<k> per nation; desc = nation, recommendation = region."""
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    rows = j.select(F.explode(F.array(F.lit("src"), F.lit("q"))).alias("pfx"),
                    "n_nationkey", "n_name", "r_name")
    return rows.select(
        F.concat("pfx", F.col("n_nationkey").cast("string")).alias("query_name"),
        F.col("n_name").alias("desc"), F.col("r_name").alias("reccomendation"),
        F.lower("n_name").alias("folder"))
