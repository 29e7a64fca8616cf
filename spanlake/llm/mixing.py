"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words: its weight's share of all words, but at most
``max_copies`` times what it has; what a capped source leaves is shared again by weight.
A document of a source is due ``target / source words`` copies; the whole part is taken,
the fraction is rounded: documents are paired, word mass moves at random between the two
until the larger one's fraction is 0 or 1 (with the probability of its fraction), and the
other one goes on to the next pair with the mass that is left.  Pairs move words, not
probabilities, and go from large to small documents, so a source's due and taken words
agree up to its last, small open document.

The rounding is a reduction tree: groups of about ``group`` documents of a source are
folded to one open document each, the open ones of ``group`` neighbouring groups are
folded next, and so on; no task sees more than a group.  The randomness is a hash of
documents and seed, so reruns agree.  Everything is DataFrame functions.

Rows are stored once with their sizes, so words are counted once and every row without
doc_id has a number of its own.

Defined results: a null text has size 0, a null source is a source of its own (ranked
last), rows that repeat doc_id, source and size are rounded as one unit and taken alike,
rows without doc_id are rounded each by itself, sources without words have target 0, an empty
table gives an empty mix; further columns, whatever their names, pass through unless they
carry a result's name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlake.llm.common import materialize, table

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
GROUP = 256
SEED = 20240607
RESULT = ["size", "source_size", "target", "copies", "taken"]


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, ...) with ``target``: shares by weight, capped and reshared.

    Sources in order of ``max size / weight`` fill up first; the level that the others
    share is the first at which the next source no longer overflows."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = (sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)),
                                                 ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
              .withColumn("most", (F.col("source_size") * max_copies).cast("double"))
              .withColumn("room", F.col("most") / F.col("w")))
    level = ((F.sum("source_size").over(every) - (F.sum("most").over(by_room) - F.col("most")))
             / (F.sum("w").over(every) - (F.sum("w").over(by_room) - F.col("w"))))
    return (ranked.withColumn("own", level)
            .withColumn("level", F.min(F.when(F.col("own") <= F.col("room"), F.struct("room", "own"))).over(every)["own"])
            .withColumn("target", F.when(F.col("room") <= F.col("level"), F.col("most"))
                        .otherwise(F.col("level") * F.col("w")))
            .drop("w", "most", "room", "own", "level"))


# One fold over a group, largest document first: each document's due words, with the mass
# that its predecessor handed on, decide it at random; what is left over (or overdrawn)
# goes to its partner, the next document.  The smallest one stays open.
_FOLD = """
aggregate(slice(docs, 1, size(docs) - 1),
  named_struct('debt', 0D, 'done', cast(array() as array<struct<doc_id:bigint,row:bigint,size:bigint,extra:int>>)),
  (acc, x) -> transform(transform(array(x.mass + acc.debt), due -> named_struct('due', due, 'extra',
      case when due <= 0 then 0 when due >= x.w then 1
           when pmod(xxhash64(x.h, {seed}, {level}), 9007199254740992) / 9007199254740992D * x.w < due then 1 else 0 end)),
    d -> named_struct('debt', d.due - d.extra * x.w,
                      'done', concat(acc.done, array(named_struct('doc_id', x.doc_id, 'row', x.row, 'size', x.size, 'extra', d.extra)))))[0])
"""


def _fold(open_docs: DataFrame, level: int, seed: int) -> DataFrame:
    """Fold each (source, block) to its smallest document, left open with the group's
    remaining mass; ``done``: the decided ones."""
    grouped = open_docs.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("size")).alias("order"), "h", "doc_id", "row", "size", "w", "mass"))).alias("docs"))
    folded = grouped.select("source", "block", F.element_at("docs", -1).alias("last"),
                            F.expr(_FOLD.format(seed=seed, level=level)).alias("r"))
    return folded.select("source", "block", "r.done", F.struct(
        "last.h", "last.doc_id", "last.row", "last.size", "last.w", (F.col("last.mass") + F.col("r.debt")).alias("mass")).alias("open"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES, group: int = GROUP,
        seed: int = SEED, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, source, text, ...) with size, source_size, target, copies, taken;
    ``columns``: the ones to pass through (all but those names)."""
    kept = [c for c in (columns or docs.columns) if c not in RESULT]
    stored = materialize(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), n_words().alias("size"))
        .withColumn("row", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), "mix-rows")
    sources = materialize(targets(stored.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, max_copies)
        .withColumn("due", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor(F.col("due") + 1e-9).cast("int"))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("due") - F.col("whole"))), "mix-targets")
    of = sources.select(F.col("source").alias("s"), "source_size", "target", "whole", "p", "n")
    units = stored.where("size > 0").groupBy("source", "doc_id", "row", "size").agg(F.count("*").alias("m"))
    open_docs = (units.join(of, F.col("source").eqNullSafe(F.col("s"))).where("p > 1e-9")
                 .select("source", F.pmod(F.xxhash64("doc_id", "row", "size", F.lit(seed)), F.ceil(F.col("n") / group)).alias("block"),
                         F.xxhash64("doc_id", "row", "size", F.lit(seed + 1)).alias("h"), "doc_id", "row", "size",
                         (F.col("m") * F.col("size")).cast("double").alias("w"),
                         (F.col("p") * F.col("m") * F.col("size")).alias("mass")))
    blocks = math.ceil((sources.agg(F.max("n")).head()[0] or 0) / group)
    decided, level = None, 0
    while True:
        folded = materialize(_fold(open_docs, level, seed), f"mix-level{level}")
        done = folded.select("source", F.explode("done").alias("d")).select("source", "d.*")
        decided = done if decided is None else decided.unionByName(done)
        left = folded.select("source", F.floor(F.col("block") / group).alias("block"), "open.*")
        level += 1
        if blocks <= 1:
            break
        open_docs, blocks = left, math.ceil(blocks / group)
    last = left.select("source", "doc_id", "row", "size", F.when(
        F.pmod(F.xxhash64("h", F.lit(seed + 2)), F.lit(1 << 53)) / float(1 << 53) < F.col("mass") / F.col("w"), 1)
        .otherwise(0).alias("extra"))
    decided = decided.unionByName(last).select(F.col("source").alias("e_source"), F.col("doc_id").alias("e_id"),
                                               F.col("row").alias("e_row"), F.col("size").alias("e_size"), "extra")
    on = (F.col("doc_id").eqNullSafe(F.col("e_id")) & F.col("row").eqNullSafe(F.col("e_row"))
          & (F.col("size") == F.col("e_size")) & F.col("source").eqNullSafe(F.col("e_source")))
    joined = stored.join(decided.hint("merge"), on, "left").join(of, F.col("source").eqNullSafe(F.col("s")), "left")
    copies = (F.col("whole") + F.coalesce(F.col("extra"), F.lit(0))).cast("long")
    return joined.select(*[F.col("doc").getField(c).alias(c) for c in kept], "size", "source_size", "target",
                         copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, columns=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
