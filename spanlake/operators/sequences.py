"""Sequence shaping on array columns: model inputs, padding, sliding windows, stitching
and two-step block composition (H5-H7, H11, D13, D14, E4).  One row per sequence;
all work is array expressions inside a row, except re-assembly by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.sequences import (
    LABEL_PAD, RELEVANCE_MAX_LEN, SEP_TOKEN, SPAN_MAX_LEN, first_sep_index, input_mask,
    pad_truncate, segment_ids,
)


def span_inputs(df: DataFrame, ids_col: str, sep: int, labels_col: str | None = "labels") -> DataFrame:
    """H5: segment ids (0 through the first separator, 1 after) and the all-ones mask.

    ``has_sep`` is false for sequences without a separator (the benchmark asserts)."""
    seg = segment_ids(ids_col, sep)
    out = df.withColumn("segments", seg).withColumn("mask", input_mask(ids_col))
    return out.withColumn("has_sep", F.col("segments").isNotNull())


def pad_span_inputs(df: DataFrame, max_len: int = SPAN_MAX_LEN, ids="ids", segments="segments",
                    mask="mask", labels="labels") -> DataFrame:
    """H6: pad / cut ids, segments and mask with 0 and labels with 4 to ``max_len``."""
    return (df.withColumn(ids, pad_truncate(ids, max_len, 0))
            .withColumn(segments, pad_truncate(segments, max_len, 0))
            .withColumn(mask, pad_truncate(mask, max_len, 0))
            .withColumn(labels, pad_truncate(labels, max_len, LABEL_PAD)))


def pad_relevance_inputs(df: DataFrame, max_len: int = RELEVANCE_MAX_LEN, ids="ids",
                         segments="segments", mask="mask") -> DataFrame:
    """H7: the same to 512 for relevance inputs; the scalar label is untouched."""
    return (df.withColumn(ids, pad_truncate(ids, max_len, 0))
            .withColumn(segments, pad_truncate(segments, max_len, 0))
            .withColumn(mask, pad_truncate(mask, max_len, 0)))


def split_windows(df: DataFrame, width: int, arrays: list[str], labels: str = "labels",
                  key: str = "example_id") -> tuple[DataFrame, DataFrame]:
    """H11 + E4: sliding-window split.

    A sequence shorter than ``width`` is one window, unchanged.  Otherwise the query
    prefix (first separator + 1 positions) is repeated before each non-overlapping body
    chunk of ``width - prefix`` positions.  Returns ``(windows, rejects)``; a sequence
    of length >= width with no separator or a prefix >= width is rejected (the benchmark
    fails or never ends on those)."""
    staged = df.withColumn("plen", first_sep_index(labels) + 1)
    n = F.size(labels)
    nwin = F.when(n < width, F.lit(1)).otherwise(
        F.ceil((n - F.col("plen")) / (F.lit(width) - F.col("plen"))).cast("int"))
    long_seq = F.size(labels) >= width
    bad = long_seq & (F.col("plen").isNull() | (F.col("plen") >= width))
    # No filter on the derived columns (the optimizer would push it below the projection
    # and re-evaluate the array expressions inside it): a rejected sequence simply gets
    # zero windows, and the reject table is a separate, lazily evaluated projection.
    staged = staged.withColumn("n_windows", F.when(bad, F.lit(0)).otherwise(nwin))
    rejects = staged.where(bad).select(key, F.lit("window_split").alias("check"),
                                       F.when(F.col("plen").isNull(), "no separator")
                                       .otherwise("prefix >= width").alias("detail"))
    body = F.lit(width) - F.col("plen")
    exploded = staged.select("*", F.explode(
        F.when(F.col("n_windows") > 0, F.sequence(F.lit(0), F.col("n_windows") - 1))
        .otherwise(F.array().cast("array<int>"))).alias("split_id"))

    def cut(a: str) -> Column:
        return F.when(F.size(a) < width, F.col(a)).otherwise(F.concat(
            F.slice(a, 1, F.col("plen")),
            F.slice(a, F.col("plen") + 1 + F.col("split_id") * body, body)))

    cols = [c for c in df.columns if c not in arrays]
    windows = exploded.select(*cols, F.col("split_id").cast("int"), "plen",
                              *[cut(a).alias(a) for a in arrays])
    return windows, rejects


def stitch_windows(windows: DataFrame, arrays: list[str], key: str = "example_id",
                   labels: str = "labels") -> DataFrame:
    """Merge the windows of each example: window 0 whole, later windows without the
    query prefix.

    The prefix is cut from each later window *before* grouping (a plain per-row
    ``slice``, code-generated); after grouping, the sorted windows' arrays are
    concatenated with native field extraction + ``flatten`` - no per-window lambda.  The
    prefix length is the windows' ``plen`` column when present, else the window's own
    first separator (all windows of an example share it; ``chk_windows`` verifies).  An example
    is one cell: ``limits.split_oversized`` takes out those that no task should hold."""
    p = F.col("plen") if "plen" in windows.columns else first_sep_index(labels) + 1
    staged = windows.select(key, "split_id", p.alias("_p"), *arrays)

    def body(a: str) -> Column:
        return F.when(F.col("split_id") == 0, F.col(a)).otherwise(
            F.slice(a, F.col("_p") + 1, F.greatest(F.size(a) - F.col("_p"), F.lit(0))))

    trimmed = staged.select(key, "split_id", "_p", *[body(a).alias(a) for a in arrays])
    agg = trimmed.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("split_id", *arrays))).alias("_w"),
        F.count(F.lit(1)).alias("n_windows"), F.max("split_id").alias("_max_split"),
        F.max(F.when(F.col("split_id") == 0, F.col("_p"))).alias("plen"))
    return agg.select(key, "n_windows", "plen", *[F.flatten(F.col(f"_w.{a}")).alias(a) for a in arrays],
                      ((F.col("_max_split") + 1) != F.col("n_windows")).alias("split_gap"))


_PROV = "array<struct<label:int,block_index:int,block_offset:int>>"


def compose_twostep(blocks: DataFrame, mode: str = "all") -> tuple[DataFrame, DataFrame]:
    """Two-step inputs per (query, file).

    Header = the first block's tokens through its first separator (segment 0, provenance
    -1); then the bodies of the blocks predicted relevant, in block order, with a
    separator token (label 4, segment 1) *between* them; block offsets restart at 0.
    The target sequence takes the blocks whose relevance label is 1.  A file with a
    single block skips prediction (predicted = target = 1).  Tokens stay strings here;
    encode them with ``vocab_encode``.  Returns ``(sequences, rejects)``: a file whose first
    block has no separator is rejected (the benchmark stops there)."""
    from spanlake.operators.filters import filter_example_type
    b = filter_example_type(blocks, mode)
    g = b.groupBy("query_name", "code_file_path").agg(F.array_sort(F.collect_list(F.struct(
        "block_ordinal", "row_id", "block_index", "predicted", "relevance_label",
        F.col("subtokenized_input_sequence").alias("tokens"),
        F.col("label_sequence").alias("labels")))).alias("bl"))
    first = F.get(F.col("bl"), 0)
    g = g.withColumn("p", first_sep_index(first["labels"]) + 1).withColumn("nb", F.size("bl"))
    rejects = g.where(F.col("p").isNull()).select(
        "query_name", "code_file_path", F.lit("compose_twostep").alias("check"), F.lit("no separator").alias("detail"))
    g = g.where(F.col("p").isNotNull())
    sep_prov = F.struct(F.lit(LABEL_PAD).alias("label"), F.lit(-1).alias("block_index"),
                        F.lit(-1).alias("block_offset"))

    def body_prov(bk):
        body = F.slice(bk["labels"], F.col("p") + 1, F.greatest(F.size(bk["labels"]) - F.col("p"), F.lit(0)))
        return F.transform(body, lambda x, j: F.struct(x.cast("int").alias("label"),
                                                       bk["block_index"].cast("int").alias("block_index"),
                                                       j.cast("int").alias("block_offset")))

    def body_tokens(bk):
        return F.slice(bk["tokens"], F.col("p") + 1, F.greatest(F.size(bk["tokens"]) - F.col("p"), F.lit(0)))

    def chosen(flag: str):
        return F.filter("bl", lambda bk: F.when(F.col("nb") == 1, F.lit(1)).otherwise(bk[flag]) == 1)

    def joined(sel, count, part, sep_item):
        """Parts of the selected blocks with a separator item between consecutive ones."""
        return F.flatten(F.transform(sel, lambda bk, i: F.when(
            i < count - 1, F.concat(part(bk), F.array(sep_item))).otherwise(part(bk))))

    header_prov = F.transform(F.slice(first["labels"], 1, F.col("p")), lambda x: F.struct(
        x.cast("int").alias("label"), F.lit(-1).alias("block_index"), F.lit(-1).alias("block_offset")))
    # stage the selections and the header once per group (each is used several times)
    g = (g.withColumn("_psel", chosen("predicted")).withColumn("_tsel", chosen("relevance_label"))
         .withColumn("_np", F.size("_psel")).withColumn("_nt", F.size("_tsel"))
         .withColumn("_hprov", header_prov).withColumn("_htok", F.slice(first["tokens"], 1, F.col("p"))))
    pred_sel, targ_sel = F.col("_psel"), F.col("_tsel")
    tokens = F.concat(F.col("_htok"), joined(pred_sel, F.col("_np"), body_tokens, F.lit(SEP_TOKEN)))
    predicted = F.concat(F.col("_hprov"), joined(pred_sel, F.col("_np"), body_prov, sep_prov))
    target = F.concat(F.col("_hprov"), joined(targ_sel, F.col("_nt"), body_prov, sep_prov))
    out = g.select("query_name", "code_file_path", "p", "nb", tokens.alias("tokens"),
                   predicted.alias("predicted"), target.alias("target"))
    n = F.size("tokens")
    out = (out.withColumn("segments", F.concat(F.array_repeat(F.lit(0), F.col("p")),
                                               F.array_repeat(F.lit(1), n - F.col("p"))))
           .withColumn("mask", F.array_repeat(F.lit(1), n))
           .withColumn("labels", F.transform("predicted", lambda x: x["label"])))
    return out, rejects
