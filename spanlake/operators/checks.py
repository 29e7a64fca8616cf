"""Data-quality checks (J1-J12).  Where the benchmark asserts and stops, each check here
returns a violation table ``(check, key, detail)``; an empty table means the rule holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.sequences import LABEL_PAD, first_sep_index


def _v(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def _key(cols) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


@dataclass(frozen=True)
class Rule:
    """A rule over single rows: ``detail`` says what is wrong (null: nothing)."""

    check: str
    key: Column
    detail: Column


def evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The violations of all rules in one pass over ``df``: each row carries an array with an
    entry per rule, of which the broken ones become rows."""
    every = F.array(*[F.struct(F.lit(r.check).alias("check"), r.key.cast("string").alias("key"),
                               r.detail.cast("string").alias("detail")) for r in rules])
    return df.select(F.inline(F.filter(every, lambda x: x["detail"].isNotNull())))


def lengths_rule(key: list[str], arrays: list[str]) -> Rule:
    """Parallel arrays of one row have one length."""
    sizes = [F.size(a) for a in arrays]
    bad = F.lit(False)
    for s in sizes[1:]:
        bad = bad | (s != sizes[0])
    return Rule("chk_lengths", _key(key), F.when(bad, F.concat_ws(",", *[s.cast("string") for s in sizes])))


def padded_rule(key: list[str], arrays: list[str], max_len: int) -> Rule:
    """Every array has exactly ``max_len`` entries after padding."""
    bad = F.lit(False)
    for a in arrays:
        bad = bad | (F.size(a) != max_len)
    return Rule("chk_padded", _key(key), F.when(bad, F.concat_ws(",", *[F.size(a).cast("string") for a in arrays])))


def sep_rule(key: list[str], tokens: str, labels: str | None = None, sep_token: str = "[SEP]_") -> Rule:
    """A separator occurs; with labels, the token at the first separator label is it."""
    detail = F.when(F.array_position(tokens, F.lit(sep_token)) == 0, F.lit("no separator"))
    if labels:
        at = F.get(F.col(tokens), first_sep_index(labels))
        detail = F.coalesce(detail, F.when(F.coalesce(at != F.lit(sep_token), F.lit(True)), F.lit("separator label not on separator token")))
    return Rule("chk_has_sep", _key(key), detail)


def prefix_rule(key: list[str], labels: str = "labels", segments: str | None = None, mask: str | None = None) -> Rule:
    """The query prefix has label 4 (segment 0, mask 1 when given)."""
    p = first_sep_index(labels) + 1
    bad = F.coalesce(F.exists(F.slice(labels, 1, p), lambda x: x != LABEL_PAD), F.lit(True))
    if segments:
        bad = bad | F.exists(F.slice(segments, 1, p), lambda x: x != 0)
    if mask:
        bad = bad | F.exists(F.slice(mask, 1, p), lambda x: x != 1)
    return Rule("chk_prefix", _key(key), F.when(bad, F.lit("prefix not all pad")))


def positive_rule() -> Rule:
    """Row-level prompts need positive examples."""
    return Rule("chk_positive", F.col("row_id"), F.when(F.col("example_type") != 1, F.col("example_type")))


def pass_count_rule(n: int = 10, key: str = "i") -> Rule:
    """At most n matching candidates per row."""
    return Rule("chk_pass_count", F.col(key), F.when(F.col("c") > n, F.col("c")))


def chk_lengths(df: DataFrame, key: list[str], arrays: list[str]) -> DataFrame:
    """J1 alone (``lengths_rule``)."""
    return evaluate(df, [lengths_rule(key, arrays)])


def chk_padded(df: DataFrame, key: list[str], arrays: list[str], max_len: int) -> DataFrame:
    """J2 alone (``padded_rule``)."""
    return evaluate(df, [padded_rule(key, arrays, max_len)])


def chk_has_sep(df: DataFrame, key: list[str], tokens: str, labels: str | None = None,
                sep_token: str = "[SEP]_") -> DataFrame:
    """J3 alone (``sep_rule``)."""
    return evaluate(df, [sep_rule(key, tokens, labels, sep_token)])


def chk_prefix(windows: DataFrame, key: list[str], labels: str = "labels", segments: str | None = None,
               mask: str | None = None, group: list[str] | None = None) -> DataFrame:
    """J4 (``prefix_rule``); with ``group``, all rows of a group share one prefix length."""
    out = evaluate(windows, [prefix_rule(key, labels, segments, mask)])
    if group:
        p = first_sep_index(labels) + 1
        g = (windows.groupBy(*group).agg(F.countDistinct(p).alias("n_plen"))
             .where(F.col("n_plen") > 1))
        out = out.unionByName(_v(g, "chk_prefix", _key(group), F.concat(F.lit("prefix lengths: "),
                                                                          F.col("n_plen").cast("string"))))
    return out


def check_examples(rows: DataFrame) -> DataFrame:
    """J6 and J11 over example rows in one scan: a row goes on once for its own rules and once
    for its file, and one aggregate by (query, file, row) yields both kinds of violations."""
    each = rows.select("query_name", "code_file_path", "row_id", "example_type", F.size("answer_spans").alias("n"),
                       F.explode(F.array(F.lit(True), F.lit(False))).alias("whole"))
    g = each.groupBy("query_name", "code_file_path", "whole", F.when(~F.col("whole"), F.col("row_id")).alias("row_id")).agg(
        F.min("example_type").alias("lo"), F.max("example_type").alias("hi"), F.max("n").alias("max_spans"))
    return evaluate(g, [Rule("chk_class_per_file", _key(["query_name", "code_file_path"]), F.when(F.col("whole"), _class_detail())),
                        Rule("chk_positive", F.col("row_id"), F.when(~F.col("whole") & (F.col("hi") != 1), F.col("hi")))])


def _class_detail() -> Column:
    return (F.when(F.col("lo") != F.col("hi"), "mixed example types")
            .when((F.col("max_spans") > 0) & (F.col("lo") != 1), "spans on a negative file")
            .when((F.col("max_spans") == 0) & (F.col("lo") == 1), "positive file without spans"))


def chk_windows(windows: DataFrame, seqs: DataFrame, width: int, key: str = "example_id",
                labels: str = "labels") -> DataFrame:
    """Split ids run 0..s-1, every window carries the same prefix and the count is
    ceil((len-p)/(W-p)) for long sequences.  Their stitched length is s*W - (s-1)*p when all
    windows are padded to W, else the sequence's own length."""
    g = windows.groupBy(key).agg(
        F.count(F.lit(1)).alias("s"), F.min("split_id").alias("lo"), F.max("split_id").alias("hi"),
        F.countDistinct(F.slice(labels, 1, first_sep_index(labels) + 1)).alias("n_prefix"),
        F.sum(F.size(labels)).alias("total_len"))
    n = F.size(labels)
    p = first_sep_index(labels) + 1
    expect = seqs.select(key, n.alias("n"), p.alias("p"))
    j = g.join(expect, key, "full")
    exp_s = (F.when(F.col("n") < width, F.lit(1))
             .when(F.lit(width) - F.col("p") > 0, F.ceil((F.col("n") - F.col("p")) / (F.lit(width) - F.col("p")))))
    stitched = F.col("total_len") - (F.col("s") - 1) * F.col("p")
    bad_ids = (F.col("lo") != 0) | (F.col("hi") + 1 != F.col("s"))
    bad_count = F.col("s") != exp_s
    bad_prefix = F.col("n_prefix") > 1
    padded = F.col("total_len") == F.col("s") * width
    bad_len = (F.col("n") >= width) & ~padded & (stitched != F.col("n"))
    detail = (F.when(F.col("s").isNull() | F.col("n").isNull(), "missing")
              .when(bad_ids, "split ids not consecutive").when(bad_count, "window count")
              .when(bad_prefix, "prefix differs").when(bad_len, "stitched length"))
    return _v(j.where(detail.isNotNull()), "chk_windows", F.col(key), detail)


def chk_class_per_file(rows: DataFrame) -> DataFrame:
    """One example type per (query, file); spans present iff positive."""
    g = rows.groupBy("query_name", "code_file_path").agg(
        F.min("example_type").alias("lo"), F.max("example_type").alias("hi"),
        F.max(F.size("answer_spans")).alias("max_spans"))
    return evaluate(g, [Rule("chk_class_per_file", _key(["query_name", "code_file_path"]), _class_detail())])


def chk_negative_empty(picks: DataFrame) -> DataFrame:
    """A negative few-shot example carries no answer and no fact spans, and a query has
    an example of each class under its own name."""
    neg = picks.where(F.col("example_type") == 0)
    bad = (F.size("answer_spans") > 0) | (F.size("supporting_fact_spans") > 0)
    spans = _v(neg.where(bad), "chk_negative_empty", _key(["query_name", "row_id"]), F.lit("negative with spans"))
    classes = picks.groupBy("query_name").agg(F.min("example_type").alias("lo"), F.max("example_type").alias("hi"))
    one = _v(classes.where(F.col("lo") == F.col("hi")), "chk_negative_empty", F.col("query_name"),
             F.when(F.col("lo") == 1, "no negative example").otherwise("no positive example"))
    return spans.unionByName(one)


def chk_sample_size(sample: DataFrame, available: DataFrame, size: int = 20) -> DataFrame:
    """More than ``size`` files available and exactly ``size`` drawn, per query."""
    s = sample.groupBy("query_name").agg(F.count(F.lit(1)).alias("drawn"))
    a = available.groupBy("query_name").agg(F.count(F.lit(1)).alias("avail"))
    j = a.join(s, "query_name", "left").fillna(0, ["drawn"])
    detail = (F.when(F.col("avail") <= size, F.concat(F.lit("only "), F.col("avail").cast("string"), F.lit(" available")))
              .when(F.col("drawn") != size, F.concat(F.lit("drawn "), F.col("drawn").cast("string"))))
    return _v(j.where(detail.isNotNull()), "chk_sample_size", F.col("query_name"), detail)


def chk_log_size(log: DataFrame, size: int = 20) -> DataFrame:
    """J8, log half: a query's log holds exactly ``size`` rows (the reader's declared schema
    and FAILFAST mode hold the column count)."""
    g = log.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != size)
    return _v(g, "chk_sample_size", F.col("query"), F.concat(F.lit("logged "), F.col("n").cast("string")))


def chk_schema_equal(a: DataFrame, b: DataFrame) -> bool:
    """Identical schemas before a union (driver-side metadata only)."""
    return a.schema == b.schema


def chk_pass_count(counts: DataFrame, n: int = 10, key: str = "i") -> DataFrame:
    """J10 alone (``pass_count_rule``)."""
    return evaluate(counts, [pass_count_rule(n, key)])


def chk_positive(rows: DataFrame) -> DataFrame:
    """J11 alone (``positive_rule``)."""
    return evaluate(rows, [positive_rule()])


def chk_group_counts(blocks: DataFrame, preds: DataFrame, keys=("query_name", "code_file_path")) -> DataFrame:
    """Per group, as many predictions as blocks and relevance targets."""
    b = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"),
                                  F.count("relevance_label").alias("n_targets"))
    p = preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_preds"))
    j = b.join(p, list(keys), "full").fillna(0, ["n_blocks", "n_targets", "n_preds"])
    bad = (F.col("n_blocks") != F.col("n_preds")) | (F.col("n_blocks") != F.col("n_targets"))
    return _v(j.where(bad), "chk_group_counts", _key(list(keys)),
              F.concat_ws("/", F.col("n_blocks").cast("string"), F.col("n_preds").cast("string"),
                          F.col("n_targets").cast("string")))
