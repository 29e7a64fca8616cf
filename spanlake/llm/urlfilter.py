"""URL filters: explicit rules, and a path-template tree per host learned from what the rules label.

A url's path is a list of segments; segments that are numbers or long hexadecimal names
are wildcards.  Per host the distinct lists with their counts form a tree, level by level;
past ``DEPTH`` only nodes with both labels grow on, however deep, and the rest of a list
below another node is one wildcard (``**``):

* a parent with many children that are nearly all rare generalises them into ``*``;
* children whose block rate does not differ significantly from their siblings' (two-sided
  test) merge into ``*``;
* a node's purity is its share of blocked pages among the labelled ones, smoothed towards
  its parent's purity (the host's towards that of all labelled pages).

Pages that no rule fits are blocked if their template's purity reaches ``PURITY``.

Counting happens on distinct (host, segments) after partial aggregation, so a hot host
costs no more than its distinct templates.  Everything is DataFrame functions.

Defined results: null urls and urls without ``://`` have an empty host and path and share
one tree; without labelled pages every purity is 0 (allow); repeated rows count each time;
further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import materialize, table

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DEPTH = 4
PURITY = 0.8
#: Pages' worth of the parent's purity in a node's own.
SMOOTH = 5.0
#: A parent with more children than this, of this share of its pages or less each, generalises them.
MANY, RARE = 32, 0.01
#: Standard errors from the siblings' rate that keep a branch apart.
APART = 3.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_columns(rules: list = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def segments() -> Column:
    raw = F.filter(F.split("path", "/"), lambda s: s != "")
    return F.transform(raw, lambda s: F.when(
        s.rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$|^[0-9A-Fa-f-]{16,}$"), F.lit("*")).otherwise(s))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def templates(judged: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, segs, template, purity) for each distinct segment list of ``judged``, which
    has host, segs and label (1 block, 0 allow, null unlabelled); from ``depth`` on only nodes
    with both labels grow."""
    t = materialize(judged.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count("label").alias("lab"), F.coalesce(F.sum("label"), F.lit(0)).alias("blk")), "url-lists")
    total = t.agg(F.sum("lab").alias("lab"), F.sum("blk").alias("blk")).head()
    prior = (total["blk"] or 0) / total["lab"] if total["lab"] else 0.0

    def smoothed(up):
        return (F.col("blk") + SMOOTH * up) / (F.col("lab") + SMOOTH)

    sums = [F.sum(c).alias(c) for c in ("n", "lab", "blk")]
    hosts = t.groupBy("host").agg(*sums).select("host", smoothed(F.lit(prior)).alias("purity"))
    t = t.join(hosts, "host").withColumns({"node": F.lit(""), "grows": F.lit(True)})
    for k in count():
        t = materialize(t, f"url-level{k}")
        here = F.col("grows") & (F.size("segs") > k)
        if k > depth and t.where(here).isEmpty():
            break
        # rows that stop here have no segment and thus no child
        seg = F.when(here, F.when(F.lit(k < depth) | F.col("mixed"), F.get("segs", F.lit(k))).otherwise("**")) if k else F.when(here, F.get("segs", F.lit(k)))
        kids = (t.withColumn("seg", seg).where("seg is not null")
                .groupBy("host", "node", "seg").agg(*sums, F.first("purity").alias("up")))
        kids = materialize(kids, f"url-kids{k}")
        up = kids.groupBy("host", "node").agg(
            F.count("*").alias("kids"), F.max("n").alias("largest"),
            *[F.sum(c).alias(f"all_{c}") for c in ("n", "lab", "blk")])
        both = kids.join(up, ["host", "node"])
        rate = (F.col("all_blk") + 0.5) / (F.col("all_lab") + 1)
        away = F.abs(F.col("blk") / F.col("lab") - rate) / F.sqrt(rate * (1 - rate) / F.col("lab"))
        variable = (F.col("kids") > MANY) & (F.col("n") <= RARE * F.col("all_n"))
        alike = (F.col("kids") > 1) & (F.col("lab") > 0) & (away < APART)
        general = F.when(variable | alike, "*").otherwise(F.col("seg"))
        named = both.select("host", "node", "seg", general.alias("as"), "up", "lab", "blk", "n")
        merged = named.groupBy("host", "node", "as").agg(F.sum("lab").alias("lab"), F.sum("blk").alias("blk"),
                                                         F.first("up").alias("up"))
        merged = merged.select("host", "node", "as", smoothed(F.col("up")).alias("purity_k"),
                               ((F.col("blk") > 0) & (F.col("blk") < F.col("lab"))).alias("mixed_k"))
        nodes = named.select("host", "node", "seg", "as").join(merged, ["host", "node", "as"])
        t = (t.withColumn("seg", seg)
             .join(nodes, ["host", "node", "seg"], "left")
             .select("host", "segs", "n", "lab", "blk", F.coalesce("purity_k", "purity").alias("purity"),
                     F.when(F.col("as").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), "as")).alias("node"),
                     F.coalesce("mixed_k", F.lit(False)).alias("mixed"),
                     (F.lit(k < depth) | (F.col("as").isNotNull() & F.col("mixed"))).alias("grows") if k else F.lit(True).alias("grows")))
    return t.select("host", "segs", F.col("node").alias("template"), "purity")


def judge(pages: DataFrame, rules: list = RULES, purity: float = PURITY) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page."""
    host, path = host_path()
    name, verdict = rule_columns(rules)
    base = (pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
            .withColumns({"rule": name, "by_rule": verdict, "segs": segments()}))
    base = materialize(base, "url-pages")
    label = F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0)
    tree = templates(base.select("host", "segs", label.alias("label")))
    by_tree = F.when(F.col("purity") >= purity, "block").otherwise("allow")
    return base.join(tree, ["host", "segs"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_tree).alias("verdict"), "template", "purity")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
