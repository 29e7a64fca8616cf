"""Personal data by candidate gradient boosting, in DataFrame functions throughout.

Generators of high recall propose spans of four kinds, which may overlap: the base
patterns (``base`` is set where a match passes its kind's test) and stricter patterns that
find a number inside a longer run, bare and national phone numbers and obfuscated mail.
Binary format and context features describe a candidate.  Boosted depth-2 trees are fitted to
the hand-labelled sentences of ``pii_sample``, whose labels are no function of the features.
Thresholds are calibrated on other sentences than the scores come from: the sentences are
dealt by hash into folds, each is scored by trees of the other folds, and a kind's threshold
is the lowest score down to which the proposals have ``PRECISION``.  The model therefore does
not depend on the corpus: neither its size nor the rates of spans in it move the thresholds.
Base spans always stay; the model adds candidates whose score reaches the threshold and that
overlap no base span and no better added one.

Positions are code points, end exclusive.  Patterns are possessive and anchored at the
start of a run, so long runs cost linear time.

Defined results: null texts are empty and have no spans; repeated rows are judged alike;
further columns, whatever their names, are ignored by the query, and ``redact`` passes them
through.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import table
from spanlake.llm.pii_sample import SENTENCES

KINDS = ["email", "ip", "card", "phone"]
ROUNDS, RATE, PRECISION, FOLDS = 40, 0.3, 0.9, 5
CONTEXT = 24

_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_DIGIT_RUN = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A national number (trunk prefix 0) is proposed only after one of these words.
_CALL = "(?:(?i:tel|tél|phone|fax|mob|call|ruf))"
_DATE = r"[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{2,4}(?![0-9]|[./-][0-9])"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

_LUHN = """(aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = 1, 1, 0) * int(substring({d}, length({d}) + 1 - i, 1))
  + if(i % 2 = 0, element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), int(substring({d}, length({d}) + 1 - i, 1)) + 1), 0)) % 10 = 0)"""
#: Cards under 16 digits: Amex, Diners, short Visa.
_ISSUER = "^(3[47][0-9]{13}|3[0689][0-9]{12}|4[0-9]{12})$"
_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"

#: (kind, pattern, text guard, base test of a match; null: a proposal that is never base)
GENERATORS = [
    ("email", _EMAIL, "contains(t, '@')", "true"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++",
     "(contains(t, '(at)') or contains(t, '[at]'))", None),
    ("ip", _IP, "num", f"x.m rlike '^{_OCTET}([.]{_OCTET}){{3}}$'"),
    ("card", _DIGIT_RUN, "num", "length(d) >= 16 and " + _LUHN.format(d="d")),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])", "num", None),
    ("phone", _PHONE, "contains(t, '+')", "length(d) between 8 and 15"),
    ("phone", r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", "num", None),
    ("phone", rf"(?<![0-9])(?=[(]?0)(?<={_CALL}[A-Za-zé]{{0,8}}[.:]{{0,2}} {{0,2}}[:]? ?)(?!{_DATE})(?:\(0[0-9]{{1,4}}\)|0[0-9]{{1,4}})(?:[ ./-]{{0,2}}[0-9]{{2,8}}){{1,5}}+(?![0-9])",
     f"num and t rlike '{_CALL}'", None),
]

#: Feature tests of a candidate ``x`` (m: match, l: text before, r: character after, d: its digits).
FEATURES = [
    *[f"x.kind = {k}" for k in range(len(KINDS))],
    "length(d) >= 8",
    "length(d) >= 13",
    "x.m rlike '[ .-]'",
    "not x.l rlike '[A-Za-z0-9_]$'",
    "not x.r rlike '^[A-Za-z0-9_]'",
    "x.l rlike '(?i)(mail|contact|phone|call|tel|fax|card|pay|visa|address|host)'",
    f"""case x.kind when 0 then x.m rlike '([.]|[^a-z]dot[^a-z] ?)[A-Za-z]{{2,}}$' when 1 then x.m rlike '^{_OCTET}([.]{_OCTET}){{3}}$'
        when 2 then (length(d) between 16 and 19 or d rlike '{_ISSUER}') and {_LUHN.format(d='d')} else length(d) between 8 and 15 end""",
    "size(array_distinct(split(d, ''))) >= 3",
    "x.m rlike '[(/+-]'",
    "x.l rlike '(?i)(order|isbn|ean|serial|row|id|epoch|at|track[a-z]*|version|build|section|chapter|number|no)[.:]? *$'",
]

_SPAN = "array<struct<kind:int,s:int,e:int,m:string,l:string,r:string>>"


def _matches(kind: int, pattern: str, guard: str) -> str:
    """All matches of a pattern in ``t`` with positions and context: the text is split at the
    matches, and the lengths of pieces and matches add up to the positions."""
    p = f"r'{pattern}'"
    return f"""if({guard}, transform(array(regexp_extract_all(t, {p}, 0)), ms -> if(size(ms) = 0, cast(array() as {_SPAN}),
      transform(array(split(t, {p}, -1)), ps -> aggregate(sequence(0, size(ms) - 1),
        named_struct('pos', 0, 'out', cast(array() as {_SPAN})),
        (a, i) -> named_struct('pos', a.pos + length(ps[i]) + length(ms[i]),
          'out', concat(a.out, array(named_struct('kind', {kind}, 's', a.pos + length(ps[i]),
            'e', a.pos + length(ps[i]) + length(ms[i]), 'm', ms[i],
            'l', substring(ps[i], greatest(length(ps[i]) - {CONTEXT - 1}, 1), {CONTEXT}), 'r', substring(ps[i + 1], 1, 1))))),
        a -> a.out))[0]))[0], cast(array() as {_SPAN}))"""


def _rest(docs: DataFrame) -> Column:
    """The caller's columns as one, so that none of the names below can meet theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, t, cands): the row, its text and the array of (kind, s, e, base, bits) proposed
    in it, without duplicates."""
    t = docs.select(_rest(docs), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    t = t.withColumn("num", F.col("t").rlike("[0-9].{0,2}[0-9]"))
    for g, (kind, pattern, guard, _) in enumerate(GENERATORS):
        t = t.withColumn(f"g{g}", F.expr(_matches(KINDS.index(kind), pattern, guard)))
    bits = " + ".join(f"if({f}, {1 << i}, 0)" for i, f in enumerate(FEATURES))
    for g, (_, _, _, base) in enumerate(GENERATORS):
        t = t.withColumn(f"g{g}", F.expr(
            f"""transform(g{g}, x -> transform(array({_DIGITS}), d -> named_struct('kind', x.kind, 's', x.s, 'e', x.e,
                'base', {base or 'false'}, 'bits', {bits}))[0])"""))
    proved = [f"g{g}" for g in range(len(GENERATORS)) if GENERATORS[g][3]]
    others = [f"g{g}" for g in range(len(GENERATORS)) if not GENERATORS[g][3]]
    t = t.withColumn("own", F.concat(*proved))
    return t.select("doc", "t", F.concat("own", F.filter(F.array_distinct(F.concat(*others)), lambda x: ~F.exists(
        F.col("own"), lambda b: (b["kind"] == x["kind"]) & (b["s"] == x["s"]) & (b["e"] == x["e"])))).alias("cands"))


@dataclass
class Model:
    """Boosted depth-2 trees over feature bits, and the score that adds a span of each kind."""

    trees: list[tuple] = field(default_factory=list)
    start: float = 0.0
    thresholds: list[float] = field(default_factory=lambda: [math.inf] * len(KINDS))

    def scores(self, bits: np.ndarray) -> np.ndarray:
        out = np.full(len(bits), self.start)
        for f, (g0, a0, b0), (g1, a1, b1) in self.trees:
            low = np.where(bits >> g0 & 1, b0, a0)
            high = np.where(bits >> g1 & 1, b1, a1)
            out += np.where(bits >> f & 1, high, low)
        return out

    def expression(self, x: str = "x") -> str:
        def on(f):
            return f"({x}.bits & {1 << f}) != 0"

        terms = [f"if({on(f)}, if({on(g1)}, {b1!r}D, {a1!r}D), if({on(g0)}, {b0!r}D, {a0!r}D))"
                 for f, (g0, a0, b0), (g1, a1, b1) in self.trees]
        return " + ".join([f"{self.start!r}D", *terms])


def _leaf(grad: float, hess: float) -> float:
    return float(RATE * grad / (hess + 1.0))


def _best(bits, grad, hess, keep) -> tuple[int, float, float, float]:
    """The split of the kept rows with the largest gain: (feature, value off, value on, gain)."""
    found = (0, 0.0, 0.0, -1.0)
    for f in range(len(FEATURES)):
        on = keep & ((bits >> f & 1) == 1)
        off = keep & ~on
        g1, h1, g0, h0 = grad[on].sum(), hess[on].sum(), grad[off].sum(), hess[off].sum()
        gain = g1 * g1 / (h1 + 1) + g0 * g0 / (h0 + 1)
        if gain > found[3] + 1e-12:
            found = (f, _leaf(g0, h0), _leaf(g1, h1), float(gain))
    return found


def boost(bits: np.ndarray, yes: np.ndarray, no: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Newton boosting of the logistic loss on counted feature sets."""
    model, n = Model(), yes + no
    if not n.sum():
        return model
    model.start = float(math.log((yes.sum() + 0.5) / (no.sum() + 0.5)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-model.scores(bits)))
        grad, hess = yes - n * p, n * p * (1 - p)
        trees = []
        for f in range(len(FEATURES)):
            on = (bits >> f & 1) == 1
            low, high = _best(bits, grad, hess, ~on), _best(bits, grad, hess, on)
            trees.append((low[3] + high[3], f, low[:3], high[:3]))
        gain, f, low, high = max(trees, key=lambda x: (x[0], -x[1]))
        model.trees.append((f, low, high))
    return model


def calibrate(kinds: np.ndarray, scores: np.ndarray, yes: np.ndarray, precision: float = PRECISION) -> list[float]:
    """Per kind the lowest score whose candidates, with all above it, have the precision, moved
    half of the way to the next one below; the scores are of trees that did not see them."""
    out = []
    for k in range(len(KINDS)):
        own = kinds == k
        limit = math.inf
        levels = sorted(set(scores[own]), reverse=True)
        for i, s in enumerate(levels):
            if yes[own & (scores >= s)].mean() >= precision:
                limit = float((s + levels[i + 1]) / 2) if i + 1 < len(levels) else float(s)
        out.append(limit)
    return out


def sample(spark: SparkSession) -> list[tuple[str, int, bool, bool, int]]:
    """(sentence, kind, base, personal, bits) of every candidate of the labelled sentences."""
    rows = []
    for line in SENTENCES.strip().split("\n"):
        text, _, label = line.rpartition("|")
        kind, _, span = label.partition(" ")
        rows.append((text, KINDS.index(kind) if span else -1, text.find(span) if span else -1, len(span)))
    docs = spark.createDataFrame(rows, "text string, kind int, start int, size int")
    found = with_candidates(docs).select("doc.*", F.explode("cands").alias("x")).select(
        "text", "x.kind", "x.base", ((F.col("kind") == F.col("x.kind")) & (F.col("start") == F.col("x.s"))
                                     & (F.col("start") + F.col("size") == F.col("x.e"))).alias("yes"), "x.bits")
    return sorted(tuple(r) for r in found.collect())


def fit(spark: SparkSession) -> Model:
    """The model of the labelled sentences."""
    rows = sample(spark)
    bits, yes = np.array([r[4] for r in rows], np.int64), np.array([r[3] for r in rows], float)
    fold = np.array([zlib.crc32(r[0].encode()) % FOLDS for r in rows])
    scores = np.zeros(len(rows))
    for f in range(FOLDS):
        scores[fold == f] = boost(bits[fold != f], yes[fold != f], 1 - yes[fold != f]).scores(bits[fold == f])
    model = boost(bits, yes, 1 - yes)
    model.thresholds = calibrate(np.array([r[1] for r in rows]), scores, yes)
    return model


def with_spans(cands: DataFrame, model: Model) -> DataFrame:
    """(doc, t, base, spans): the base spans, and with the added ones, as arrays of
    (kind, s, e) in order."""
    limit = "case x.kind " + " ".join(f"when {k} then {'9e99' if math.isinf(v) else repr(v)}D"
                                      for k, v in enumerate(model.thresholds)) + " end"
    out = cands.withColumn("base", F.array_sort(F.expr(
        "transform(filter(cands, x -> x.base), x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))")))
    out = out.withColumn("more", F.expr(f"""filter(transform(filter(cands, x -> not x.base), x -> named_struct('kind', x.kind,
        's', x.s, 'e', x.e, 'score', {model.expression()})), x -> x.score >= {limit}
        and not exists(base, b -> b.s < x.e and x.s < b.e))"""))
    out = out.withColumn("added", F.expr("""transform(filter(more, x -> not exists(more, y -> y.s < x.e and x.s < y.e and
        (y.score > x.score or (y.score = x.score and (y.s < x.s or (y.s = x.s and (y.e > x.e or (y.e = x.e and y.kind < x.kind)))))))),
        x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))"""))
    return out.select("doc", "t", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.kind], ':', x.s, ':', x.e)), ',')")


def redact(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind's tag (spans that overlap an
    earlier one extend it); ``n_chars`` follows the new text where the column exists."""
    found = with_spans(with_candidates(docs, text), model or fit(docs.sparkSession))
    tags = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    new = F.expr(f"""aggregate(array_sort(transform(spans, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind))),
        named_struct('pos', 0, 'out', ''),
        (a, x) -> if(x.s >= a.pos, named_struct('pos', x.e, 'out', concat(a.out, substring(t, a.pos + 1, x.s - a.pos), array({tags})[x.kind])),
                     named_struct('pos', greatest(a.pos, x.e), 'out', a.out)),
        a -> concat(a.out, substring(t, a.pos + 1, length(t))))""")
    found = found.select("doc", F.size("spans").alias("n"), F.when(F.size("spans") > 0, new).alias("new"))

    def column(c: str) -> Column:
        old = F.col("doc").getField(c)
        if c == text:
            return F.when(F.col("n") > 0, F.col("new")).otherwise(old.cast("string"))
        if c == "n_chars":
            return F.when(F.col("n") > 0, F.length("new").cast(docs.schema[c].dataType)).otherwise(old)
        return old

    return found.select(*[column(c).alias(c) for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_spans(with_candidates(docs), fit(spark))
    count = [F.expr(f"size(filter(base, x -> x.kind = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc.doc_id", *count, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
                        (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
