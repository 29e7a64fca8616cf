"""Column functions against brute-force Python on hand-made and random rows."""

import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from spanlake.functions import matching as M
from spanlake.functions import sequences as SQ
from spanlake.functions import spans as SP
from spanlake.functions import text as T


def py_spans(labels):
    out, i = [], 0
    while i < len(labels):
        if labels[i] in (0, 3):
            j = i + 1
            while j < len(labels) and labels[j] == 1:
                j += 1
            out.append((i, j - i, labels[i]))
            i = j
        else:
            i += 1
    return out


def py_first_sep(labels):
    for i in range(len(labels) - 1):
        if labels[i] == 4 and labels[i + 1] != 4:
            return i
    return None


EDGE_LABELS = [[], [4, 4, 4], [2, 2, 1], [1, 0, 1], [0, 0, 1, 3, 1, 1], [4, 4, 0, 1, 1],
               [3], [0], [4, 0], [2, 0, 1, 1, 1, 1, 1]]


def test_extract_spans_edges_and_random(spark):
    rnd = random.Random(7)
    seqs = EDGE_LABELS + [[rnd.choice([0, 1, 1, 2, 3, 4]) for _ in range(rnd.randint(0, 40))]
                          for _ in range(300)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, l array<int>")
    got = {r["id"]: [(x["start"], x["len"], x["tag"]) for x in r["s"]]
           for r in df.select("id", SP.extract_spans("l").alias("s")).collect()}
    for i, s in enumerate(seqs):
        assert got[i] == py_spans(s), s


def test_first_sep_index(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(EDGE_LABELS)], "id int, l array<int>")
    got = {r["id"]: r["p"] for r in df.select("id", SQ.first_sep_index("l").alias("p")).collect()}
    for i, s in enumerate(EDGE_LABELS):
        assert got[i] == py_first_sep(s)


def test_twostep_spans_are_sets_of_provenance(spark):
    seq = [(4, -1, -1), (0, 2, 0), (1, 2, 1), (4, -1, -1), (0, 2, 0), (1, 2, 1), (3, 5, 0)]
    df = spark.createDataFrame([(seq,)], "s array<struct<label:int,block_index:int,block_offset:int>>")
    r = df.select(SP.twostep_spans_to_string(SP.extract_spans_twostep("s")).alias("x")).first()["x"]
    assert r == "2.0,2.1|0;5.0|3"  # the repeated span counts once


@pytest.mark.parametrize("n", [0, 3, 1023, 1024, 1025])
def test_pad_truncate_lengths(spark, n):
    df = spark.createDataFrame([(list(range(n)),)], "a array<int>")
    r = df.select(SQ.pad_truncate("a", 1024, 4).alias("p")).first()["p"]
    assert len(r) == 1024
    assert r[:min(n, 1024)] == list(range(min(n, 1024)))
    assert all(x == 4 for x in r[n:])


def test_segment_ids_and_missing_separator(spark):
    df = spark.createDataFrame([([5, 9, 7, 9, 8],), ([1, 2],)], "ids array<int>")
    r = df.select(SQ.segment_ids("ids", 9).alias("s")).collect()
    assert r[0]["s"] == [0, 0, 1, 1, 1]
    assert r[1]["s"] is None


def test_argmax_lowest_index_wins(spark):
    df = spark.createDataFrame([([[0.1, 0.5, 0.5], [2.0, 1.0, 0.0]],)], "l array<array<double>>")
    assert df.select(SQ.argmax_labels("l").alias("a")).first()["a"] == [1, 0]


def test_regroup(spark):
    df = spark.createDataFrame([(list("abcdefgh"),)], "c array<string>")
    assert df.select(SQ.regroup("c", 4).alias("g")).first()["g"] == [list("abcd"), list("efgh")]


def test_sanitize_blocks(spark):
    blocks = ["a\n\nb\n", "", "  \nc"]
    df = spark.createDataFrame([(blocks,)], "c array<string>")
    got = df.select(T.sanitize_blocks("c").alias("s")).first()["s"]
    want = "".join("\n".join(line for line in b.split("\n") if line) + "\n" for b in blocks)
    assert got == want


def test_strip_matches_python(spark):
    vals = ["  a b  ", "\t\nx\r\n", "", None, " y ", "\x1cz\x1f", "no"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r["s"] for r in df.select(T.strip_text("v").alias("s")).collect()]
    assert got == [("" if v is None else v.strip()) for v in vals]


def test_model_alias(spark):
    df = spark.createDataFrame([("gpt-4",), ("gpt-35-turbo",), ("other",)], "m string")
    got = [r["t"] for r in df.select(T.model_alias("m").alias("t")).collect()]
    assert got == ["gpt-3.5-turbo", "gpt-3.5-turbo", "other"]


def test_render_prompt_loop_and_missing(spark):
    tpl = "Q {{ a }}\n{% for s in xs %}\n{{s}}\n{% endfor %}\nend {{ missing }}!\n"
    df = spark.createDataFrame([("A", ["x", "y"])], "a string, xs array<string>")
    got = df.select(T.render_prompt(tpl, {"a": F.col("a"), "xs": F.col("xs")}).alias("p")).first()["p"]
    assert got == "Q A\n\nx\n\ny\n\nend !"


def py_fuzzy(a, b):
    if a.strip() == b.strip():
        return True
    if not a:
        return False
    m = difflib.SequenceMatcher(None, a, b).find_longest_match()
    return m.size / len(a) > 0.9 and m.size / len(b) > 0.9


def test_span_match_against_difflib(spark):
    rnd = random.Random(11)
    pairs = [("", "x"), ("N/A", "N/A"), (" ab ", "ab"), ("a" * 10, "a" * 9), ("a" * 20, "a" * 19)]
    for _ in range(400):
        base = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 60)))
        other = list(base)
        for _ in range(rnd.randint(0, 4)):
            op = rnd.random()
            if op < 0.4 and other:
                other.pop(rnd.randrange(len(other)))
            elif op < 0.8:
                other.insert(rnd.randrange(len(other) + 1), rnd.choice("abcxyz"))
            elif other:
                other[rnd.randrange(len(other))] = "q"
        pairs.append((base, "".join(other)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r["m"] for r in df.select(M.span_match("a", "b").alias("m")).collect()]
    assert got == [py_fuzzy(a, b) for a, b in pairs]


def test_pass_at_k_against_binomial(spark):
    rows = [(c, k) for c in range(11) for k in (1, 2, 5, 10)]
    df = spark.createDataFrame(rows, "c int, k int")
    got = [r["p"] for r in df.select(M.pass_at_k_scalar(10, F.col("c"), F.col("k")).alias("p")).collect()]
    for (c, k), p in zip(rows, got):
        want = 1.0 if 10 - c < k else 1 - math.comb(10 - c, k) / math.comb(10, k)
        assert p == pytest.approx(want, abs=1e-12)


def test_token_count_matches_python_regex(spark):
    import re
    texts = ["a, b!", "héllo wörld", "", "x\ty\r\nz__1 +-", "日本語 text"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["n"] for r in df.select(T.token_count("t").alias("n")).collect()]
    assert got == [len(re.findall(T.TOKEN_PATTERN, t)) for t in texts]


def test_same_spans_agrees_with_span_sets(spark):
    rnd = random.Random(21)
    pairs = []
    for _ in range(400):
        a = [rnd.choice([0, 1, 1, 2, 3, 4]) for _ in range(rnd.randint(0, 30))]
        b = list(a)
        if rnd.random() < 0.6 and b:
            b[rnd.randrange(len(b))] = rnd.choice([0, 1, 2, 3, 4])
        if rnd.random() < 0.2:
            b = b + [rnd.choice([2, 4])] * rnd.randint(1, 3)  # trailing outside labels
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a array<int>, b array<int>")
    got = [r["x"] for r in df.select(SP.same_spans("a", "b").alias("x")).collect()]
    assert got == [set(py_spans(a)) == set(py_spans(b)) for a, b in pairs]


def test_legacy_autojunk_matches_difflib_on_long_texts(spark):
    """With legacy_autojunk the count equals the benchmark's difflib-based count, also for
    texts of 200+ characters where the default (true longest block) may accept more."""
    from spanlake.operators.aggregates import match_count
    rnd = random.Random(17)
    rows = []
    for i in range(60):
        base = "".join(rnd.choice("ab e") for _ in range(rnd.randint(150, 400)))
        cands = []
        for j in range(10):
            c = list(base)
            for _ in range(rnd.randint(0, 6)):
                c.insert(rnd.randrange(len(c) + 1), rnd.choice("abz"))
            cands.append("".join(c) if j != 9 else "  ")
        rows.append((i, base, *cands))
    cols = "i int, ans_spans string, " + ", ".join(f"ans_{j} string" for j in range(10))
    df = spark.createDataFrame(rows, cols)
    legacy = {r["i"]: r["c"] for r in match_count(df, legacy_autojunk=True).select("i", "c").collect()}
    native = {r["i"]: r["c"] for r in match_count(df).select("i", "c").collect()}
    for i, a, *cs in rows:
        want = sum(1 for c in cs if c.strip() and py_fuzzy(a, c))
        assert legacy[i] == want
        assert native[i] >= want
