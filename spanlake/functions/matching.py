"""Candidate-vs-answer matching and the pass@k estimator, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.functions.text import strip_text

# A fuzzy match needs the longest common block to cover more than
# 9/10 of both texts (strict), and logs hold n = 10 candidates.
MATCH_NUM, MATCH_DEN = 9, 10
N_CANDIDATES = 10
PASS_KS = (1, 2, 5, 10)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _prefix(x: str, y: str) -> str:
    """Length of the longest common prefix: blocks of halving size are compared and skipped
    while they are equal, so a pair costs O(n log n) bytes at most, mostly block compares."""
    return f"""aggregate(transform(sequence(int(floor(log2(least(length({x}), length({y})) + 1))), 0, -1), i -> shiftleft(1, i)), 0,
        (got, step) -> if(substring({x}, got + 1, step) = substring({y}, got + 1, step)
                          and length(substring({x}, got + 1, step)) = step, got + step, got))"""


def _pair(x: str, y: str) -> str:
    return f"named_struct('x', {x}, 'y', {y})"


def _before(x: str, end: str) -> str:
    """How far back ``x`` up to ``end`` keeps the period ``v.s``, as a pair of reversed texts."""
    return _pair(f"reverse(left({x}, {end} - v.s))", f"reverse(substring({x}, v.s + 1, {end} - v.s))")


def _after(x: str, start: str) -> str:
    return _pair(f"substring({x}, {start}, length({x}))", f"substring({x}, {start} + v.s, length({x}))")


def _fuzzy() -> str:
    """The lambda over a pair ``t`` (a, b) of fitting lengths; see ``fuzzy_match``."""
    # numbers (from 0) of the occurrences of which one extends furthest
    reach = (f"transform(array({_before('t.a', 'v.p + v.n')}, {_before('t.b', 'v.first - 1 + v.n')}, {_after('t.a', 'v.p + 1')}, "
             f"{_after('t.b', 'v.last')}), z -> {_prefix('z.x', 'z.y')} - (v.n - v.s))")
    turns = _let("r", reach, "array(int(floor((r[0] - r[1]) / v.s)), m - int(floor((r[2] - r[3]) / v.s)))")
    best = _let("m", "int((v.last - v.first) / v.s)", f"if(m = 0, array(0), {_let('u', turns, """
        transform(array(0, m, u[0], u[0] + 1, u[1] - 1, u[1]), k -> greatest(0, least(m, k)))""")})")
    # the common substring that holds the middle at occurrence k
    x = "v.first + k * v.s"
    sides = (f"array({_pair('reverse(left(t.a, v.p))', f'reverse(left(t.b, {x} - 1))')}, "
             f"{_pair('substring(t.a, v.p + v.n + 1, length(t.a))', f'substring(t.b, {x} + v.n, length(t.b))')})")
    extends = f"aggregate({sides}, v.n, (got, z) -> got + {_prefix('z.x', 'z.y')}) >= v.L"
    placed = """if(w.first > 0, named_struct('L', w.L, 'p', w.p, 'n', w.n, 'first', w.first,
        'last', length(t.b) - w.n + 2 - locate(reverse(w.mid), reverse(t.b)),
        's', greatest(1, locate(w.mid, t.b, w.first + 1) - w.first)), null)"""
    found = """named_struct('L', l.L, 'mid', l.mid, 'p', length(t.a) - l.L, 'n', length(l.mid), 'first', locate(l.mid, t.b))"""
    middle = "named_struct('L', g.L, 'mid', substring(t.a, length(t.a) - g.L + 1, 2 * g.L - length(t.a)))"
    size = f"named_struct('L', int(floor({MATCH_NUM} * greatest(length(t.a), length(t.b)) / {MATCH_DEN})) + 1)"
    search = _let("v", placed, f"v is not null and exists({best}, k -> {extends})")
    for name, value in (("w", found), ("l", middle), ("g", size)):
        search = _let(name, value, search)
    return f"t -> {search}"


def fuzzy_match(a, b) -> Column:
    """True iff the longest common substring m of a and b has m/|a| > 0.9 and m/|b| > 0.9.

    With L = floor(9*max(|a|,|b|)/10) + 1 that is: min(|a|,|b|) >= L and some length-L
    substring of ``a`` occurs in ``b``.  Every such substring holds the middle of ``a``,
    a[|a|-L .. L), so the middle is searched in ``b`` and each occurrence is extended to both
    sides.  Occurrences start within a quarter of the middle's length, so several of them form
    one arithmetic progression whose step s is the middle's period.  The extension then only
    depends on how far the period reaches around the middle in ``a`` and around the
    progression in ``b``: it is a concave function of the occurrence, but for the ones at
    which both reach equally far, and six occurrences hold its maximum.  Integer arithmetic
    and built-in functions only."""
    a, b = _c(a), _c(b)
    la, lb = F.length(a), F.length(b)
    least = F.least(la, lb)
    search = F.call_function("transform", F.array(F.struct(a.alias("a"), b.alias("b"))), F.expr(_fuzzy()))
    # equal texts and texts of too different lengths need no search
    return ((least > 0) & (least * MATCH_DEN > F.greatest(la, lb) * MATCH_NUM)
            & ((a == b) | F.element_at(search, 1)))


def span_match(answer, cand) -> Column:
    """Exact after strip, else (non-empty answer) fuzzy on the unstripped texts."""
    a, c = _c(answer), _c(cand)
    return (strip_text(a) == strip_text(c)) | ((F.coalesce(a, F.lit("")) != "") & fuzzy_match(a, c))


def pass_at_k_scalar(n, c, k) -> Column:
    """1 if n-c < k, else 1 - prod_{i=n-c+1..n} (1 - k/i); c = 0 gives 0."""
    n, c, k = (_c(x) if not isinstance(x, int) else F.lit(x) for x in (n, c, k))
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0).cast("double"),
                       lambda acc, i: acc * (F.lit(1.0) - k.cast("double") / i.cast("double")))
    return (F.when(n - c < k, F.lit(1.0))
            .when(c <= 0, F.lit(0.0))
            .otherwise(F.lit(1.0) - prod)).cast("double")


def legacy_confirm(a, c, native: bool) -> bool:
    """difflib's verdict for one pair that the native test accepted (per-row helper)."""
    import difflib
    if not native or a is None or c is None:
        return bool(native)
    if a.strip() == c.strip():
        return True
    m = difflib.SequenceMatcher(None, a, c).find_longest_match()
    return 10 * m.size > 9 * len(a) and 10 * m.size > 9 * len(c)


def match_flags(answer, cands) -> Column:
    """Per candidate: non-blank and matching the answer (``array<boolean>``), native."""
    a, cs = _c(answer), _c(cands)
    return F.transform(cs, lambda c: (strip_text(c) != "") & span_match(a, c))


def with_legacy_flags(df, answer: str, cands: list[str], out_col: str = "_flags"):
    """Add ``out_col``: the benchmark matcher's verdict per candidate for long texts.

    The native test (true longest common substring) runs first in the JVM; only the
    candidates it accepts are re-checked with difflib's default heuristic, which can only
    reject more.  The re-check runs in Arrow batches (``mapInPandas``)."""
    from spanlake.session import ensure_library_on_workers
    ensure_library_on_workers(df.sparkSession)
    staged = df.withColumn(out_col, match_flags(F.col(answer), F.array(*[F.col(c) for c in cands])))
    schema = staged.schema

    def run(batches):
        for b in batches:
            flags = []
            for row_a, row_f, *row_c in zip(b[answer], b[out_col], *[b[c] for c in cands]):
                flags.append(None if row_f is None else
                             [legacy_confirm(row_a, c, bool(f)) for c, f in zip(row_c, row_f)])
            b = b.copy()
            b[out_col] = flags
            yield b
    return staged.mapInPandas(run, schema)
