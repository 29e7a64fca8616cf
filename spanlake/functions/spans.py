"""Span extraction from label sequences and span-set comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _span_parts(l: Column) -> tuple[Column, Column]:
    """(span starts, span run strings) of a label array, aligned by position."""
    runs = F.regexp_extract_all(F.array_join(l.cast("array<string>"), ""), F.lit("[03]1*"), F.lit(0))
    starts = F.array_compact(F.transform(l, lambda x, i: F.when((x == 0) | (x == 3), i)))
    return starts, runs


def same_spans(a, b) -> Column:
    """True iff two label arrays have the same span set.  A span set is fully given by the
    aligned (starts, runs) lists - a run string carries tag and length - so the lists are
    compared directly, without building span structs."""
    sa, ra = _span_parts(_c(a))
    sb, rb = _span_parts(_c(b))
    return (sa == sb) & (ra == rb)


def extract_spans(labels) -> Column:
    """Spans of a label array: a 0 or 3 followed by a maximal run of 1.

    Returns ``array<struct<start:int,len:int,tag:int>>`` in start order (so two span
    sets are equal iff the arrays are equal).  Labels are single digits, so the runs come
    from one native regex pass over the digit string (built by a native array cast), and
    the starts from one lambda pass plus the native ``array_compact``; the two lists are
    zipped, and the tag is the run's first digit.  Lambdas run interpreted, so the number
    of per-element lambda passes is what this keeps small.  The input only appears as a
    function argument, so an expression input is evaluated once per row."""
    starts, runs = _span_parts(_c(labels))
    return F.zip_with(starts, runs, lambda s, r: F.struct(
        s.cast("int").alias("start"),
        F.length(r).cast("int").alias("len"),
        F.substring(r, 1, 1).cast("int").alias("tag")))


def extract_block_spans(labels, blocks) -> Column:
    """Spans of a label array with the block id of every position: what the span is known by is
    its list of (block, position), so equal labels at other blocks are other spans.

    Returns ``array<struct<start:int,len:int,tag:int,blocks:array<int>>>`` in start order; null
    where the two arrays differ in length."""
    l, b = _c(labels), _c(blocks)
    return F.when(F.size(l) == F.size(b), F.transform(extract_spans(l), lambda s: F.struct(
        s["start"].alias("start"), s["len"].alias("len"), s["tag"].alias("tag"),
        F.slice(b, s["start"] + 1, s["len"]).cast("array<int>").alias("blocks"))))


def extract_spans_twostep(seq) -> Column:
    """Spans over ``array<struct<label,block_index,block_offset>>`` identified by provenance.

    Returns a sorted, distinct ``array<struct<tag:int, items:array<struct<block_index:int,
    block_offset:int>>>>``."""
    s = _c(seq)
    base = extract_spans(F.transform(s, lambda x: x["label"]))
    spans = F.transform(base, lambda sp: F.struct(
        sp["tag"].alias("tag"),
        F.transform(F.slice(s, sp["start"] + 1, sp["len"]), lambda x: F.struct(
            x["block_index"].cast("int").alias("block_index"),
            x["block_offset"].cast("int").alias("block_offset"))).alias("items")))
    return _sorted_set(spans)


def _sorted_set(spans: Column) -> Column:
    """The distinct elements of an array in order.  ``array_distinct`` compares structs all to
    all; here equal neighbours go after the sort.  The one-element array around the sorted
    spans binds them to a lambda variable, so they are sorted once and not per element."""
    return F.get(F.transform(F.array(F.sort_array(spans)), lambda s: F.filter(
        s, lambda x, i: (i == 0) | ~F.equal_null(x, F.get(s, i - 1)))), F.lit(0))


def span_set_equal(a, b) -> Column:
    """Set equality of two span arrays (order and duplicates ignored)."""
    return _sorted_set(_c(a)) == _sorted_set(_c(b))


def spans_to_string(spans) -> Column:
    """``start:len:tag`` items joined with ';' (for reports and oracle checks)."""
    return F.array_join(F.transform(_c(spans), lambda x: F.concat_ws(
        ":", x["start"].cast("string"), x["len"].cast("string"), x["tag"].cast("string"))), ";")


def twostep_spans_to_string(spans) -> Column:
    """Each span as ``bi.bo,bi.bo|tag``; strings sorted and joined with ';'."""
    items = F.transform(_c(spans), lambda sp: F.concat(
        F.array_join(F.transform(sp["items"], lambda it: F.concat_ws(
            ".", it["block_index"].cast("string"), it["block_offset"].cast("string"))), ","),
        F.lit("|"), sp["tag"].cast("string")))
    return F.array_join(F.array_sort(items), ";")
