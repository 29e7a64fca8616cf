"""Token / label sequence helpers over ``array<int>`` columns (one row per sequence)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the labelling scheme --------------------------------------
LABEL_BEGIN = 0      # "B": opens an answer span
LABEL_INSIDE = 1     # "I": continues a span
LABEL_OUTSIDE = 2    # "O"
LABEL_ALT_BEGIN = 3  # "F": opens a supporting-fact span
LABEL_PAD = 4        # query prefix, separators and padding
SEP_TOKEN = "[SEP]_"
UNK_TOKEN = "[UNK]_"
SPAN_MAX_LEN = 1024
RELEVANCE_MAX_LEN = 512
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_sep_index(labels) -> Column:
    """0-based index of the first pad label followed by a non-pad label; null if none."""
    l = _c(labels)
    # pairs (l[i], l[i+1]) by zipping with the shifted array: no element access inside a
    # lambda, so an expression argument is evaluated once per row
    flags = F.zip_with(l, F.slice(l, 2, F.greatest(F.size(l) - 1, F.lit(0))),
                       lambda a, b: (a == LABEL_PAD) & (b != LABEL_PAD))
    p = F.array_position(flags, F.lit(True))
    return F.when(p > 0, (p - 1).cast("int"))


def segment_ids(ids, sep_id) -> Column:
    """0 up to and including the first separator id, 1 after; null when no separator."""
    a = _c(ids)
    p = F.array_position(a, sep_id if isinstance(sep_id, Column) else F.lit(sep_id)).cast("int")
    return F.when(p > 0, F.concat(F.array_repeat(F.lit(0), p), F.array_repeat(F.lit(1), F.size(a) - p)))


def input_mask(ids) -> Column:
    return F.array_repeat(F.lit(1), F.size(_c(ids)))


def pad_truncate(arr, max_len: int, fill: int) -> Column:
    """Right-pad with ``fill`` to ``max_len``; cut longer arrays."""
    a = _c(arr)
    pad = F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(max_len) - F.size(a)))
    return F.slice(F.concat(a, pad), 1, max_len)


def argmax_labels(logits) -> Column:
    """Position-wise argmax of ``array<array<double>>`` (lowest index wins ties)."""
    return F.transform(_c(logits), lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def regroup(choices, n: int) -> Column:
    """Cut a flat array into consecutive groups of ``n``."""
    a = _c(choices)
    m = F.floor(F.size(a) / n).cast("int")
    return F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1),
                                     lambda j: F.slice(a, j * n + 1, F.lit(n)))
                  ).otherwise(F.array())
