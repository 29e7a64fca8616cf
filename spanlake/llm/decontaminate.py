"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are reduced to words (ASCII letters lower-cased; digits, ``a-z`` and every
non-ASCII character are word characters) joined by single blanks.  The patterns are
all windows of ``window`` consecutive item words (a shorter item is one window), each
between blanks.  A pattern class holds patterns of similar length; per class a block shift
table skips positions where no pattern can end, the last block of a window's first ``m``
bytes selects a bucket of patterns, and direct comparison confirms an occurrence.

Patterns are processed in blocks of at most ``block_windows`` windows.  The benchmark passes
through the driver one partition and one block at a time; every block after the first is a
pass of its own over the documents, stored with the hits so far.

Defined results: null, empty or word-free texts have no words and no hits; items without
words never occur; equal items are all reported; a null item id counts as the empty
string; repeated document rows are judged one by one; further columns of the inputs are
ignored (``remove_contaminated`` passes them through, whatever their names).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import materialize, python_ready, table

WINDOW = 10
BLOCK_WINDOWS = 50_000
#: Longest shift block in bytes.
BLOCK_BYTES = 8

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
              for b in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(_FOLD).split()


def windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    """The distinct patterns of one item."""
    w = words(text)
    if not w:
        return []
    return list(dict.fromkeys(b" " + b" ".join(w[i:i + window]) + b" " for i in range(max(1, len(w) - window + 1))))


class WuManber:
    """Search for patterns of one length class; ``find`` gives (start, pattern index)."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.b = b = min(BLOCK_BYTES, m)
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[int]] = {}
        for k, p in enumerate(patterns):
            for end in range(b, m + 1):
                block = p[end - b:end]
                self.shift[block] = min(self.shift.get(block, m), m - end)
            self.buckets.setdefault(p[m - b:m], []).append(k)

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        m, b, patterns, buckets = self.m, self.b, self.patterns, self.buckets
        get, far, end, n = self.shift.get, self.m - self.b + 1, self.m, len(text)
        while end <= n:
            block = text[end - b:end]
            step = get(block, far)
            if step:
                end += step
                continue
            for k in buckets[block]:
                if text.startswith(patterns[k], end - m):
                    yield end - m, k
            end += 1


def searchers(patterns: list[bytes]) -> list[tuple[WuManber, list[int]]]:
    """One searcher per power-of-two length class, so that short items don't shorten the
    shifts of long ones; with the index of each of its patterns."""
    classes: dict[int, list[int]] = {}
    for k, p in enumerate(patterns):
        classes.setdefault(len(p).bit_length(), []).append(k)
    return [(WuManber([patterns[k] for k in ks]), ks) for ks in classes.values()]


def item_blocks(bench: DataFrame, window: int, block_windows: int) -> Iterator[dict[bytes, list[str]]]:
    """Blocks of at most ``block_windows`` (pattern, item) pairs, read one partition at a time."""
    block: dict[bytes, list[str]] = {}
    held = 0
    rows = bench.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    for r in rows.toLocalIterator():
        for p in windows(r["t"], window):
            block.setdefault(p, []).append(r["i"] or "")
            held += 1
            if held >= block_windows:
                yield block
                block, held = {}, 0
    if block:
        yield block


def _scan(block: dict[bytes, list[str]], text_col: int) -> Callable:
    """A pass over Arrow batches that adds one block's hits to the state of each row: the
    hit words as a bitmap, and the items met."""

    def run(batches):
        patterns = list(block)
        found = searchers(patterns)
        for batch in batches:
            texts = batch.column(text_col)
            old_hit, old_items = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            hits, items = [], []
            for r in range(batch.num_rows):
                text = b" " + b" ".join(words(texts[r].as_py())) + b" "
                got = [(at, ks[k]) for wm, ks in found for at, k in wm.find(text)]
                if not got:
                    hits.append(old_hit[r].as_py())
                    items.append(old_items[r].as_py())
                    continue
                blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                step = np.zeros(len(blanks) + 1, np.int64)
                first = np.searchsorted(blanks, [at for at, _ in got])
                last = np.searchsorted(blanks, [at + len(patterns[k]) - 1 for at, k in got])
                np.add.at(step, first, 1)
                np.add.at(step, last, -1)
                bits = np.packbits(np.cumsum(step)[:len(blanks) - 1] > 0)
                if old := old_hit[r].as_py():
                    bits |= np.frombuffer(old, np.uint8)
                hits.append(bits.tobytes())
                items.append(sorted({i for _, k in got for i in block[patterns[k]]} | set(old_items[r].as_py() or [])))
            cols = [batch.column(c) for c in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)

    return run


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def scan(docs: DataFrame, bench: DataFrame, text: str = "text", window: int = WINDOW,
         block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with two more columns at the end: the bitmap of hit words (null if none) and
    the ids met.  Every further block of patterns is a pass of its own over stored rows, so
    a task and the driver hold one block at a time."""
    python_ready(docs)
    out = docs.withColumns({_free(docs, "_hit"): F.lit(None).cast("binary"), _free(docs, "_items"): F.lit(None).cast("array<string>")})
    at = out.columns.index(text)
    for k, block in enumerate(item_blocks(bench, window, block_windows)):
        out = (materialize(out, "benchmark-hits") if k else out).mapInArrow(_scan(block, at), out.schema)
    return out


def _report(batches):
    for batch in batches:
        ids, texts, hits, items = (batch.column(c) for c in range(4))
        n_words, n_hit, n_items, shas = [], [], [], []
        for r in range(batch.num_rows):
            n_words.append(len(words(texts[r].as_py())))
            h, i = hits[r].as_py(), items[r].as_py() or []
            n_hit.append(int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) if h else 0)
            n_items.append(len(i))
            shas.append(hashlib.sha256(",".join(sorted(i)).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()),
             pa.array(shas, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: words, hit words, items met, their digest, and the verdict."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                 bench, window=window, block_windows=block_windows)
    return found.mapInArrow(
        _report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of any item occurs, with their own columns."""
    found = scan(docs, bench, window=window)
    return found.where(F.col(found.columns[-2]).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
        CAST([] AS VARCHAR[])) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
          FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT rid, i, n, item FROM grams JOIN win USING (n, s)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
met AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN met USING (rid)"""
