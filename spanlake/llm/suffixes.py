"""Removal of repeated substrings by deep-shallow suffix sorting.

A byte is removed if it lies in a string of ``length`` bytes that also starts in a document
with a smaller id.  Every such string has an anchor, the leftmost least hash among its
``GRAM``-byte grams, which depends on the string alone; equal strings thus share anchor and
offset, and only strings around equal anchor grams need to be sorted together.

1. Documents are packed into compressed blocks, whose anchors are found in numpy.  Grams
   are dealt by hash, to learn which occur in several documents.
2. Each block sends, for its anchors with shared grams, the context (all strings with that
   anchor, as one piece of text) to the gram's bucket; equal contexts of one block once,
   with their least doc_id.  A bucket merges equal contexts, so groups of copies cost one
   context per block.  Where a gram has several contexts left, the suffixes (strings) are
   sorted: multikey quicksort on 8-byte words to a shallow depth, then a blind trie orders
   each group with a longer common prefix; leaves with equal strings give the least doc_id.
   The bucket answers with one bit for each string.
3. Around a hot gram (more than ``HOT`` contexts over all blocks: the edges of a passage
   that many documents share, runs of blanks) contexts are no longer dealt by gram.  Their
   strings are dealt by the hash of all their bytes, equal ones of one block once with their
   least doc_id, so a gram spreads over all buckets and equal strings still meet.
4. The block marks the bytes of repeated strings.

Defined results: null and empty texts have no bytes and no spans; texts shorter than
``length`` keep everything; rows with one id are never compared with each other; rows
without id take no part and keep everything; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import doc_ranges, materialize, python_ready, shuffle_partitions, table, utf8
from spanlake.llm.shingles import mix

LENGTH = 50
GRAM = 20
#: Strings per anchor at most.
SPAN = LENGTH - GRAM + 1
BLOCK_BYTES = 8 << 20
SHALLOW_WORDS = 3
SMALL_SEGMENT = 4096
#: Contexts (summed over the blocks) above which a gram's strings are dealt by their bytes.
HOT = 4096
#: Contexts of cold grams sorted together, and hot strings compared together.
SORT_CONTEXTS = 4096
SORT_STRINGS = 1 << 16

_SEEDS = np.random.default_rng(20).integers(0, 1 << 64, (2, 7), dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: (gram hash, context hash, first start, last start,
    anchor, document); positions count from the start of ``data``."""
    parts = []
    for i, j in doc_ranges(offsets):
        base = offsets[i]
        text = data[base:offsets[j]]
        n = len(text)
        if n < LENGTH:
            continue
        up, down = _powers(max(1 << 21, 1 << int(n + 1).bit_length()))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        gram = mix((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1])
        # least hash, leftmost among equals: one number holds the hash's upper half and the position
        value = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while width < SPAN:
            step = min(width, SPAN - width)
            value = np.minimum(value[step:], value[:-step])
            width += step
        at = (value & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ends = offsets[i + 1:j + 1] - base
        doc = np.repeat(np.arange(i, j), np.diff(offsets[i:j + 1]))
        start = np.flatnonzero(np.arange(len(value)) + LENGTH <= ends[doc[:len(value)] - i])
        if not len(start):
            continue
        a, d = at[start], doc[start]
        head = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
        first = start[head]
        last = start[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(start) - 1]])]
        a, d = a[head], d[head]
        context = mix((total[last + LENGTH] - total[first]) * down[first] + mix((a - first).astype(np.uint64) * np.uint64(64) + (last - first).astype(np.uint64)))
        parts.append((gram[a], context, first + base, last + base, a + base, d))
    if not parts:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Block:
    """A block's texts with their anchors, in a fixed order."""

    def __init__(self, docs: list, lengths: bytes, body: bytes):
        length = np.frombuffer(lengths, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(length)])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=int(self.offsets[-1]) + 1), np.uint8)
        self.named = np.array([d is not None for d in docs], bool)
        self.ids = np.array([0 if d is None else d for d in docs], np.int64)
        gram, context, first, last, at, doc = anchors(self.data, self.offsets)
        if not self.named.all():
            keep = self.named[doc]
            gram, context, first, last, at, doc = (x[keep] for x in (gram, context, first, last, at, doc))
        order = np.lexsort((self.ids[doc], context, gram))
        self.gram, self.context, self.first, self.last, self.at, self.doc = (x[order] for x in (gram, context, first, last, at, doc))
        self.id = self.ids[self.doc]
        new = np.concatenate([[True], self.gram[1:] != self.gram[:-1]]) if len(order) else np.zeros(0, bool)
        self.of_gram = np.cumsum(new) - 1
        self.grams = self.gram[new]
        starts = np.flatnonzero(new)
        if len(starts):
            self.several = np.minimum.reduceat(self.id, starts) != np.maximum.reduceat(self.id, starts)
            here = np.concatenate([[True], (self.gram[1:] != self.gram[:-1]) | (self.context[1:] != self.context[:-1])])
            self.contexts = np.minimum(np.add.reduceat(here, starts, dtype=np.int64), 65535).astype(np.uint16)
        else:
            self.several, self.contexts = np.zeros(0, bool), np.zeros(0, np.uint16)

    def shared(self, answers: list[tuple[int, bytes]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which grams occur in several documents and are not hot, and which are hot, from the
        answers of the buckets."""
        order, bounds = _by_bucket(self.grams, n)
        got = dict(answers)
        out, hot = self.several.copy(), np.zeros(len(self.grams), bool)
        for k in range(n):
            own = order[bounds[k]:bounds[k + 1]]
            if len(own):
                bits = np.frombuffer(got[k], np.uint8).reshape(2, -1)
                out[own] |= np.unpackbits(bits[0], count=len(own)).astype(bool)
                hot[own] = np.unpackbits(bits[1], count=len(own)).astype(bool)
        return out & ~hot, out & hot

    def entries(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows with shared grams, the number of each row's entry): an entry is a distinct
        context, its first row has the least doc_id."""
        rows = np.flatnonzero(shared[self.of_gram])
        g, c = self.gram[rows], self.context[rows]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]) if len(rows) else np.zeros(0, bool)
        return rows, np.cumsum(new) - 1

    def strings(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All strings with hot grams: (start, doc_id, hash, number of the distinct string), in
        an order where equal strings are neighbours, the least doc_id first."""
        rows = np.flatnonzero(hot[self.of_gram])
        count = self.last[rows] - self.first[rows] + 1
        start = np.repeat(self.first[rows] - np.cumsum(count) + count, count) + np.arange(count.sum())
        id_ = np.repeat(self.id[rows], count)
        hashes = np.empty((2, len(start)), np.uint64)
        for i in range(0, len(start), SORT_STRINGS):
            text = _windows(self.data, start[i:i + SORT_STRINGS])
            words = np.column_stack([np.ascontiguousarray(text[:, :48]).view(np.uint64), np.ascontiguousarray(text[:, -8:]).view(np.uint64)])
            for h, seeds in zip(hashes, _SEEDS, strict=True):
                x = np.zeros(len(words), np.uint64)
                for k, seed in enumerate(seeds):
                    x = mix(x + (words[:, k] ^ seed))
                h[i:i + SORT_STRINGS] = x
        order = np.lexsort((id_, hashes[1], hashes[0]))
        h = hashes[:, order]
        new = np.concatenate([[True], (h[:, 1:] != h[:, :-1]).any(axis=0)]) if len(order) else np.zeros(0, bool)
        return start[order], id_[order], h[0], np.cumsum(new) - 1


def _windows(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The strings that start at ``start``, as rows of bytes."""
    if not len(start):
        return np.zeros((0, LENGTH), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, LENGTH)[start]


def _by_bucket(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (h % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _pack(batches):
    squeeze = zstandard.ZstdCompressor(level=3)

    def close():
        body = b"".join(texts)
        length = np.array([len(x) for x in texts], np.int64).tobytes()
        name = f"{xxhash.xxh3_64_hexdigest(body)}-{xxhash.xxh3_64_hexdigest(repr(docs).encode())}-{seq}"
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([docs], pa.list_(pa.int64())), pa.array([length]), pa.array([squeeze.compress(body)])],
            names=["block", "docs", "lengths", "body"])

    docs, texts, size, seq = [], [], 0, 0
    for b in batches:
        data, offsets = utf8(b.column(1))
        for k, doc in enumerate(b.column(0).to_pylist()):
            docs.append(doc)
            texts.append(data[offsets[k]:offsets[k + 1]].tobytes())
            size += len(texts[-1])
            if size >= BLOCK_BYTES or len(docs) >= 20_000:
                yield close()
                docs, texts, size, seq = [], [], 0, seq + 1
    if docs:
        yield close()


def _rows(batches):
    """The rows of Arrow batches of blocks, one at a time."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _send_grams(n):
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for r in _rows(batches):
            block = Block(r["docs"], r["lengths"], r["body"])
            order, at = _by_bucket(block.grams, n)
            g, s, c = block.grams[order], block.several[order], block.contexts[order]
            full = np.flatnonzero(at[1:] > at[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["block"]] * len(full), pa.string()), pa.array(full.astype(np.int32)),
                 pa.array([g[at[k]:at[k + 1]].tobytes() for k in full], pa.binary()),
                 pa.array([np.packbits(s[at[k]:at[k + 1]]).tobytes() for k in full], pa.binary()),
                 pa.array([squeeze.compress(c[at[k]:at[k + 1]].tobytes()) for k in full], pa.binary())],
                names=["block", "bucket", "grams", "several", "contexts"])

    return run


def _find_shared(limit):
    def run(t: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(g)) for g, x in zip(grams, t["several"].to_pylist(), strict=True)]
        unpack = zstandard.ZstdDecompressor()
        contexts = [np.frombuffer(unpack.decompress(x), np.uint16) for x in t["contexts"].to_pylist()]
        _, at, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        shared = (count > 1) | (np.bincount(at, np.concatenate(several)) > 0)
        hot = np.bincount(at, np.concatenate(contexts)) > limit
        ends = np.cumsum([len(g) for g in grams])
        return pa.table({"block": t["block"], "bucket": t["bucket"], "answer": pa.array(
            [b"".join(np.packbits(x[at[z - len(g):z]]).tobytes() for x in (shared, hot)) for g, z in zip(grams, ends, strict=True)], pa.binary())})

    return run


def _answers(t: pa.Table, column: str) -> list[tuple[int, bytes]]:
    return list(zip(t["bucket"].to_pylist(), t[column].to_pylist(), strict=True))


def _send_contexts(n):
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        r = t.to_pylist()[0]
        block = Block(r["docs"], r["lengths"], r["body"])
        cold, hot = block.shared(_answers(replies, "answer"), n)
        rows, entry = block.entries(cold)
        head = rows[np.concatenate([[True], entry[1:] != entry[:-1]])] if len(rows) else rows
        order, at = _by_bucket(block.gram[head], n)
        squeeze = zstandard.ZstdCompressor(level=3)
        out = []
        for k in np.flatnonzero(at[1:] > at[:-1]):
            own = head[order[at[k]:at[k + 1]]]
            first, last = block.first[own], block.last[own] + LENGTH
            text = b"".join(block.data[a:z].tobytes() for a, z in zip(first, last, strict=True))
            shape = np.column_stack([block.at[own] - first, block.last[own] - first]).astype(np.uint8)
            out.append((r["block"], int(k), block.gram[own].tobytes(), block.id[own].tobytes(), shape.tobytes(), squeeze.compress(text)))
        start, id_, h, nth = block.strings(hot)
        head = np.flatnonzero(np.concatenate([[True], nth[1:] != nth[:-1]])) if len(nth) else nth
        order, at = _by_bucket(h[head], n)
        for k in np.flatnonzero(at[1:] > at[:-1]):
            own = head[order[at[k]:at[k + 1]]]
            out.append((r["block"], int(k), h[own].tobytes(), id_[own].tobytes(), None, squeeze.compress(_windows(block.data, start[own]).tobytes())))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.string(), pa.int32(), *[pa.binary()] * 4]
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("block", "bucket", "grams", "ids", "shapes", "text"), cols, kinds, strict=True)})

    return run


class BlindTrie:
    """Orders strings of one length by a trie that keeps, in each node, only the depth at
    which its strings part; a string is compared with one leaf to find where it differs."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: tuple | list = [first]

    def insert(self, k: int) -> None:
        s, strings = self.strings[k], self.strings
        node = self.root
        while isinstance(node, tuple):  # blind descent
            depth, kids = node
            node = kids.get(s[depth]) or next(iter(kids.values()))
        t = strings[node[0]]
        if s == t:
            node.append(k)
            return
        differ = next(i for i, (x, y) in enumerate(zip(s, t, strict=True)) if x != y)
        parent, edge, node = None, 0, self.root
        while isinstance(node, tuple) and node[0] < differ:
            parent, edge, node = node, s[node[0]], node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == differ:
            node[1][s[differ]] = [k]
            return
        new = (differ, {t[differ]: node, s[differ]: [k]})
        if parent is None:
            self.root = new
        else:
            parent[1][edge] = new

    def leaves(self):
        """Groups of equal strings, in order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node


def shallow_groups(words: np.ndarray):
    """Groups of several rows that agree in all columns of ``words``: multikey quicksort, with
    small segments sorted directly."""
    depth = words.shape[1]
    stack = [(np.arange(len(words)), 0)]
    while stack:
        rows, d = stack.pop()
        if len(rows) == 1:
            continue
        if d == depth:
            yield rows
        elif len(rows) <= SMALL_SEGMENT:
            rows = rows[np.lexsort(tuple(words[rows, c] for c in range(depth - 1, d - 1, -1)))]
            cut = np.flatnonzero((words[rows[1:]] != words[rows[:-1]]).any(axis=1)) + 1
            start, end = np.append(0, cut), np.append(cut, len(rows))
            for a, z in np.column_stack([start, end])[end - start > 1].tolist():
                yield rows[a:z]
        else:
            key = words[rows, d]
            pivot = np.partition(key, len(key) // 2)[len(key) // 2]
            for part, deeper in ((key > pivot, 0), (key == pivot, 1), (key < pivot, 0)):
                if part.any():
                    stack.append((rows[part], d + deeper))


def equal_groups(strings: np.ndarray):
    """Groups (of more than one) of equal rows of a byte matrix, by deep-shallow sorting."""
    wide = SHALLOW_WORDS * 8
    words = np.ascontiguousarray(strings[:, :wide]).view(">u8").astype(np.uint64)
    for rows in shallow_groups(words):
        deep = [strings[k, wide:].tobytes() for k in rows]
        kinds = len(set(deep))
        if kinds == 1:
            yield rows
        if kinds in (1, len(deep)):  # all equal or all different: nothing to order
            continue
        trie = BlindTrie(deep, 0)
        for k in range(1, len(deep)):
            trie.insert(k)
        for leaf in trie.leaves():
            if len(leaf) > 1:
                yield rows[leaf]


def _judge_bucket(t: pa.Table) -> pa.Table:
    """For each entry one bit per string: does it start in a document with a smaller id?  Rows
    without shapes hold hot strings, which get one bit each."""
    hot = pa.compute.is_null(t["shapes"])
    answers = [_judge_contexts(t.filter(pa.compute.invert(hot))), _judge_strings(t.filter(hot))]
    return pa.concat_tables(x for x in answers if x.num_rows).combine_chunks()


def _judge_strings(t: pa.Table) -> pa.Table:
    if not t.num_rows:
        return t
    unpack = zstandard.ZstdDecompressor()
    hashes = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()]
    sizes = [len(x) for x in hashes]
    h, id_ = np.concatenate(hashes), np.concatenate([np.frombuffer(x, np.int64) for x in t["ids"].to_pylist()])
    data = np.frombuffer(b"".join(unpack.decompress(x.as_py(), max_output_size=k * LENGTH) for x, k in zip(t["text"], sizes, strict=True)),
                         np.uint8).reshape(-1, LENGTH)
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    group = np.cumsum(new) - 1
    heads = order[new]
    least = np.minimum.reduceat(id_[order], np.flatnonzero(new))
    repeated = np.zeros(len(h), bool)
    repeated[order] = id_[order] > least[group]
    # one hash is nearly always one string; where it is not, the bytes decide
    mixed = np.zeros(len(heads), bool)
    for i in range(0, len(order), SORT_STRINGS):
        own, of = order[i:i + SORT_STRINGS], group[i:i + SORT_STRINGS]
        mixed[of[(data[own] != data[heads[of]]).any(axis=1)]] = True
    for k in np.flatnonzero(mixed):
        own = order[np.searchsorted(group, k):np.searchsorted(group, k, side="right")]
        repeated[own] = False
        for rows in equal_groups(data[own]):
            repeated[own[rows]] = id_[own[rows]] > id_[own[rows]].min()
    return _bits(t, sizes, repeated)


def _bits(t: pa.Table, sizes: list[int], repeated: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    return pa.table({"block": t["block"], "bucket": t["bucket"], "hot": pa.array([True] * len(sizes)),
                     "answer": pa.array([np.packbits(repeated[z - k:z]).tobytes() for k, z in zip(sizes, ends, strict=True)], pa.binary())})


def _judge_contexts(t: pa.Table) -> pa.Table:
    if not t.num_rows:
        return t
    sizes, grams, ids, shapes, texts = [], [], [], [], []
    unpack = zstandard.ZstdDecompressor()
    for r in t.select(["grams", "ids", "shapes", "text"]).to_pylist():
        g, shape = np.frombuffer(r["grams"], np.uint64), np.frombuffer(r["shapes"], np.uint8).reshape(-1, 2)
        sizes.append(len(g))
        grams.append(g)
        ids.append(np.frombuffer(r["ids"], np.int64))
        shapes.append(shape)
        texts.append(unpack.decompress(r["text"], max_output_size=int((shape[:, 1].astype(np.int64) + LENGTH).sum())))
    gram, id_, shape, text = np.concatenate(grams), np.concatenate(ids), np.concatenate(shapes).astype(np.int64), b"".join(texts)
    ends = np.cumsum(shape[:, 1] + LENGTH)
    starts = ends - shape[:, 1] - LENGTH
    # equal contexts are one, with their least doc_id
    of: dict = {}
    context = np.fromiter((of.setdefault((g, x, text[a:z]), len(of)) for g, x, a, z in zip(
        gram.tolist(), shape[:, 0].tolist(), starts.tolist(), ends.tolist(), strict=True)), np.int64, len(gram))
    n = len(of)
    del of
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, context, id_)
    some = np.zeros(n, np.int64)
    some[context] = np.arange(len(gram))
    by_gram = np.argsort(gram[some], kind="stable")
    g = gram[some][by_gram]
    alone = np.concatenate([[True], g[1:] != g[:-1]]) & np.concatenate([g[1:] != g[:-1], [True]])
    several = by_gram[~alone]
    repeated = np.zeros(n, np.uint32)
    data = np.frombuffer(text, np.uint8)
    if len(several):
        # contexts of one gram stay together (they are few, or the gram is hot): cut only between grams
        cuts = np.flatnonzero(np.concatenate([[True], gram[some[several]][1:] != gram[some[several]][:-1]]))
        at = 0
        while at < len(several):
            z = np.searchsorted(cuts, at + SORT_CONTEXTS)
            end = int(cuts[z]) if z < len(cuts) else len(several)
            own = several[at:end]
            at = end
            count = shape[some[own], 1] + 1
            which = np.repeat(np.arange(len(own)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            strings = _windows(data, starts[some[own]][which] + nth)
            for rows in equal_groups(strings):
                c = own[which[rows]]
                low = least[c].min()
                for k, j in zip(c[least[c] > low], nth[rows][least[c] > low], strict=True):
                    repeated[k] |= np.uint32(1 << int(j))
    every = np.uint32(0xFFFFFFFF)
    answer = np.where(id_ > least[context], every, repeated[context])
    bounds = np.cumsum(sizes)
    return pa.table({"block": t["block"], "bucket": t["bucket"], "hot": pa.array([False] * len(sizes)),
                     "answer": pa.array([answer[z - k:z].tobytes() for k, z in zip(sizes, bounds, strict=True)], pa.binary())})


def _finish(n):
    def run(t: pa.Table, shared: pa.Table, judged: pa.Table) -> pa.Table:
        r = t.to_pylist()[0]
        block = Block(r["docs"], r["lengths"], r["body"])
        cold, hot = block.shared(_answers(shared, "answer"), n)
        rows, entry = block.entries(cold)
        marks = np.zeros(len(block.data) + 1, np.int32)
        if len(rows):
            head = rows[np.concatenate([[True], entry[1:] != entry[:-1]])]
            order, at = _by_bucket(block.gram[head], n)
            mask, got = np.zeros(len(head), np.uint32), dict(_answers(judged.filter(pa.compute.invert(judged["hot"])), "answer"))
            for k in np.flatnonzero(at[1:] > at[:-1]):
                mask[order[at[k]:at[k + 1]]] = np.frombuffer(got[k], np.uint32)
            bits = np.where(block.id[rows] > block.id[head][entry], np.uint32(0xFFFFFFFF), mask[entry])
            first, last = block.first[rows], block.last[rows]
            some = ((np.uint32(2) << (last - first).astype(np.uint32)) - np.uint32(1)).astype(np.uint32)
            whole = (bits & some) == some
            np.add.at(marks, first[whole], 1)
            np.add.at(marks, last[whole] + LENGTH, -1)
            part = np.flatnonzero(~whole & ((bits & some) != 0))
            for j in range(SPAN):
                on = part[(bits[part] >> np.uint32(j) & np.uint32(1)).astype(bool) & (first[part] + j <= last[part])]
                np.add.at(marks, first[on] + j, 1)
                np.add.at(marks, first[on] + j + LENGTH, -1)
        start, id_, h, nth = block.strings(hot)
        if len(start):
            head = np.flatnonzero(np.concatenate([[True], nth[1:] != nth[:-1]]))
            order, at = _by_bucket(h[head], n)
            bit, got = np.zeros(len(head), bool), dict(_answers(judged.filter(judged["hot"]), "answer"))
            for k in np.flatnonzero(at[1:] > at[:-1]):
                own = order[at[k]:at[k + 1]]
                bit[own] = np.unpackbits(np.frombuffer(got[k], np.uint8), count=len(own)).astype(bool)
            on = start[bit[nth] | (id_ > id_[head][nth])]
            np.add.at(marks, on, 1)
            np.add.at(marks, on + LENGTH, -1)
        gone = np.cumsum(marks[:-1]) > 0
        kept, removed, spans, size = [], [], [], np.diff(block.offsets)
        for a, z in zip(block.offsets[:-1], block.offsets[1:], strict=True):
            x = gone[a:z]
            removed.append(int(x.sum()))
            spans.append(int(x[:1].sum() + (x[1:] & ~x[:-1]).sum()))
            kept.append(block.data[a:z][~x].tobytes())
        return r["docs"], size, removed, spans, kept

    return run


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _reports(n):
    finish = _finish(n)

    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        kind = np.asarray(replies["kind"])
        docs, size, removed, spans, kept = finish(t, replies.filter(pa.array(kind == 0)), replies.filter(pa.array(kind == 1)))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "n_bytes": pa.array(size, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                         "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                         "kept": pa.array(kept, pa.binary())})

    return run


def remove_repeats(docs: DataFrame, text: bool = False, hot: int = HOT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): sizes, removed bytes and spans, digest of the kept
    bytes, and with ``text`` the kept bytes.  Grams with more than ``hot`` contexts (at most
    65,534) are dealt by string."""
    python_ready(docs)
    n = shuffle_partitions(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = materialize(base.mapInArrow(_pack, "block string, docs array<long>, lengths binary, body binary")
                         .withColumn("block", F.concat("block", F.lit("-"), F.spark_partition_id().cast("string"))), "repeat-blocks")
    sent = packed.mapInArrow(_send_grams(n), "block string, bucket int, grams binary, several binary, contexts binary")
    shared = materialize(sent.groupBy("bucket").applyInArrow(_find_shared(hot), "block string, bucket int, answer binary"), "repeat-grams")
    contexts = packed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        _send_contexts(n), "block string, bucket int, grams binary, ids binary, shapes binary, text binary")
    judged = materialize(contexts.groupBy("bucket").applyInArrow(_judge_bucket, "block string, bucket int, hot boolean, answer binary"), "repeat-answers")
    replies = shared.withColumns({"kind": F.lit(0), "hot": F.lit(False)}).unionByName(judged.withColumn("kind", F.lit(1)))
    out = packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_reports(n), SCHEMA + ", kept binary")
    return out if text else out.drop("kept")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
