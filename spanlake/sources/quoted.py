"""Records of quoted CSV text from many tasks per file.

A newline ends a record only outside quotes, and whether a byte range starts inside quotes
depends on all quotes before it.  So lines are read by ranges as usual; a first pass counts
each range's quotes; a running sum over the ranges (one row each) gives the parity at which a
range starts; and a second pass cuts the ranges into records.  A record that crosses ranges
comes as a head, whole middle ranges and a tail, at most two pieces per range, which are put
together afterwards.  No line is shuffled otherwise, and no task holds more than a batch of
lines and one record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.session import ensure_library_on_workers

WHOLE, TAIL, MIDDLE, HEAD = range(4)


def _ranges(batches):
    """The batches cut where the byte range changes: (file, block, quotes per line, batch)."""
    import numpy as np
    import pyarrow.compute as pc
    for b in batches:
        if not b.num_rows:
            continue
        files, blocks = b.column("file").to_pylist(), np.asarray(b.column("block"))
        quotes = np.asarray(pc.count_substring(b.column("value"), '"')).astype(np.int64)
        new = [0, *(i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]), len(files)]
        for i, j in zip(new, new[1:]):
            yield files[i], int(blocks[i]), quotes[i:j], b.slice(i, j - i)


def _parities(batches):
    """(file, block, odd) once per range: whether its quotes are odd in number."""
    import pyarrow as pa
    out: dict = {}
    for file, block, quotes, _ in _ranges(batches):
        out[file, block] = (out.get((file, block), 0) + int(quotes.sum())) & 1
    yield pa.RecordBatch.from_arrays(
        [pa.array([f for f, _ in out], pa.string()), pa.array([b for _, b in out], pa.int64()), pa.array(list(out.values()), pa.int32())],
        names=["file", "block", "odd"])


def _records(inside: frozenset, folders: list):
    """The records and pieces of every range; ``inside``: ranges that start within quotes."""
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        key, parity, kind, lines, rest, out = None, 0, WHOLE, [], None, []

        def done(kind):
            if lines and (kind != WHOLE or lines != [""] and lines != ["\r"]):
                out.append((key[0], key[1], kind, "\n".join(lines), *rest))

        def end():
            """The range's last record: open if its quotes are."""
            if key is not None:
                done((HEAD if kind == WHOLE else MIDDLE) if parity else kind)

        for file, block, quotes, b in _ranges(batches):
            if (file, block) != key:
                end()
                key, lines = (file, block), []
                parity = int(hashlib.md5(f"{file}|{block}".encode()).digest() in inside)
                kind = TAIL if parity else WHOLE
                rest = [b.column(c)[0].as_py() for c in folders]
            at = (parity + np.cumsum(quotes) - quotes) & 1
            starts = np.flatnonzero(at == 0)
            text = b.column("value").to_pylist()
            cuts = [*starts.tolist(), len(text)]
            lines += text[:cuts[0]]
            for i, j in zip(cuts, cuts[1:]):
                done(kind)
                kind, lines = WHOLE, text[i:j]
            parity = (parity + int(quotes.sum())) & 1
            if out:
                yield _batch(out, folders)
                out = []
        end()
        if out:
            yield _batch(out, folders)

    return run


def _batch(out, folders):
    import pyarrow as pa
    cols = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
         *[pa.array(c, pa.string()) for c in cols[3:]]], names=["file", "block", "kind", "record", *folders])


def quoted_records(lines: DataFrame, folders: list[str]) -> DataFrame:
    """(record, folder columns) from a text scan of lines (``value``) split at newlines.

    The driver gets 16 bytes for every range that starts inside quotes, that is 16 bytes for
    ``spark.sql.files.maxPartitionBytes`` of input at most."""
    spark = lines.sparkSession
    ensure_library_on_workers(spark)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
                        *[F.col(c).cast("string").alias(c) for c in folders])
    odd = rows.select("file", "block", "value").mapInArrow(_parities, "file string, block long, odd int")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = odd.withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).where("open = 1")
    inside = frozenset(bytes(r["k"]) for r in opened.select(
        F.unhex(F.md5(F.concat_ws("|", "file", F.col("block").cast("string")))).alias("k")).collect())
    schema = ", ".join(["file string, block long, kind int, record string", *[f"`{c}` string" for c in folders]])
    cut = rows.mapInArrow(_records(inside, folders), schema)
    whole = cut.where(f"kind = {WHOLE}").select("record", *folders)
    if inside:
        number = F.sum((F.col("kind") == HEAD).cast("int")).over(Window.partitionBy("file").orderBy("block", "kind"))
        pieces = cut.where(f"kind <> {WHOLE}").withColumn("number", number)
        joined = pieces.groupBy("file", "number", *folders).agg(
            F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("p"))
        whole = whole.unionByName(joined.select(F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"), *folders))
    types = {f.name: f.dataType for f in lines.schema.fields}
    return whole.select(F.regexp_replace("record", "\r\\z", "").alias("record"), *[F.col(c).cast(types[c]).alias(c) for c in folders])
