"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanlake.session import ensure_library_on_workers, scratch_dir

#: Bytes of text that one numpy pass handles at a time (a longer document is its own pass).
PASS_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared scratch folder and read it back, which
    cuts the lineage: later reads survive lost executors without recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_ready(df: DataFrame) -> None:
    """Make this package importable in the Python workers."""
    ensure_library_on_workers(df.sparkSession)


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if large else np.int32)
    offsets = offsets[col.offset:col.offset + len(col) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(col) == 0:
        return body[:0], np.zeros(1, np.int64)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]


def doc_ranges(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of at most ``limit`` bytes (or one document)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
