"""Writers: Parquet is the canonical store; CSV only at the edge (response logs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import flatten_path


def materialize(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite", max_records_per_file: int = 5_000_000) -> str:
    """Persist a stage as Parquet (optionally partitioned) and return the path.

    A partitioned stage is rebalanced on its folders first, so the number of files follows
    the bytes of each folder and not tasks x folders; files are capped at
    ``max_records_per_file`` rows, so a large folder becomes many bounded files."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def csv_field(c) -> F.Column:
    """One CSV field with minimal quoting: quoted (inner quotes doubled) only when it holds
    a comma, a quote, CR or LF; null is written as the empty field."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c.rlike('[,"\r\n]'),
                  F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def write_response_logs(df: DataFrame, path: str, n: int = 10,
                        folder_col: str = "query_folder", max_records_per_file: int = 5_000_000) -> str:
    """Headerless CSV logs, one folder per query, CRLF record ends, '' for blanks.

    Records are formatted as text columns so newlines inside quoted fields stay as they
    are (the CSV sink would rewrite them to the record separator).  ``df`` holds
    ``i, query, file_path, prompt, ans_spans, ans_0..ans_{n-1}`` plus the folder column;
    rows are rebalanced on the folder: AQE splits a large query by its bytes over many
    tasks (and files) and merges small ones."""
    cols = ["i", "query", "file_path", "prompt", "ans_spans"] + [f"ans_{j}" for j in range(n)]
    rec = F.concat_ws(",", *[csv_field(F.col(c)) for c in cols]).alias("value")
    (df.select(F.col(folder_col), F.col("i"), rec)
     .hint("rebalance", folder_col).sortWithinPartitions(folder_col, "i")
     .select(folder_col, "value")
     .write.mode("overwrite").partitionBy(folder_col).option("lineSep", "\r\n")
     .option("maxRecordsPerFile", max_records_per_file).text(path))
    return path


def write_prompts(df: DataFrame, path: str, folder_col: str = "query_folder") -> str:
    """Prompts keyed by file name (path with '/' -> '_'), rebalanced on and partitioned
    by query folder."""
    (df.select(F.col(folder_col), flatten_path("code_file_path").alias("file_name"), "prompt")
     .hint("rebalance", folder_col).write.mode("overwrite").partitionBy(folder_col).parquet(path))
    return path


def write_vocab(tokens: DataFrame, path: str, order_by: tuple[str, ...] = ("line_no",),
                files: int = 4) -> str:
    """Write a vocabulary as text lines in ``order_by`` order, range-split over a few files.

    Part files follow range order, which ``read_vocab`` chains back by file name."""
    (tokens.repartitionByRange(files, *order_by).sortWithinPartitions(*order_by)
     .select("token").write.mode("overwrite").text(path))
    return path
