"""Groups that become one value: a size report, and rejects above a limit.

The answers of a file, its composed sequence and a stitched example are one cell each, so a
task must hold the group.  Sizes come from partial sums before anything is collected, and
groups over the limit go to the rejects instead of ending the task that would hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_sizes(rows: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """(keys, n_rows, length): rows and summed length of every group; partial aggregation, no
    row is kept."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("length"))


def split_oversized(rows: DataFrame, keys: list[str], length: Column, limit: int, check: str = "group_size") -> tuple[DataFrame, DataFrame]:
    """(rows of the groups whose summed ``length`` is at most ``limit``, rejects of the others as
    (check, key, detail)).  The rows of fitting groups pass unchanged, null keys too."""
    sizes = group_sizes(rows, keys, length)
    over = sizes.where(F.col("length") > limit)
    rejects = over.select(
        F.lit(check).alias("check"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
        F.concat(F.col("n_rows").cast("string"), F.lit(" rows, length "), F.col("length").cast("string")).alias("detail"))
    marked = rows.withColumn("_group", F.struct(*keys))
    return marked.join(over.select(F.struct(*keys).alias("_group")), "_group", "left_anti").drop("_group"), rejects
