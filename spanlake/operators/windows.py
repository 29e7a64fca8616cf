"""Window-style operators (E1-E5) and a distributed dense row numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.session import ensure_checkpoint_dir


def _number_keys(df: DataFrame, keys: list[str], order_by: list) -> tuple[DataFrame, bool]:
    """Every distinct key of ``df`` with ``_start``, the number of rows before it in
    ``order_by``; and whether a key has several rows.

    Only keys and their counts are range-sorted and checkpointed (both uses below need one
    physical order); the rows are not stored.  A key's offset is its partition's, from a
    running sum over the partitions' totals, plus its place in the partition."""
    ensure_checkpoint_dir(df.sparkSession)
    line = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).orderBy(*order_by)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
            .checkpoint(eager=True))
    repeated = line.where("_n > 1").limit(1).count() > 0
    if repeated:
        place = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
        line = line.withColumn("_pos", F.coalesce(F.sum("_n").over(place), F.lit(0)))
    totals = line.groupBy("_pid").agg(F.sum("_n").alias("_t"))
    # one row per partition; AQE picks the join from its size
    offsets = totals.select("_pid", (F.sum("_t").over(Window.orderBy("_pid")) - F.col("_t")).alias("_off"))
    return line.join(offsets, "_pid").select(*keys, (F.col("_off") + F.col("_pos")).alias("_start")), repeated


def _attach(df: DataFrame, keys: list[str], numbered: DataFrame, repeated: bool, name: str) -> DataFrame:
    """``df`` with ``name`` = its key's ``_start`` plus its place among the rows of that key
    (ordered by all their columns).  Keys are joined as structs, in which nulls are equal."""
    key = F.struct(*keys)
    numbers = numbered.select(key.alias("_key"), F.col("_start").alias("_num"))
    rows = df.withColumn("_key", key).join(numbers, "_key")
    if repeated:
        whole = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        rows = rows.withColumn("_num", F.col("_num") + F.row_number().over(
            Window.partitionBy("_key").orderBy(F.xxhash64(*whole))) - 1)
    return rows.select(*df.columns, F.col("_num").cast("long").alias(name))


def global_row_number(df: DataFrame, order_by: list, name: str = "rn", keys: list[str] | None = None) -> DataFrame:
    """0-based dense position of each row in a total order, without a single-partition window
    and without storing rows.  ``keys``: the columns that ``order_by`` reads (by default
    ``order_by`` itself, if it is names)."""
    keys = list(keys or order_by)
    numbered, repeated = _number_keys(df, keys, order_by)
    return _attach(df, keys, numbered, repeated, name)


def group_row_number(df: DataFrame, groups: list[str], order_by: list[str], name: str = "rn") -> DataFrame:
    """1-based ``row_number()`` within each group, without putting a group in one task.

    A plain window sorts each group inside a single task, so one hot group (a third of the
    rows) lands on one executor.  Here the (group, order) keys are numbered over all groups:
    a hot group spreads over many range partitions.  A group's first number comes off again
    on the narrow key table, and the rows get their numbers by a join on the key.  The number
    is a long: a group may pass 2^31 rows."""
    keys = list(dict.fromkeys([*groups, *order_by]))
    numbered, repeated = _number_keys(df, keys, keys)
    group = F.struct(*groups)
    first = numbered.groupBy(group.alias("_group")).agg(F.min("_start").alias("_first"))
    numbered = (numbered.withColumn("_group", group).join(first, "_group")
                .select(*keys, (F.col("_start") - F.col("_first") + 1).alias("_start")))
    return _attach(df, keys, numbered, repeated, name)


def bucket_of(em="em", example_type="example_type"):
    """Bucket 0..3 = success x positive, failure x positive, success x negative, failure x negative."""
    et = F.col(example_type) if isinstance(example_type, str) else example_type
    e = F.col(em) if isinstance(em, str) else em
    return (F.when(et == 1, 0).otherwise(2) + (F.lit(1) - e)).cast("int")


def rank_in_bucket(files: DataFrame, top: int | None = None) -> DataFrame:
    """1-based position of a file in its (query, bucket) list, first-seen order.

    With ``top`` only ranks <= top are kept; Spark then plans a partial
    WindowGroupLimit before the shuffle, so a huge bucket ships at most ``top``
    rows per input partition."""
    if top is None:
        # all ranks: distributed group numbering (no task holds a whole bucket)
        return group_row_number(files, ["query_name", "bucket"], ["first_row_id", "code_file_path"],
                                "rank_in_bucket")
    w = Window.partitionBy("query_name", "bucket").orderBy("first_row_id", "code_file_path")
    out = files.withColumn("rank_in_bucket", F.row_number().over(w))
    return out.where(F.col("rank_in_bucket") <= top)


def singleton_files(rows: DataFrame, keys=("query_name", "code_file_path")) -> DataFrame:
    """Rows whose file occurs exactly once within its query (count over the file key)."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return rows.join(counts, list(keys), "left_semi")


def row_index(df: DataFrame, partition: str = "query_name", order=("row_id",),
              name: str = "i", distributed: bool = True) -> DataFrame:
    """Per-query 0-based counter in a given order (after any filtering).

    ``distributed`` numbers through ``group_row_number`` so a large query is spread
    over many tasks; ``False`` uses a plain window (fine for small inputs)."""
    if distributed:
        out = group_row_number(df, [partition], list(order), "_rn")
        return out.withColumn(name, F.col("_rn") - 1).drop("_rn")
    w = Window.partitionBy(partition).orderBy(*order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def example_index(df: DataFrame, order_by: list[str], name: str = "example_id") -> DataFrame:
    """E5: running example id over a total order (distributed)."""
    return global_row_number(df, order_by, name)
