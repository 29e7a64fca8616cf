"""Versioned stages, and scratch folders that go."""

import os

import pytest
from pyspark.sql import functions as F

from spanlake.session import clear_scratch, scratch_dir, scratch_scope
from spanlake.sources.stages import RuleBroken, read_stage, versions, write_stage


def rows(spark, n, tag):
    return spark.range(n).select("id", F.lit(tag).alias("tag"), (F.col("id") % 3).alias("p"))


def folders(path):
    return sorted(n for n in os.listdir(path) if n.startswith("v"))


def test_versions_follow_each_other(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        read_stage(spark, path)
    assert [write_stage(rows(spark, 10 + k, f"t{k}"), path, ["p"]) for k in range(4)] == [1, 2, 3, 4]
    assert versions(spark, path) == [3, 4] and len(folders(path)) == 2
    assert {r["tag"] for r in read_stage(spark, path).collect()} == {"t3"} and read_stage(spark, path, version=3).count() == 12
    with pytest.raises(FileNotFoundError):
        read_stage(spark, path, version=1)


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "s")
    write_stage(rows(spark, 10, "good"), path)
    with pytest.raises(Exception, match="boom"):
        write_stage(rows(spark, 10, "bad").withColumn("tag", F.when(F.col("id") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("tag"))), path)
    with pytest.raises(RuleBroken, match="odd"):
        write_stage(rows(spark, 10, "bad"), path, rules={"odd": F.col("id") % 2 == 1, "none": F.col("id") < 0})
    assert {r["tag"] for r in read_stage(spark, path).collect()} == {"good"} and versions(spark, path) == [1]
    # what the failed write left goes with the next version; a writer that is still going on stays
    os.makedirs(f"{path}/v00000009-other")
    write_stage(rows(spark, 5, "new"), path, rules={"none": F.col("id") < 0}, keep=1)
    assert versions(spark, path) == [2] and len(folders(path)) == 2 and "v00000009-other" in folders(path)
    assert read_stage(spark, path).count() == 5


def test_two_writers_of_one_number(spark, tmp_path):
    path = str(tmp_path / "s")
    write_stage(rows(spark, 3, "a"), path)
    taken = tmp_path / "s" / "_commits" / "00000002"

    def claim(df):  # another writer commits while this one writes
        taken.write_bytes((tmp_path / "s" / "_commits" / "00000001").read_bytes())
        return df
    from spanlake.sources import writers
    real, writers.materialize = writers.materialize, lambda df, *a: real(claim(df), *a)
    try:
        with pytest.raises(Exception, match="exist"):
            write_stage(rows(spark, 4, "b"), path)
    finally:
        writers.materialize = real
    assert {r["tag"] for r in read_stage(spark, path).collect()} == {"a"}


def test_scratch_folders_go(spark):
    kept = scratch_dir(spark, "kept")
    rows(spark, 3, "a").write.parquet(kept)
    with pytest.raises(KeyError), scratch_scope(spark):
        inner = scratch_dir(spark, "inner")
        rows(spark, 3, "a").write.parquet(inner)
        raise KeyError
    assert not os.path.exists(inner.replace("file:", "")) and os.path.exists(kept.replace("file:", ""))
    assert clear_scratch(spark) >= 1 and not os.path.exists(kept.replace("file:", ""))
