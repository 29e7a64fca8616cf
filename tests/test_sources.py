"""Sources and sinks: file keys, empty files, malformed metadata, rebalanced sinks, fixture rows."""

import os

import pytest
from pyspark.sql import functions as F

from spanlake.plans import fixtures as fx
from spanlake.sources import read_query_meta
from spanlake.sources import read_source_files
from tests.conftest import SF_SMALL


def test_source_file_keys(spark, tmp_path):
    root = tmp_path / "src dir"
    os.makedirs(root / "x")
    want = {"x/a b.py": "1\n2", "c%d.py": "q", "p+q.py": "r", "empty.py": "", "x/e%20 é+.py": "", "blank.py": " \n"}
    for name, text in want.items():
        (root / name).write_text(text)
    got = {r["code_file_path"]: r["content"] for r in read_source_files(spark, str(root)).collect()}
    assert got == want
    only = read_source_files(spark, str(root), "*+.py").collect()
    assert {r["code_file_path"]: r["content"] for r in only} == {"x/e%20 é+.py": ""}


def test_many_small_files_share_tasks(spark, tmp_path):
    """Spark deals 32 small files to a task and lists by a task a folder; empty files need a scan more."""
    for i in range(200):
        os.makedirs(tmp_path / f"d{i}")
        (tmp_path / f"d{i}" / "f.py").write_text(str(i))
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, tracker = spark.conf.get(key), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "")
    files = read_source_files(spark, str(tmp_path))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    listing = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert listing and all(tracker.getStageInfo(s).numTasks <= 16 * spark.sparkContext.defaultParallelism for s in listing)
    assert spark.conf.get(key) == before
    assert files.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert files._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    want = {f"d{i}/f.py": str(i) for i in range(200)}
    assert {r["code_file_path"]: r["content"] for r in files.collect()} == want
    (tmp_path / "d7" / "none.py").write_text("")
    assert {r["code_file_path"]: r["content"] for r in read_source_files(spark, str(tmp_path)).collect()} == want | {"d7/none.py": ""}


def test_folder_of_empty_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("")
    assert [tuple(r) for r in read_source_files(spark, str(tmp_path)).collect()] == [("a.py", "")]


def test_malformed_metadata_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"name": "n", "desc": "d", "reccomendation": "r"}]')
    assert read_query_meta(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.json").write_text('[{"name": "n", ')
    with pytest.raises(Exception):
        read_query_meta(spark, str(tmp_path)).collect()


def test_every_document_is_an_example(spark):
    assert fx.fx_files(spark, SF_SMALL).count() >= fx.table(spark, SF_SMALL, "documents").count()
    assert fx.fx_files(spark, SF_SMALL).where("em is null").count() == 0


def test_sinks_rebalance_by_size(spark, tmp_path):
    from spanlake.operators.filters import partition_by_query
    from spanlake.sources import materialize
    df = spark.range(400).select(F.concat(F.lit("q"), F.col("id") % 20).alias("query_name"), "id").repartition(40)
    assert "REBALANCE" in partition_by_query(df)._jdf.queryExecution().toString().upper()
    path = materialize(df, str(tmp_path / "t"), ["query_name"])
    n_files = sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)
    assert n_files == 20 and spark.read.parquet(path).count() == 400
