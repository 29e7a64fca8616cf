"""Splittable reading of quoted response logs, against the csv module and Spark's whole-file reader."""

import csv
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.sources import read_response_logs
from spanlake.sources.schemas import response_log_schema

N = 2


def write(path, rows, end="\r\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


def whole_file_reader(spark, path):
    schema = response_log_schema(N)
    df = (spark.read.schema(schema).option("multiLine", "true").option("escape", '"').option("lineSep", "\r\n")
          .option("emptyValue", "").option("mode", "FAILFAST").csv(path))
    return df.na.fill("", subset=[f.name for f in schema.fields if f.dataType == T.StringType()])


def field(draw):
    parts = ["a", "bc", '"', '""', ",", "\n", "\r\n", "é\U0001F600", " ", "\\", "null", "N/A", "x" * 40, '",\r\n"', "'"]
    return "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))


def rows_of(seed, n):
    draw = random.Random(seed)
    return [[i, f"q{i % 3}", *[field(draw) for _ in range(3 + N)]] for i in range(n)]


@pytest.mark.parametrize("split", ["150b", "1k", "128m"])
def test_any_split_size(spark, tmp_path, split):
    want = {}
    for k in range(3):
        rows = rows_of(k, 20)
        write(tmp_path / f"log{k}.csv", rows, "\r\n" if k else "\n")
        for r in rows:
            want.setdefault(tuple(r), 0)
            want[tuple(r)] += 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [tuple(r) for r in read_response_logs(spark, str(tmp_path), N).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 60 and {r: got.count(r) for r in got} == want


def test_rows_equal_the_whole_file_reader(spark, tmp_path):
    write(tmp_path / "log.csv", rows_of(9, 200))
    a, b = read_response_logs(spark, str(tmp_path), N), whole_file_reader(spark, str(tmp_path))
    assert a.columns == b.columns and sorted(a.collect()) == sorted(b.collect())


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    write(tmp_path / "log.csv", [[i, "q", "f", "", "one\nmulti\nline " + "y" * 500, f'"{i}"', "z"] for i in range(1500)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60k")
    try:
        df = read_response_logs(spark, str(tmp_path), N)
        tasks = df.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 10 and df.count() == 1500
        assert df.agg(F.sum("i")).first()[0] == sum(range(1500)) and df.where("ans_0 <> concat('\"', i, '\"')").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_folders_and_empty_logs(spark, tmp_path):
    for folder in ("query_folder=a b", "query_folder=c"):
        (tmp_path / folder).mkdir()
    write(tmp_path / "query_folder=a b" / "l.csv", [[0, "q", "f", "", "x\ny", "", "w"]])
    write(tmp_path / "query_folder=c" / "l.csv", [])
    got = read_response_logs(spark, str(tmp_path), N).collect()
    assert [(r["query_folder"], r["ans_spans"], r["ans_0"], r["ans_1"]) for r in got] == [("a b", "x\ny", "", "w")]


def test_malformed_record_fails(spark, tmp_path):
    (tmp_path / "l.csv").write_text("notanumber,q,f,,a,b,c\r\n")
    with pytest.raises(Exception):
        read_response_logs(spark, str(tmp_path), N).collect()
