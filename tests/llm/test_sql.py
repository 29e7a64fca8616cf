"""Queries against their DuckDB SQL."""

import duckdb
import pytest

from spanlake.llm import decontaminate, warc


def rows_of(sql, **tables):
    con = duckdb.connect()
    for name, pdf in tables.items():
        con.register(name, pdf)
    return con.sql(sql).fetchall()


@pytest.fixture
def sf(spark, tmp_path):
    spark.createDataFrame([(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", None), (3, "http://b/", "<p>x</p>"), (4, "http://b/é", "<p>é</p>"),
                           (5, None, ""), (9, "http://c/", "<p>x</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    ten = "One two three four five six seven eight nine TEN"
    spark.createDataFrame([(1, f"{ten}, eleven"), (2, "short item"), (3, None), (4, f"zero {ten}")],
                          "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, f"x {ten.lower()} y"), (2, f"{ten} eleven; a short-item here"), (3, None), (4, "é" * 9), (5, f"zero {ten} zero {ten} eleven")],
                          "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_warc(spark, sf):
    got = {tuple(r) for r in warc.op8_warc(spark, sf).collect()}
    want = rows_of(warc.SQL, pages=spark.read.parquet(f"{sf}/pages.parquet").toPandas())
    assert got == {tuple(None if x != x else x for x in r) for r in want} and sum(r[3] == "revisit" for r in got) == 3


def test_decontamination(spark, sf):
    got = {tuple(r) for r in decontaminate.op4_decontaminate(spark, sf).collect()}
    read = {n: spark.read.parquet(f"{sf}/{n}.parquet").toPandas() for n in ("documents", "benchmark")}
    assert got == set(rows_of(decontaminate.SQL, **read)) and sum(r[5] for r in got) == 3
