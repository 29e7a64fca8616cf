"""Versioned stages: a rewritten stage replaces the old one only when it is complete.

A stage is a folder of versions.  A write goes to a folder of its own and becomes the current
version by one small commit file, ``_commits/<number>``, that names the folder and is created
without overwriting.  A write that fails, or whose observed rules find offending rows, leaves
no commit file: readers go on with the last committed version.  Of two writers that race for
a number, one creates the file and the other fails.  Retention removes versions behind the
last ``keep`` ones and the folders of failed writes before them.  All of it goes through
Spark's file systems, so a stage may lie wherever Spark can write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = "_commits"


class RuleBroken(ValueError):
    """Rows that a stage's rules forbid; nothing was committed."""


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, jpath = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, oldest first."""
    return [int(n) for n in _names(spark, f"{path}/{COMMITS}") if n.isdigit()]


def _folder(spark: SparkSession, path: str, version: int) -> str:
    fs, _ = _fs(spark, path)
    commit = fs.open(_path(spark, path, COMMITS, f"{version:08d}"))
    try:
        return commit.readUTF()
    finally:
        commit.close()


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, rules: dict[str, Column] | None = None,
                keep: int = 2) -> int:
    """Write ``df`` as the next version of the stage and return its number.

    ``rules``: conditions by name that offending rows fulfil; they are counted while the
    stage is written (one pass), and any count but 0 raises ``RuleBroken`` without a commit."""
    from spanlake.sources.writers import materialize
    spark = df.sparkSession
    number = (versions(spark, path) or [0])[-1] + 1
    name = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
    seen = Observation()
    if rules:
        df = df.observe(seen, *[F.count_if(rule).alias(rule_name) for rule_name, rule in rules.items()])
    materialize(df, f"{path}/{name}", partition_by)
    if rules and (broken := {k: v for k, v in seen.get.items() if v}):
        _fs(spark, path)[0].delete(_path(spark, path, name), True)
        raise RuleBroken(f"{path}: {broken}")
    commit = _fs(spark, path)[0].create(_path(spark, path, COMMITS, f"{number:08d}"), False)
    commit.writeUTF(name)
    commit.close()
    _retain(spark, path, number, keep)
    return number


def _retain(spark: SparkSession, path: str, number: int, keep: int) -> None:
    fs, _ = _fs(spark, path)
    kept = versions(spark, path)[-max(keep, 1):]
    folders = {_folder(spark, path, v) for v in kept}
    for v in versions(spark, path):
        if v not in kept:
            fs.delete(_path(spark, path, COMMITS, f"{v:08d}"), False)
    for name in _names(spark, path):
        # a folder of a later number belongs to a write that is still going on
        if name.startswith("v") and name not in folders and int(name[1:9]) <= number:
            fs.delete(_path(spark, path, name), True)


def read_stage(spark: SparkSession, path: str, schema: T.StructType | None = None, version: int | None = None) -> DataFrame:
    """The last committed version of the stage, or the one asked for."""
    from spanlake.sources.readers import reload
    have = versions(spark, path)
    if not have or version is not None and version not in have:
        raise FileNotFoundError(f"{path}: no committed version {version or ''}".rstrip())
    return reload(spark, f"{path}/{_folder(spark, path, version or have[-1])}", schema)
