"""Session construction and the shared scratch location.

Intermediate tables and checkpoints go under the cluster's shared
``spark.checkpoint.dir``.  A private directory is created only when the
setting is absent *and* Spark runs in local mode (tests, benches); on a
cluster (``local-cluster`` is one: its executors are processes of their own)
an unset checkpoint directory is a configuration error.

Scratch folders live as long as the frames that read them may be read, which
only the caller knows: ``scratch_scope`` removes those made inside it, and
``clear_scratch`` all that this application made.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "spanlake",
              shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Arrow batches for Python operators are bounded by rows and, for long texts, bytes
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        # checkpoint files go when their frame is no longer referenced
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: configure a shared folder for the cluster")
    local = tempfile.mkdtemp(prefix="spanlake-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


_SHIPPED: set = set()


def ensure_library_on_workers(spark: SparkSession) -> None:
    """Ship this package to the Python workers once per SparkContext.

    Operators that run Python in tasks (Pandas UDFs, mapInPandas / mapInArrow) refer to
    library functions by module name, so the workers must be able to import the package
    whatever their working directory.  The package is zipped on the driver and added
    with ``addPyFile`` (executors put it on their ``sys.path``)."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="spanlake-lib-"), "spanlake.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``checkpoint()`` has its (shared) directory; returns it."""
    return _checkpoint_root(spark)


def scratch_dir(spark: SparkSession, name: str = "tmp") -> str:
    """A fresh sub-folder of the shared checkpoint location."""
    root = _checkpoint_root(spark)
    path = os.path.join(root, "spanlake", f"{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_SCRATCH: dict[str, list[str]] = {}


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> int:
    """Remove every scratch folder that this application has made; returns how many.  Frames
    that read them can't be read afterwards."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Removes the scratch folders made inside the scope when it ends, also by an error.  Write
    or collect what you need before."""
    mine = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    before = len(mine)
    try:
        yield
    finally:
        _delete(spark, mine[before:])
        del mine[before:]
