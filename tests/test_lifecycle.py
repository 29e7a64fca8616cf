"""The three entry points end to end on fixture data with the fake client."""

from pyspark.sql import functions as F

from spanlake.plans import fakes
from spanlake.plans import fixtures as fx
from spanlake.plans import lifecycle as L
from spanlake.plans.q_scalar import source_files_rows
from spanlake.plans.shared import rows_test, rows_train
from spanlake.session import scratch_dir

SF = "/root/testdata/sf0.01"


def test_sample_generate_evaluate(spark):
    test = rows_test(spark, SF)
    sample, summary = L.build_samples(test)
    assert sample.groupBy("query_name").count().where("count > 20").count() == 0
    total = summary.where("is_total = 1").first()
    assert total["sampled"] == sample.count()
    meta = fx.fx_meta(spark, SF)
    ok, rejected = L.build_prompts(sample, test, rows_train(spark, SF), meta, source_files_rows(spark, SF),
                                   max_tokens=4000)
    n_ok, n_rej = ok.count(), rejected.count()
    assert n_ok + n_rej == sample.count()
    out = scratch_dir(spark, "e2e-logs")
    no_sleep = lambda _s: None  # noqa: E731 - local, so it ships to the workers by value
    rows = L.generate_logs(ok, meta, fakes.echo_client, out, n=10, concurrency=4, max_attempts=2,
                           timeout=0.0, sleep=no_sleep)
    assert rows.count() == n_ok
    pk, am = L.evaluate_logs(spark, out)
    got = {r["k"]: r for r in pk.collect()}
    assert set(got) == {1, 2, 5, 10} and all(r["total"] == n_ok for r in got.values())
    assert all(0.0 <= r["pass_at_k"] <= 1.0 for r in got.values())
    assert am.where("is_total = 1").first()["total"] == n_ok
    # per-query row counters restart at 0
    back = spark.read.option("lineSep", "\r\n").option("multiLine", "true").option("escape", '"') \
        .schema("i int").csv(out)
    assert back.groupBy("query_folder").agg(F.min("i").alias("m")).where("m <> 0").count() == 0
