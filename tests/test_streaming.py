import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.functions.payload import psi_from_payload
from driftgate.operators import calibration as C
from driftgate.operators.evaluation import adaptive_delta
from driftgate.streaming.delta import adaptive_delta_stream
from driftgate.streaming.metrics import write_with_metrics
from driftgate.streaming.resume import dedup_stream
from driftgate.streaming.shards import run_available, stream_latents
from driftgate.streaming.tau import online_tau
from tests.test_evaluation import RUNS, SIGMA, sigma_rows
from tests.test_payload import SHAPE, latent_rows, tensors


def test_new_shards_are_picked_up_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    z = tensors(6)
    for part in (slice(0, 4), slice(4, 6)):
        rows = latent_rows(spark, z).where(
            F.col("video_index").isin(list(range(6))[part]))
        rows.write.mode("append").parquet(source)
        scored = psi_from_payload(stream_latents(spark, source, max_files=1), 0.1,
                                  ["video_index"], SHAPE)
        run_available(scored, out, state)
        seen = spark.read.parquet(out)
        assert seen.count() == part.stop
    want = psi_from_payload(latent_rows(spark, z), 0.1, ["video_index"], SHAPE)
    assert ({tuple(x) for x in seen.select("video_index", "psi").collect()}
            == {tuple(x) for x in want.collect()})


def test_delta_state_carries_over(spark, tmp_path):
    runs = {k: v for k, v in RUNS.items() if k is not None}
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for low, high in ((0, 1), (1, 3), (3, 1000)):
        sigma_rows(spark, runs).where(f"step >= {low} AND step < {high}").coalesce(1).write.mode(
            "append").parquet(source)
        stream = adaptive_delta_stream(spark.readStream.schema(SIGMA).parquet(source))
        run_available(stream, out, state)
    keys = ["run", "step", "direction"]
    got = {tuple(x[k] for k in keys): x.delta for x in spark.read.parquet(out).collect()}
    want = {tuple(x[k] for k in keys): x.delta
            for x in adaptive_delta(sigma_rows(spark, runs)).collect()}
    assert got == pytest.approx(want, rel=1e-12)


def test_early_steps_wait(spark, tmp_path):
    """Arrivals in any order: the result is that of the ordered fold, each update once."""
    runs = {k: v for k, v in RUNS.items() if k is not None}
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = sigma_rows(spark, runs)
    for part in ("step % 3 = 2", "step % 3 = 0 AND direction = 'rev'", "step % 3 = 1",
                 "step % 3 = 0 AND direction = 'fwd'"):
        rows.where(part).coalesce(1).write.mode("append").parquet(source)
        run_available(adaptive_delta_stream(spark.readStream.schema(SIGMA).parquet(source)), out, state)
    keys = ["run", "step", "direction"]
    got = {tuple(x[k] for k in keys): x.delta for x in spark.read.parquet(out).collect()}
    want = {tuple(x[k] for k in keys): x.delta for x in adaptive_delta(rows).collect()}
    assert got == pytest.approx(want, rel=1e-12) and len(got) == spark.read.parquet(out).count()


@pytest.mark.parametrize("late", [("a", 0, "fwd", 1.0), ("a", 3, "rev", 1.0), ("a", 1, "up", 1.0)])
def test_a_late_step_raises(spark, tmp_path, late):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in ([("a", 0, "fwd", 0.1), ("a", 3, "rev", 0.2)], [late]):
        spark.createDataFrame(rows, SIGMA).coalesce(1).write.mode("append").parquet(source)
        stream = adaptive_delta_stream(spark.readStream.schema(SIGMA).parquet(source))
        if rows[0] != late:
            run_available(stream, out, state)
    with pytest.raises(Exception, match="late or twice|no direction"):
        run_available(stream, out, state)


@pytest.mark.parametrize("tol", [0.2, 0.0])
def test_online_tau_equals_file_stop(spark, tmp_path, tol):
    source = str(tmp_path / "in")
    rng = np.random.default_rng(4)
    rows = []
    for f, n in enumerate((30, 60, 10, 50, 40, 60, 50, 45)):
        values = [(float(v),) for v in rng.exponential(size=n)]
        rows += [(f, v[0]) for v in values]
        spark.createDataFrame(values, "psi double").coalesce(1).write.mode("append").parquet(
            source)
    stream = (spark.readStream.schema("psi double").option("maxFilesPerTrigger", 1)
              .parquet(source))
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    got = online_tau(stream, store, state, step=40, tol=tol).first()
    df = spark.createDataFrame(rows, "file int, psi double")
    want = C.converge_by_file(C.file_checks(df, "file", 40), C.tau(df), tol).first()
    assert (got.converged, got.n_samples) == (want.converged, want.n_samples)
    assert got.tau == pytest.approx(want.tau)
    assert got.converged == (tol > 0)
    # Running it again on the same state reads nothing new and decides the same.
    again = online_tau(stream, store, state, step=40, tol=tol).first()
    assert again == got


def test_resume_writes_each_identity_once(spark, tmp_path):
    schema = "k string, n int, v string"
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    stored = spark.createDataFrame([("old", 0)], "k string, n int")
    batches = [[("a", 1, "x"), ("a", 1, "b"), ("old", 0, "y")],
               [("a", 1, "a"), (None, 2, "n"), ("b", 1, "z")], [(None, 2, "m"), ("c", 3, "q")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        dedup_stream(spark.readStream.schema(schema).parquet(source), store, state, ["v"],
                     ["k", "n"], stored)
    got = sorted((x.k or "", x.n, x.v) for x in spark.read.parquet(store).collect())
    assert got == [("", 2, "n"), ("a", 1, "b"), ("b", 1, "z"), ("c", 3, "q")]


def test_counters(spark, tmp_path):
    df = spark.range(10).withColumn("tag", F.col("id") % 2)
    got = write_with_metrics(df, str(tmp_path / "out"), {
        "rows": F.count("*"), "odd": F.sum("tag")}).first()
    assert (got["rows"], got.odd) == (10, 5)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_online_tau_checks_only_after_new_scores(spark, tmp_path):
    source = str(tmp_path / "in")
    rng = np.random.default_rng(5)
    for n in (500, 0, 0, 0, 50):
        spark.createDataFrame([(float(v),) for v in rng.exponential(size=n)], "psi double").coalesce(
            1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("psi double").option("maxFilesPerTrigger", 1).parquet(source)
    got = online_tau(stream, str(tmp_path / "store"), str(tmp_path / "state"), step=100,
                     tol=0.5).first()
    assert not got["converged"]


def test_online_tau_of_an_empty_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("psi double").parquet(source)
    got = online_tau(stream, str(tmp_path / "store"), str(tmp_path / "state")).first()
    assert not got["converged"] and got["tau"] is None
