import pytest
from pyspark.sql import functions as F

from driftgate import session as S
from driftgate.functions.payload import (
    frame_l1_from_payload, moments_from_payload, payload_size, psi_from_payload,
    target_moments_from_payload,
)
from driftgate.operators.calibration import fetch_rows, most_static
from driftgate.operators.scoring import score
from driftgate.plans.epoch import epoch_payloads
from driftgate.sources.latents import fetch_payloads, read_latents, scan_motion, with_address
from tests.test_payload import SHAPE, SIZE, latent_rows, tensors


class Session:
    """Just enough of a session to ask where the shared folder is."""

    def __init__(self, master, path=None):
        self.settings = {"spark.checkpoint.dir": path} if path else {}
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = self

    def get(self, key, default):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


def test_shared_folder():
    assert S.shared_dir(Session("yarn", "hdfs://shared/")) == "hdfs://shared"
    with pytest.raises(RuntimeError):
        S.shared_dir(Session("yarn"))
    local = Session("local[2]")
    assert S.shared_dir(local) == S.shared_dir(local)


def test_written_table_keeps_rows_and_schema(spark):
    df = spark.range(5).withColumn("v", F.lit(None).cast("string"))
    back = S.materialize(df, "numbers")
    assert back.dtypes == df.dtypes and back.count() == 5


def test_payload_session(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    bounded = S.payload_session(spark, 56_623_104)
    assert bounded.conf.get(key) == "4" and spark.conf.get(key) == before
    assert bounded.conf.get("spark.sql.shuffle.partitions") == "4"  # all other settings are kept
    assert S.payload_session(spark, 100).conf.get(key) == before
    assert S.payload_session(bounded, None) is S.home_session(bounded) is spark
    assert S.materialize(bounded.range(3), "narrow").sparkSession is spark


def batches_of(df):
    """Collect `df`; the batches that its scans of payloads have put out."""
    df.collect()

    def scans(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return scans(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return scans(node.plan())
        own = 0
        if kind == "ColumnarToRowExec" and "latent_bytes" in node.schema().simpleString():
            own = node.metrics().apply("numInputBatches").value()
        children = node.children()
        return own + sum(scans(children.apply(i)) for i in range(children.size()))

    return scans(df._jdf.queryExecution().executedPlan())


JOBS = {
    "frame_l1": lambda df: frame_l1_from_payload(df, ["video_index"], SHAPE),
    "psi": lambda df: psi_from_payload(df, 0.1, ["video_index"], SHAPE),
    "moments": lambda df: moments_from_payload(df, ["video_index"]),
    "target moments": lambda df: target_moments_from_payload(df, ["video_index"], SHAPE, 2),
    "score": lambda df: score(df, ["video_index"], 0.1, shape=SHAPE, pairs=2),
    "joined": lambda df: df.join(F.broadcast(df.sparkSession._driftgate_home.range(40)),
                                 F.col("video_index") == F.col("id")),
}


@pytest.mark.parametrize("job", JOBS)
def test_a_scan_carries_its_bound(spark, tmp_path, monkeypatch, job):
    """One shard of 40 payloads in one row group: no batch holds more than the bound, though the job runs
    long after the scan was made and nothing is set meanwhile."""
    path = str(tmp_path / "store")
    latent_rows(spark, tensors(40)).coalesce(1).write.parquet(path)
    monkeypatch.setattr(S, "BATCH_BYTES", 5 * payload_size(SHAPE))
    bounded = read_latents(spark, path, payload_bytes=payload_size(SHAPE))
    assert batches_of(JOBS[job](bounded)) == 8


def test_fetched_payloads_are_bounded(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    latent_rows(spark, tensors(40)).coalesce(1).write.parquet(path)
    winners = S.materialize(with_address(read_latents(spark, path)).select("file_path", "row_index"), "all")
    monkeypatch.setattr(S, "BATCH_BYTES", 8 * payload_size(SHAPE))
    got = fetch_payloads(winners, payload_bytes=payload_size(SHAPE))
    assert batches_of(got) == 5 and got.count() == 40


def test_broadcast_only_when_bounded(spark):
    df = spark.range(3)
    assert S.broadcast_bounded(df, S.MAX_BROADCAST_ROWS + 1) is df
    assert S.broadcast_bounded(df, 3) is not df


def test_payloads_by_address(spark, tmp_path):
    path = str(tmp_path / "store")
    z = tensors(12)
    latent_rows(spark, z).repartition(6, "video_index").write.parquet(path)
    latents = read_latents(spark, path)
    winners = S.materialize(most_static(scan_motion(latents), 2), "winners")
    got = fetch_payloads(winners)
    assert {x.video_index: bytes(x.latent_bytes) for x in got.collect()} == {
        i: z[i].tobytes() for i in (0, 1)}
    files = winners.select("file_path").distinct().count()
    opened = [f for f in got.inputFiles() if path in f]
    assert len(opened) == files < len(latents.inputFiles())
    same = fetch_rows(with_address(latents), winners, 2)
    assert {x.video_index for x in same.collect()} == {0, 1}
    assert fetch_payloads(winners.limit(0)).count() == 0


def test_epoch_payloads_are_channel_major(spark, tmp_path):
    path = str(tmp_path / "store")
    z = tensors(6)
    latent_rows(spark, z).write.parquet(path)
    rows = with_address(read_latents(spark, path)).select(
        "file_path", "row_index", F.lit(0).alias("worker"),
        F.col("video_index").cast("long").alias("row"), F.lit(0).alias("batch_id"))
    out = epoch_payloads(rows.where("row < 4"), SHAPE).collect()
    assert {x.row: bytes(x.latent_bytes) for x in out} == {
        i: z[i].transpose(3, 0, 1, 2).tobytes() for i in range(4)}
    assert all(len(x.latent_bytes) == SIZE * 4 for x in out)
