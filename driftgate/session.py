"""Session settings and the shared folder that intermediate tables are written to."""

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftgate.settings import MAX_BROADCAST_ROWS

BATCH_BYTES = 256 * 1024 ** 2


def build_session(app_name="driftgate", master=None, **conf):
    """A session with the settings the operators expect; `conf` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Lets `first_n` cut groups inside the scan tasks for caps of up to 10,000 rows.
        "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application (as `--py-files` would)."""
    if spark.conf.get("driftgate.shipped", None) != spark.sparkContext.applicationId:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(), "driftgate"), "zip",
            os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(archive)
        spark.conf.set("driftgate.shipped", spark.sparkContext.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="driftgate-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/driftgate/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and leaves a columnar table whose row
    count costs only a footer read.
    """
    spark = home_session(df.sparkSession)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast `df` if its known row bound allows it; otherwise leave the join to Spark."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def payload_session(spark: SparkSession, payload_bytes) -> SparkSession:
    """A session whose scans read few enough rows at a time that a batch stays near 256 MiB.

    A scan keeps the session it was made in, whatever joins and jobs it later goes into, so the bound
    travels with it, and `spark`'s other scans do not have it. `payload_bytes` is the size of a row, or None
    for the usual batches. Arrow batches are bounded in bytes by Spark itself.
    """
    key = "spark.sql.parquet.columnarReaderBatchSize"
    home = home_session(spark)
    if payload_bytes is None:
        return home
    rows = max(1, min(int(home.conf.get(key)), BATCH_BYTES // payload_bytes))
    session = home.newSession()
    for name, value in home.conf.getAll.items():
        if home.conf.isModifiable(name):
            session.conf.set(name, value)
    session.conf.set(key, str(rows))
    session._driftgate_home = home
    return session


def home_session(spark: SparkSession) -> SparkSession:
    """The session that a payload session was made from; any other as it is."""
    return getattr(spark, "_driftgate_home", spark)


def payload_write_options() -> dict:
    """Parquet writer options that keep row groups to a few full-size payload rows, and give each
    group a Bloom filter of the identity columns that vary inside a shard."""
    bloom = {f"parquet.bloom.filter.{option}#{name}": value
             for name in ("worker_id", "video_index", "tubelet_start")
             for option, value in (("enabled", "true"), ("expected.ndv", "64"))}
    return {
        "parquet.enable.dictionary": "false",
        "parquet.page.size.row.check.min": "1",
        "parquet.page.size.row.check.max": "1",
        **bloom,
    }
