"""Payloads by address and by identity: what is read, and what crosses an exchange."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.schema import LATENT, LATENT_KEYS
from driftgate.session import materialize, payload_write_options
from driftgate.sources.latents import fetch_payloads, read_latents, scan_motion, with_address
from driftgate.sources.store import (
    IDENTITY, dedup_rows, identity, not_stored, open_store, pick_rows, write_batch,
)
from driftgate.streaming.resume import dedup_stream


def rows_of(spark, names, size=16, flow=0.0):
    """One row per (factory, worker, video, start); the payload tells the identity and the flow."""
    made = [(*name, "iid_sample", flow, bytearray(payload(name, flow, size))) for name in names]
    return spark.createDataFrame(made, LATENT)


def payload(name, flow=0.0, size=16):
    rng = np.random.default_rng([*repr(name).encode(), int(flow)])
    return rng.random(size, np.float32).tobytes()


def names(n):
    return [(f"f{i % 3}", None if i % 5 == 0 else f"w{i % 7}", i // 4, 64 * (i % 4)) for i in range(n)]


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def exchanged(df):
    """The columns that cross each exchange, by the formatted plan."""
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", formatted(df))


def rows_scanned(df):
    """Collect `df`; its rows and those that its scans of payloads have put out."""
    rows = df.collect()

    def scans(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return scans(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return scans(node.plan())
        if kind == "FileSourceScanExec":
            wide = "latent_bytes" in node.schema().simpleString()
            return node.metrics().apply("numOutputRows").value() if wide else 0
        children = node.children()
        return sum(scans(children.apply(i)) for i in range(children.size()))

    return rows, scans(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def shards(spark, tmp_path_factory):
    """Two shards of 40 rows of 64 KiB, a few rows to a row group."""
    path = str(tmp_path_factory.mktemp("wide") / "store")
    wide = rows_of(spark, names(80), 16_384).withColumn(
        "m_flow", (F.col("video_index") * 4 + F.col("tubelet_start") / 64).cast("float"))
    (wide.repartitionByRange(2, "video_index").sortWithinPartitions("video_index", "tubelet_start")
     .write.options(**payload_write_options()).option("parquet.block.size", 128 * 1024).parquet(path))
    return path


def test_row_groups_without_a_winner_are_skipped(spark, shards):
    latents = read_latents(spark, shards)
    motion = materialize(scan_motion(latents, keep=LATENT_KEYS).where(
        F.col("m_flow").isin(3.0, 35.0, 71.0)), "motion")

    few, of_few = rows_scanned(fetch_payloads(motion))
    same, of_same = rows_scanned(fetch_payloads(motion.drop(*LATENT_KEYS)))
    assert sorted(few, key=repr) == sorted(same, key=repr)
    assert {(x.video_index, x.tubelet_start) for x in few} == {(0, 192), (8, 192), (17, 192)}
    for x in few:
        name = next(n for n in names(80) if n[2:] == (x.video_index, x.tubelet_start))
        assert bytes(x.latent_bytes) == payload(name, size=16_384)
    assert of_same == 80     # whole shards
    assert 3 <= of_few <= 9  # three row groups of a few rows


def test_winners_in_any_number_of_groups(spark, shards):
    """Groups of files with their own broadcast give the same rows as one."""
    latents = with_address(read_latents(spark, shards)).drop("latent_bytes")
    winners = materialize(latents.where("tubelet_start > 0"), "winners")
    whole = fetch_payloads(winners.drop(*LATENT_KEYS)).collect()
    split = fetch_payloads(winners.drop(*LATENT_KEYS), max_rows=7).collect()
    pushed = fetch_payloads(winners, max_pushed=7).collect()
    assert len(whole) == 60
    assert sorted(whole, key=repr) == sorted(split, key=repr) == sorted(pushed, key=repr)


def test_no_payload_in_an_exchange(spark, tmp_path):
    path = str(tmp_path / "in")
    for flow in (2.0, 1.0, 3.0):
        rows_of(spark, names(30 if flow == 1.0 else 40), flow=flow).write.mode("append").parquet(path)
    picked = pick_rows(with_address(read_latents(spark, path)), ["m_flow"])
    assert exchanged(picked) and not any("latent_bytes" in x for x in exchanged(picked))
    out = dedup_rows(read_latents(spark, path), ["m_flow"])
    assert not any("latent_bytes" in x for x in exchanged(out))
    got = {tuple(x[:4]): (x.m_flow, bytes(x.latent_bytes)) for x in out.collect()}
    assert out.count() == len(got) == 40 and out.columns == LATENT.names
    for i, name in enumerate(names(40)):
        flow = 1.0 if i < 30 else 2.0
        assert got[name] == (flow, payload(name, flow))


def test_identities_with_null_parts_are_told_apart(spark):
    rows = [("a", None), (None, "a"), (None, None), ("null", "null"), ('a","k1":"b', "c"),
            ("a", 'b","k1":"c'), ("", None)]
    df = spark.createDataFrame(rows, "x string, y string").select(identity("x", "y").alias("i"))
    found = [r.i for r in df.collect()]
    assert len(set(found)) == len(rows) and None not in found


def test_stored_identities_stay_where_they_are(spark, tmp_path):
    table = open_store(spark, str(tmp_path / "store"), LATENT, 8)
    stored = rows_of(spark, names(40)).withColumn(IDENTITY, identity(*LATENT_KEYS))
    write_batch(stored, table, 0)
    new = materialize(rows_of(spark, names(60)[38:]).drop("latent_bytes").withColumn(
        IDENTITY, identity(*LATENT_KEYS)), "new")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = not_stored(new, table)
        moved = exchanged(left)
        assert len(moved) == 1 and "m_flow" in moved[0]  # the new rows, not the stored ones
        one = not_stored(new.limit(1), table)
        assert "SelectedBucketsCount: 1 out of 8" in formatted(one)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert left.count() == 20
    assert not_stored(new, table, before=0).count() == 22  # batches below the first: none
    write_batch(stored.limit(5), table, 0)  # the batch again, in place of itself
    assert spark.table(table).count() == 5
    assert open_store(spark, str(tmp_path / "store"), LATENT, 99) == table


def test_stream_of_three_batches_with_repeats(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    all_names = names(24)
    for batch, (part, flow) in enumerate(((all_names[:10] + all_names[:3], 3.0),
                                          (all_names[5:18], 1.0), (all_names[:24], 2.0))):
        rows_of(spark, part, flow=flow).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LATENT).parquet(source)
        dedup_stream(stream, store, state, ["m_flow"], buckets=4)
        got = {tuple(x[:4]): x for x in read_latents(spark, store, schema=LATENT).collect()}
        assert len(got) == (10, 18, 24)[batch]
    for i, name in enumerate(all_names):
        flow = 3.0 if i < 10 else 1.0 if i < 18 else 2.0
        assert bytes(got[name].latent_bytes) == payload(name, flow)
    assert read_latents(spark, store).count() == 24
