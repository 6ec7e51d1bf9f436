import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from driftgate.functions.payload import (
    check_payload, decode_latent, encode_latent, frame_l1_from_payload, moments_from_payload,
    payload_problem, psi_from_payload,
)
from driftgate.functions.udfs import register
from driftgate.operators.evaluation import merge_moments
from driftgate.operators.frames import frame_diff, frame_l1, psi
from driftgate.plans.calibrate import calibrate, frame_changes
from driftgate.plans.epoch import store_epoch
from driftgate.plans.evaluate import batch_volatility
from driftgate.schema import LATENT, LATENT_KEYS
from driftgate.settings import SEED
from driftgate.sources.calibration import thresholds
from driftgate.sources.latents import (
    index_of, latent_index, list_shards, read_latents, scan_motion, skipped_shards,
    with_address, with_defaults,
)
from driftgate.sources.shards import write_assigned_shards, write_shards

SHAPE = (4, 2, 2, 3)
SIZE = int(np.prod(SHAPE))


def tensors(n, seed=0):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, *SHAPE)).astype(np.float32)
    out[0] = 1.5
    return out


def latent_rows(spark, z, tag=lambda i: "iid_sample", flow=float):
    rows = [(f"f{i % 2}", "w", i, 64 * i, tag(i), flow(i), bytearray(x.tobytes()))
            for i, x in enumerate(z)]
    return spark.createDataFrame(rows, LATENT)


def changes(x):
    x = x.reshape(SHAPE[0], -1).astype(np.float64)
    return np.abs(x[1:] - x[:-1]).mean(axis=1)


def test_codec(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, None), (2, [7, 8, 9])],
                               "id int, v array<int>")
    packed = df.select("id", encode_latent("v").alias("b"))
    assert {x.id: x.b and len(x.b) for x in packed.collect()} == {0: 12, 1: None, 2: 12}
    back = packed.select("id", decode_latent(3)("b").alias("v"))
    assert {x.id: x.v for x in back.collect()} == {0: [1.0, 2.0, 3.0], 1: None,
                                                  2: [7.0, 8.0, 9.0]}
    with pytest.raises(Exception, match="expected 16"):
        packed.select(decode_latent(4)("b")).collect()


def test_codec_rejects_other_types(spark):
    df = spark.createDataFrame([(["a"],)], "v array<string>")
    with pytest.raises(Exception, match="must be numeric"):
        df.select(encode_latent("v")).collect()


def test_psi_from_payload_equals_the_column_form(spark):
    z = tensors(6)
    got = {x.video_index: x.psi for x in psi_from_payload(
        latent_rows(spark, z), 0.3, ["video_index"], SHAPE).collect()}
    frames = spark.createDataFrame(
        [(i, 0, t, x[t].ravel().tolist()) for i, x in enumerate(z) for t in range(SHAPE[0])],
        "seq_id long, start long, t long, z array<double>")
    by_columns = psi(frame_l1(frame_diff(frames, "z", True), True), 0.3)
    for x in by_columns.collect():
        assert got[x.seq_id] == pytest.approx(x.psi, abs=1e-6)
        assert got[x.seq_id] == pytest.approx(
            np.maximum(0, changes(z[x.seq_id]) - 0.3).sum(), abs=1e-6)
    assert got[0] == 0.0


def test_psi_as_sql_function(spark):
    z = tensors(3)
    register(spark)
    latent_rows(spark, z).createOrReplaceTempView("some_latents")
    rows = spark.sql("SELECT video_index, psi(latent_bytes, 4, 0.3D) AS psi FROM some_latents")
    for x in rows.collect():
        assert x.psi == pytest.approx(np.maximum(0, changes(z[x.video_index]) - 0.3).sum(),
                                      abs=1e-6)


def test_payload_udf_is_evaluated_once_and_reads_no_other_column(spark, tmp_path):
    path = str(tmp_path / "latents")
    latent_rows(spark, tensors(3)).write.parquet(path)
    scored = psi_from_payload(read_latents(spark, path).where("tag = 'iid_sample'"), 0.1,
                              ["video_index"], SHAPE).where("psi > 0")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert "PushedFilters: [IsNotNull(tag), EqualTo(tag,iid_sample)]" in plan
    assert "ReadSchema: struct<video_index:int,tag:string,latent_bytes:binary>" in plan


def test_check_payload(spark):
    df = latent_rows(spark, tensors(2)).unionByName(
        latent_rows(spark, tensors(2)).withColumn("latent_bytes", F.expr("X'00'"))).unionByName(
        latent_rows(spark, tensors(1)).withColumn("latent_bytes", F.lit(None).cast("binary")))
    good, bad = check_payload(df, SHAPE)
    assert (good.count(), bad.count()) == (2, 3)


def test_variance_from_parts(spark):
    z = tensors(5) + 100
    parts = moments_from_payload(latent_rows(spark, z).withColumn("batch_id", F.lit(0)),
                                 ["batch_id"])
    got = merge_moments(parts, ["batch_id"]).first()["var"]
    assert got == pytest.approx(z.astype(np.float64).var(ddof=1), rel=1e-9)


def test_index_and_listing(spark, tmp_path):
    path = str(tmp_path / "store")
    assert latent_index(spark, path).count() == 0
    assert latent_index(spark, path).columns == LATENT_KEYS
    rows = latent_rows(spark, tensors(4))
    rows.union(rows).repartition(2).write.partitionBy("tag").parquet(path)
    assert latent_index(spark, path).count() == 4
    assert index_of(rows.union(rows)).count() == 4
    shards = list_shards(spark, path).collect()
    assert len(shards) == 2 and all(x.length > 0 for x in shards)


def test_scan_address(spark, tmp_path):
    path = str(tmp_path / "store")
    latent_rows(spark, tensors(5)).coalesce(1).write.parquet(path)
    motion = scan_motion(read_latents(spark, path))
    assert sorted((x.row_index, x.m_flow) for x in motion.collect()) == [
        (i, float(i)) for i in range(5)]
    plan = motion._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<tag:string,m_flow:float" in plan
    assert "latent_bytes" not in plan
    assert with_address(read_latents(spark, path)).count() == 5


def test_defaults(spark):
    empty = spark.createDataFrame([(None,) * 7], LATENT)
    row = with_defaults(empty).first()
    assert tuple(row)[:6] == ("unknown", "unknown", -1, None, "unknown", -1.0)


def test_damaged_shard(spark, tmp_path):
    path = tmp_path / "store"
    latent_rows(spark, tensors(4)).repartition(2).write.parquet(str(path))
    (path / "sub").mkdir()
    (path / "sub" / "broken.parquet").write_bytes(b"PAR1 this is not a table")
    with pytest.raises(Exception):
        read_latents(spark, str(path)).collect()
    with pytest.raises(ValueError):
        read_latents(spark, str(path), on_error="ignore")
    assert read_latents(spark, str(path), on_error="skip").count() == 4
    assert [x.path.rsplit("/", 1)[1] for x in skipped_shards(spark, str(path)).collect()] == [
        "broken.parquet"]


def test_frame_changes_of_every_tag(spark, tmp_path):
    path = str(tmp_path / "store")
    latent_rows(spark, tensors(6), tag=lambda i: ["iid_sample", "other", None][i % 3]).write.parquet(
        path)
    latents = read_latents(spark, path)
    assert frame_changes(latents, SHAPE).count() == 2
    assert frame_changes(latents, SHAPE, tag=None).count() == 6


def test_store_epoch_of_every_tag_and_shard(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = tensors(6)
    latent_rows(spark, rows, tag=lambda i: ["iid_sample", "other", None][i % 3]).coalesce(
        1).write.parquet(path)
    latent_rows(spark, rows).limit(0).coalesce(1).write.mode("append").parquet(path)
    every = [x for split in ("train", "val") for x in store_epoch(
        spark, path, F.lit(0.0), -1.0, shape=SHAPE, split=split, n_workers=2).collect()]
    assert len(every) == 6
    names = sorted(x.path for x in list_shards(spark, path).collect())
    order = sorted(names, key=lambda s: (hashlib.md5(f"{SEED}:{s}".encode()).hexdigest(), s))
    assert len(names) == 2 and {(x.file_path, x.worker) for x in every} <= {
        (s, p % 2) for p, s in enumerate(order)}
    changes = frame_changes(read_latents(spark, path), SHAPE, tag=None)
    alone = frame_changes(read_latents(spark, path), SHAPE)
    assert calibrate(changes, 2).collect() == calibrate(alone, 2).collect()


def test_partly_damaged_shard_is_reported(spark, tmp_path):
    path = tmp_path / "store"
    rows = latent_rows(spark, tensors(400)).coalesce(1)
    rows.write.option("parquet.block.size", 16384).parquet(str(path))
    rows.limit(3).write.mode("append").parquet(str(path))
    shard = max(path.glob("*.parquet"), key=lambda f: f.stat().st_size)
    footer = pq.ParquetFile(shard).metadata
    group = footer.row_group(footer.num_row_groups - 1)
    chunk = next(group.column(i) for i in range(group.num_columns)
                 if group.column(i).path_in_schema == "latent_bytes")
    data = bytearray(shard.read_bytes())
    at = chunk.data_page_offset + chunk.total_compressed_size // 2
    data[at:at + 64] = b"\xff" * 64
    shard.write_bytes(data)
    got = skipped_shards(spark, str(path)).collect()
    read = read_latents(spark, str(path), on_error="skip").collect()
    assert [(x.rows_stored, x.rows_read) for x in got] == [(400, len(read) - 3)]
    assert len(read) < 403


def test_shard_files_close_at_the_limit(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = latent_rows(spark, tensors(10)).coalesce(1)
    write_shards(rows, path, SIZE * 4, max_bytes=SIZE * 4 * 2 + 1)
    sizes = read_latents(spark, path).groupBy(F.input_file_name()).count().collect()
    assert sorted(x["count"] for x in sizes) == [1, 3, 3, 3]


def test_assigned_shards_are_whole(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = latent_rows(spark, tensors(10)).withColumn("shard", F.col("video_index") % 3)
    write_assigned_shards(rows.repartition(4), path, ["factory_id"])
    back = read_latents(spark, path)
    per_file = back.groupBy(F.input_file_name().alias("file")).agg(
        F.count_distinct("factory_id", F.col("video_index") % 3).alias("n"),
        F.count("*").alias("rows")).collect()
    assert len(per_file) == 6 and all(x.n == 1 for x in per_file)
    assert back.count() == 10


def test_full_calibration(spark, tmp_path):
    path = str(tmp_path / "store")
    z = tensors(40, 5)
    flows = [float((7 * i) % 40) if i % 6 else -1.0 for i in range(40)]
    latent_rows(spark, z, tag=lambda i: "other" if i % 7 == 0 else "iid_sample",
                flow=lambda i: flows[i]).repartition(3).write.parquet(path)
    record = calibrate(frame_changes(read_latents(spark, path), SHAPE), n_static=10)
    sampled = [i for i in range(40) if i % 7]
    static = sorted((i for i in sampled if flows[i] >= 0), key=lambda i: flows[i])[:10]
    eps = np.percentile(np.concatenate([changes(z[i]) for i in static]), 95)
    scores = [np.maximum(0, changes(z[i]) - eps).sum() for i in sampled]
    got_eps, got_tau = thresholds(record)
    assert got_eps == pytest.approx(eps, abs=1e-6)
    assert got_tau == pytest.approx(np.percentile(scores, 20), abs=1e-5)
    row = record.first()
    assert (row.samples_used_for_epsilon, row.samples_used_for_tau) == (10, len(sampled))


def test_calibration_without_samples_raises(spark, tmp_path):
    path = str(tmp_path / "store")
    latent_rows(spark, tensors(3), tag=lambda i: "other").write.parquet(path)
    with pytest.raises(RuntimeError):
        calibrate(frame_changes(read_latents(spark, path), SHAPE))


def test_changes_keep_the_row_address(spark, tmp_path):
    path = str(tmp_path / "store")
    latent_rows(spark, tensors(3)).coalesce(1).write.parquet(path)
    out = frame_l1_from_payload(with_address(read_latents(spark, path)),
                                ["row_index", "video_index"], SHAPE).collect()
    assert {x.row_index: x.video_index for x in out} == {0: 0, 1: 1, 2: 2}
    assert all(len(x.l1) == SHAPE[0] - 1 for x in out)


def test_volatility_of_shifted_targets(spark):
    z = tensors(5) + np.float32(1e4)
    batched = latent_rows(spark, z).withColumn("batch_id", F.col("video_index") % 2)
    got = {(x.batch_id, x.direction): x.sigma
           for x in batch_volatility(batched, shape=SHAPE, pairs=3).collect()}
    for batch in (0, 1):
        own = z[batch::2].astype(np.float64)
        for direction, target in (("fwd", own[:, 1:4]), ("rev", own[:, 0:3])):
            assert got[batch, direction] == pytest.approx(
                np.sqrt(target.var(ddof=1) + 1e-8), rel=1e-9)
    with pytest.raises(ValueError):
        batch_volatility(batched, shape=SHAPE, pairs=4)


def test_what_is_wrong_with_a_payload(spark):
    eight = bytearray(8 * 4)
    rows = [(eight, [2, 2, 2], None), (None, [2, 2, 2], "missing"), (eight, None, "missing"),
            (bytearray(), [2, 2, 2], "empty"), (eight, [2, 0, 2], "empty"), (eight, [2, 4], "rank"),
            (eight, [1, 4, 2], "frames"), (eight, [2, 1, 4], "channels"), (eight, [2, 9, 2], "length"),
            (bytearray(31), [2, 2, 2], "length"), (bytearray(5 * 16), [2, 5, 2], None),
            (eight, [2, None, 2], "length")]
    df = spark.createDataFrame(rows, "latent_bytes binary, dims array<int>, want string")
    found = df.select("want", payload_problem((2, None, 2), dims="dims").alias("got")).collect()
    assert [x.got for x in found] == [x.want for x in found]
    fixed = spark.createDataFrame([(eight, 2), (bytearray(9), 3)], "latent_bytes binary, want int")
    good, bad = check_payload(fixed, (2, 4))
    assert good.columns == fixed.columns and [x.want for x in good.collect()] == [2]
    assert [(x.want, x.problem) for x in bad.collect()] == [(3, "length")]
    with pytest.raises(ValueError):
        payload_problem((2, None))
