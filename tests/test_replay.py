"""Epochs over a store that grows."""

import pytest
from pyspark.sql import functions as F

from driftgate.functions.payload import psi_from_payload
from driftgate.plans.replay import Replay, steps_per_epoch
from driftgate.streaming.shards import stream_latents
from tests.test_payload import SHAPE, latent_rows, tensors

KEEP = ["factory_id", "video_index", "file_path", "row_index"]


def test_steps():
    assert (steps_per_epoch(5000, 8), steps_per_epoch(), steps_per_epoch(7, 8)) == (625, 625, 100)


def landing(spark, root, low, high):
    z = tensors(40)
    latent_rows(spark, z).where((F.col("video_index") >= low) & (F.col("video_index") < high)).coalesce(
        1).write.mode("append").parquet(root)


def server(spark, root, store, **options):
    stream = stream_latents(spark, root).select("*", "_metadata.file_path", "_metadata.row_index")
    return Replay(spark, psi_from_payload(stream, 0.1, KEEP, SHAPE), store, 0.0, 4,
                  n_workers=2, cap=5, batch_size=2, **options)


def test_passes_follow_one_another(spark, tmp_path):
    root, store = str(tmp_path / "in"), str(tmp_path / "store")
    landing(spark, root, 0, 12)
    one = server(spark, root, store).next_epoch()
    assert {x.step for x in one.collect()} == {0, 1, 2, 3}
    landing(spark, root, 12, 40)
    # Another session goes on with the second epoch.
    two = server(spark, root, store).next_epoch().collect()
    assert {(x.epoch, x.step) for x in two} == {(2, i) for i in range(4)}
    rows = sorted([*one.collect(), *two], key=lambda x: (x.epoch, x.step))
    steps = {(x.epoch, x.step): (x["pass"], x.seed, x.worker, x.batch_id) for x in rows}
    assert len(steps) == 8
    seeds = {x["pass"]: x.seed for x in rows}
    assert seeds[0] == 42
    for number in range(1, max(seeds) + 1):
        epoch, step = min(k for k, v in steps.items() if v[0] == number)
        assert seeds[number] == epoch + step  # told by where the pass begins
    first = {x.video_index for x in rows if x["pass"] == 0}
    assert max(first) < 12 and len({x.video_index for x in rows if x["pass"] == 0}) == sum(
        x["pass"] == 0 for x in rows)  # nothing twice in a pass
    assert any(x.video_index >= 12 for x in rows if x.epoch == 2 and x["pass"] > 0)
    for number in seeds:  # workers take turns
        turns = [(v[3], v[2]) for k, v in sorted(steps.items()) if v[0] == number]
        assert turns == sorted(turns)


def test_an_epoch_cut_short_is_made_again(spark, tmp_path):
    root, store = str(tmp_path / "in"), str(tmp_path / "store")
    landing(spark, root, 0, 12)
    replay = server(spark, root, store)
    key = lambda x: (x.step, x.worker, x.row, x.video_index)
    want = sorted(map(key, replay.next_epoch().collect()))
    import shutil
    shutil.rmtree(f"{store}/state")  # as if the epoch had been lost before it was recorded
    assert sorted(map(key, server(spark, root, store).next_epoch().collect())) == want


def test_nothing_to_serve(spark, tmp_path):
    root = str(tmp_path / "in")
    landing(spark, root, 0, 3)
    stream = stream_latents(spark, root).select("*", "_metadata.file_path", "_metadata.row_index")
    replay = Replay(spark, psi_from_payload(stream, 0.1, KEEP, SHAPE), str(tmp_path / "store"), 1e9, 2)
    with pytest.raises(RuntimeError, match="no batch"):
        replay.next_epoch()
