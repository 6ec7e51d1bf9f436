import hashlib

import pytest
from pyspark.sql import functions as F

from driftgate.functions.expressions import motion_measured
from driftgate.operators import curation as C
from driftgate.plans.epoch import epoch_sample


def test_split_is_stable_disjoint_and_whole(spark):
    df = spark.range(400).select((F.col("id") % 7).alias("f"), (F.col("id") % 90).alias("v"))
    def sides(frame):
        return {(x.f, x.v): (x.bucket, x.split) for x in C.with_split(frame, "f", "v").collect()}
    one = sides(df)
    assert one == sides(df.repartition(13))
    for (f, v), (bucket, split) in one.items():
        assert bucket == int(hashlib.md5(f"{f}_{v}".encode()).hexdigest()[:8], 16) % 10
        assert split == ("val" if bucket == 0 else "train")
    marked = C.with_split(df, "f", "v")
    check = C.check_split(marked.where("split = 'train'"), marked.where("split = 'val'"),
                          ["f", "v"]).first()
    assert check.n_both == 0 and check.n_train + check.n_val == check.n_all == len(one)


def test_gate_keeps_equality_and_nan(spark):
    df = spark.createDataFrame([(0.9,), (1.0,), (float("nan"),), (2.0,)], "psi double")
    assert C.kinetic_gate(df, 1.0).count() == 3


def test_measured_motion(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (float("nan"),), (None,), (2.0,)],
                               "m_flow double")
    assert df.where(motion_measured()).count() == 2


@pytest.mark.parametrize("n_files,n_workers", [(10, 3), (2, 5), (12, 4)])
def test_round_robin(spark, n_files, n_workers):
    shards = spark.range(n_files).select(F.concat(F.lit("s"), "id").alias("shard"))
    dealt = C.assign_workers(shards, n_workers, 1).collect()
    sizes = [sum(x.worker == w for x in dealt) for w in range(n_workers)]
    assert sorted(x.pos for x in dealt) == list(range(n_files))
    assert max(sizes) - min(sizes) <= 1
    again = C.assign_workers(shards.repartition(4), n_workers, 1).collect()
    assert {x.shard: x.pos for x in dealt} == {x.shard: x.pos for x in again}
    other = C.assign_workers(shards, n_workers, 2).collect()
    assert n_files < 10 or {x.shard: x.pos for x in dealt} != {x.shard: x.pos for x in other}


def test_epoch_against_brute_force(spark):
    rows = [(f"f{i % 5}", i, f"s{i % 6}", i // 6, float(i % 11)) for i in range(600)]
    df = spark.createDataFrame(rows, "factory_id string, video_index int, file_path string, "
                                     "row_index long, psi double")
    out = epoch_sample(df, 3.0, "train", 9, 2, 40, 8).collect()
    key = lambda s: hashlib.md5(f"9:{s}".encode()).hexdigest()
    order = {s: p for p, s in enumerate(sorted({x[2] for x in rows}, key=lambda s: (key(s), s)))}
    want = []
    for worker in range(2):
        mine = sorted((x for x in rows if order[x[2]] % 2 == worker and not x[4] < 3.0
                       and int(hashlib.md5(f"{x[0]}_{x[1]}".encode()).hexdigest()[:8], 16) % 10),
                      key=lambda x: (order[x[2]], x[3]))
        want += [(worker, r, r // 8, x[1]) for r, x in enumerate(mine[:40])]
    assert sorted((x.worker, x.row, x.batch_id, x.video_index) for x in out) == sorted(want)


def test_epoch_deals_listed_files_without_scores(spark):
    rows = [(f"f{i % 5}", i, f"s{2 * (i % 3)}", i // 3, 9.0) for i in range(90)]
    df = spark.createDataFrame(rows, "factory_id string, video_index int, file_path string, "
                                     "row_index long, psi double")
    names = [f"s{i}" for i in range(6)]  # three of them have no scored row
    listing = spark.createDataFrame([(s,) for s in names], "file_path string")
    out = epoch_sample(df, 3.0, "train", 9, 2, 100, 8, listing=listing).collect()
    order = sorted(names, key=lambda s: (hashlib.md5(f"9:{s}".encode()).hexdigest(), s))
    assert out and {(x.file_path, x.worker) for x in out} <= {
        (s, p % 2) for p, s in enumerate(order)}


def test_scope_and_short_batch(spark):
    df = spark.range(20).select((F.col("id") % 2).alias("worker"), "id")
    assert C.cap_per_worker(df, ["id"], 3).count() == 6
    assert C.cap_per_worker(df, ["id"], 3, "global").count() == 3
    with pytest.raises(ValueError):
        C.cap_per_worker(df, ["id"], 3, "nowhere")
    sizes = C.with_batches(df, 8, ["id"]).groupBy("worker", "batch_id").count().collect()
    assert sorted((x.worker, x.batch_id, x["count"]) for x in sizes) == [
        (0, 0, 8), (0, 1, 2), (1, 0, 8), (1, 1, 2)]
