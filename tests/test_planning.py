import random

import pytest
from pyspark.sql import functions as F

from driftgate.operators import planning as P
from driftgate.plans.extraction import window_starts, work_list
from driftgate.schema import LATENT_KEYS


@pytest.mark.parametrize("done,n", [(0, 4), (13, 4), (97, 7), (100, 3), (250, 3)])
def test_quotas(spark, done, n):
    counted = spark.range(done).agg(F.count("*"))
    quotas = [x.quota for x in P.shard_quotas(spark, counted, 100, n).orderBy("shard").collect()]
    if done >= 100:
        assert quotas == []
    else:
        assert sum(quotas) == 100 - done and max(quotas) - min(quotas) <= 1
        assert quotas == sorted(quotas, reverse=True)


@pytest.mark.parametrize("n", [1, 3, 8, 12])
def test_factory_chunks(spark, n):
    names = [f"factory_{i:03d}" for i in range(8)]
    df = spark.createDataFrame([(x,) for x in names], "factory_id string")
    got = {x.factory_id: x.shard for x in P.shard_factories(df, n).collect()}
    size = len(names) // n
    want = {}
    for shard in range(n):
        end = (shard + 1) * size if shard < n - 1 else len(names)
        want |= {f: shard for f in names[shard * size:end]}
    assert got == want


def test_todo_matches_null_keys(spark):
    schema = "factory_id string, worker_id string, video_index int, tubelet_start int"
    index = spark.createDataFrame([("a", None, 0, 0), ("b", "w", 1, 64)], schema)
    cand = spark.createDataFrame([("a", None, 0, 0), ("a", "w", 0, 0), ("b", "w", 1, 64),
                                  (None, None, None, None)], schema)
    left = {tuple(x) for x in P.todo(cand, index).collect()}
    assert left == {("a", "w", 0, 0), (None, None, None, None)}


def test_dedup_picks_the_least_and_merges_copies(spark):
    rows = [("k", i % 50, f"v{i % 50}") for i in range(1000)] + [("m", 3, "z"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "key string, at int, v string").repartition(8)
    out = {x.key: (x.at, x.v) for x in P.dedup(df, ["at"], ["key"]).collect()}
    assert out == {"k": (0, "v0"), "m": (3, "z"), None: (1, "n")}


def test_index_operators(spark):
    old = spark.createDataFrame([("a", "w", 0, 0)], ",".join(
        f"{k} {t}" for k, t in zip(LATENT_KEYS, ("string", "string", "int", "int"))))
    new = old.union(old).union(spark.createDataFrame([("a", "w", 0, 64)], old.schema))
    merged = P.merge_index(old, new)
    assert merged.count() == 2
    assert tuple(P.progress(merged, 2).first()) == (2, 2, 0, True)
    assert tuple(P.progress(merged, 5).first()) == (2, 5, 3, False)
    assert P.gather([old, new]).count() == 4


def brute_shards(sizes, limit):
    shard, held, out = 0, 0, []
    for size in sizes:
        out.append(shard)
        held += size
        if held >= limit:
            shard, held = shard + 1, 0
    return out


@pytest.mark.parametrize("block_rows", [1, 2, 7, 50, 65_536])
@pytest.mark.parametrize("limit", [1, 30, 400, 10_000])
def test_shards_equal_the_sequential_rule(spark, block_rows, limit):
    rng = random.Random(limit)
    writers = {"hot": 160, "small": 3, None: 40, "even": 30}
    rows, want = [], {}
    for writer, n in writers.items():
        sizes = [20] * n if writer == "even" else [
            rng.choice([0, 1, 5, 29, 30, 31, 90]) for _ in range(n)]
        rows += [(writer, i, s) for i, s in enumerate(sizes)]
        want |= {(writer, i): s for i, s in enumerate(brute_shards(sizes, limit))}
    df = spark.createDataFrame(rows, "writer string, at int, size int").repartition(3)
    # A fan of 3 makes a tree of up to five levels of 160 blocks.
    out = P.assign_shards(df, ["writer"], ["at"], "size", limit, block_rows, fan=3)
    assert out.columns == ["writer", "at", "size", "shard"]
    assert {(x.writer, x.at): x.shard for x in out.collect()} == want


def test_videos_are_numbered_after_the_length_test(spark):
    df = spark.createDataFrame([("f", i, 10 * i) for i in range(20)],
                               "factory_id string, key int, n_frames int")
    out = P.select_videos(df, "key", F.col("n_frames") >= 64, 5, 1).collect()
    assert sorted(x.video_index for x in out) == list(range(5))
    assert all(x.n_frames >= 64 for x in out)
    places = {x.key: x.pos for x in P.shuffle_videos(df, "key", 1).collect()}
    accepted = sorted((k for k in places if 10 * k >= 64), key=places.get)
    assert [x.key for x in sorted(out, key=lambda x: x.video_index)] == accepted[:5]


def test_work_list_skips_stored_and_keeps_the_quota(spark):
    videos = spark.createDataFrame([("f", "w", i, 64 * (i % 4)) for i in range(12)],
                                   "factory_id string, worker_id string, k int, n_frames int")
    everything = work_list(videos, window_starts(videos).limit(0).withColumn(
        "video_index", F.lit(0)), "k", 1000)
    assert everything.count() == 3 * (1 + 2 + 3)
    stored = everything.orderBy("video_index", "tubelet_start").limit(4)
    rest = work_list(videos, stored, "k", 10)
    assert rest.count() == 6
    assert rest.join(stored, LATENT_KEYS, "left_semi").count() == 0


@pytest.mark.parametrize("n", [0, 1, 10, 99, 100, 500])
def test_one_quota(spark, n):
    df = spark.range(100).withColumn("x", 100 - F.col("id")).repartition(3)
    got = sorted(x.id for x in P.take_quota(df, n, ["x"]).collect())
    assert got == list(range(max(0, 100 - n), 100))


def test_quota_of_each_group(spark):
    rng = random.Random(5)
    rows = [(g, rng.random(), i) for g, n in (("hot", 900), ("small", 5), (None, 40), ("none", 30))
            for i in range(n)]
    quotas = {"hot": 411, "small": 9, None: 17, "empty": 4}
    df = spark.createDataFrame(rows, "g string, x double, i int").repartition(5)
    given = spark.createDataFrame(list(quotas.items()), "g string, quota long")
    got = sorted(((x.g or "", x.x) for x in P.take_quota(df, given, ["x", "i"], ["g"]).collect()))
    want = sorted((g or "", x) for g, n in quotas.items()
                  for x in sorted(r[1] for r in rows if r[0] == g)[:n])
    assert got == want


@pytest.mark.parametrize("most,per", [(4, (1, 4)), (4, (0, 1)), (1, (0, 1)), (50, (0, 9))])
def test_no_archive_beyond_the_last_video_is_opened(spark, most, per):
    rng = random.Random(most)
    rows = [(f, f"{f}/a{k}.tar", i, rng.random() < 0.7) for f, n in (("f1", 40), ("f2", 3), ("f3", 20))
            for k in range(n) for i in range(rng.randint(*per))]
    empty = [("f3", "f3/none.tar")]
    videos = spark.createDataFrame(rows, "factory_id string, path string, at int, ok boolean")
    archives = spark.createDataFrame(
        sorted({r[:2] for r in rows} | set(empty)), "factory_id string, path string")
    chosen, opened = P.select_from_archives(
        archives, lambda a: videos.join(a, ["factory_id", "path"]), F.col("ok"), most, 12, 7)
    places = {x.path: x.pos for x in P.shuffle_videos(archives, "path", 7).collect()}
    want, needed = {}, set()
    for factory in ("f1", "f2", "f3"):
        taken = 0
        for path in sorted((p for p in places if p.startswith(factory)), key=places.get):
            if taken < 12:
                needed.add(path)
            for _, _, at, ok in sorted(r for r in rows if r[1] == path):
                if ok and taken < 12:
                    want[path, at] = taken
                    taken += 1
    assert {(x.path, x.at): x.video_index for x in chosen.collect()} == want
    assert sorted(x.path for x in opened.collect()) == sorted(needed)


def test_no_archives(spark):
    none = spark.createDataFrame([], "factory_id string, path string")
    chosen, opened = P.select_from_archives(
        none, lambda a: a.withColumns({"at": F.lit(1), "ok": F.lit(True)}), F.col("ok"), 4)
    assert chosen.count() == opened.count() == 0
    assert chosen.columns == ["factory_id", "path", "at", "ok", "video_index"]


@pytest.mark.parametrize("n_shards", [2, 5])
def test_work_list_of_each_shard(spark, n_shards):
    videos = spark.createDataFrame([(f"f{i % 3}", "w", i, 64 * (1 + i % 4)) for i in range(24)],
                                   "factory_id string, worker_id string, k int, n_frames int")
    none = window_starts(videos).limit(0).withColumn("video_index", F.lit(0))
    out = work_list(videos, none, "k", 20, n_shards=n_shards).collect()
    per_shard = {s: sum(x.shard == s for x in out) for s in range(n_shards)}
    # With more shards than factories the last shard has them all, but only its own quota.
    assert per_shard == ({0: 10, 1: 10} if n_shards == 2 else {0: 0, 1: 0, 2: 0, 3: 0, 4: 4})
    assert {x.factory_id for x in out if x.shard == 0} <= {"f0"}


def test_factory_restriction_by_list_and_table(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "factory_id string, v int")
    wanted = spark.createDataFrame([("a",), ("a",), ("c",)], "factory_id string")
    assert {x.v for x in P.for_factories(df, ["b"]).collect()} == {2}
    assert sorted(x.v for x in P.for_factories(df, wanted).collect()) == [1, 3]
