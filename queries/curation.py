"""Split, gate, shuffle, workers, caps, batches, epochs."""

from pyspark.sql import functions as F

from driftgate.functions.payload import check_payload
from driftgate.operators import curation as C
from driftgate.operators.frames import min_length, with_duration
from driftgate.plans.calibrate import scores
from driftgate.plans.epoch import epoch_sample
from driftgate.session import materialize
from driftgate.sources.latents import read_latents
from queries.fixtures import (
    EM_FRAMES, EV_EPS, EV_PSI, EV_WITH_META, EV_WITH_PSI, SHAPE, ev_meta, ev_psi, latent_rows,
    latent_store, r, table,
)
from queries.registry import query, sql

SEED = 42
N_WORKERS = 4
CAP = 100
TAU = 150.0


def bucket_sql(factory, video):
    digest = f"md5({factory} || '_' || {video})"
    return f"CAST(('0x' || substr({digest}, 1, 8))::UBIGINT % 10 AS BIGINT)"


def hash_sql(key, seed=SEED):
    return f"md5('{seed}:' || {key})"


ORDER_SPLIT = f"""order_split AS (
  SELECT o_orderkey, o_custkey, {bucket_sql('o_custkey % 8', 'o_custkey')} AS bucket
  FROM orders)"""


def order_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_custkey") % 8).alias("factory"))
    return C.with_split(orders, "factory", "o_custkey")


@query("split_assign", sql(ORDER_SPLIT, select="""
SELECT o_orderkey, bucket, CASE WHEN bucket = 0 THEN 'val' ELSE 'train' END AS split
FROM order_split"""))
def split_assign(spark, sf_dir):
    return order_split(spark, sf_dir).select("o_orderkey", "bucket", "split")


@query("split_check", sql(ORDER_SPLIT, select="""
SELECT count(DISTINCT CASE WHEN bucket != 0 THEN o_custkey END) AS n_train,
       count(DISTINCT CASE WHEN bucket = 0 THEN o_custkey END) AS n_val,
       (SELECT count(*) FROM (SELECT o_custkey FROM order_split WHERE bucket = 0 INTERSECT
                              SELECT o_custkey FROM order_split WHERE bucket != 0)) AS n_both,
       count(DISTINCT o_custkey) AS n_all FROM order_split"""))
def split_check(spark, sf_dir):
    split = order_split(spark, sf_dir)
    return C.check_split(split.where(F.col("split") == "train"),
                         split.where(F.col("split") == "val"), ["o_custkey"])


@query("durations", """
SELECT doc_id, n_chars // 96 AS n_frames, (n_chars // 96) / 4.0 AS seconds FROM documents""")
def durations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return with_duration(docs, "n_chars", 96).drop("n_chars")


@query("min_length", """
SELECT user_id AS seq_id, count(*) AS n_frames FROM events GROUP BY user_id
HAVING count(*) >= 64""")
def min_length_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("seq_id"))
    return min_length(events)


@query("payload_check", sql(EM_FRAMES, select="""
SELECT worker_id, count(CASE WHEN n = 8 THEN 1 END) AS n_good,
       count(CASE WHEN n != 8 THEN 1 END) AS n_bad
FROM (SELECT 'worker_' || seq_id AS worker_id, idx - idx % 8 AS start, count(*) AS n
      FROM em_frames GROUP BY ALL) GROUP BY worker_id"""))
def payload_check(spark, sf_dir):
    latents = read_latents(spark, latent_store(spark, sf_dir, whole=False))
    good, bad = check_payload(latents, SHAPE)
    marked = good.select("worker_id", F.lit(1).alias("ok")).unionByName(
        bad.select("worker_id", F.lit(0).alias("ok")))
    return marked.groupBy("worker_id").agg(F.sum("ok").alias("n_good"),
                                           F.sum(1 - F.col("ok")).alias("n_bad"))


@query("payload_problems", sql(EM_FRAMES, """
windows AS (SELECT seq_id, idx - idx % 8 AS start, count(*) AS n FROM em_frames
            GROUP BY seq_id, idx - idx % 8)""", select="""
SELECT CASE WHEN seq_id % 5 = 0 THEN 'missing' WHEN seq_id % 5 = 1 THEN 'rank'
            WHEN start % 64 = 8 THEN 'empty' WHEN n != 8 THEN 'frames'
            WHEN start % 64 = 16 THEN 'channels' WHEN start % 64 = 24 THEN 'length' ELSE 'none' END
         AS problem, count(*) AS n FROM windows GROUP BY 1"""))
def payload_problems(spark, sf_dir):
    """Windows with the shape that each row states, of which some are made wrong."""
    rows = latent_rows(spark, sf_dir, whole=False)
    frames = (F.octet_length("latent_bytes") / 256).cast("int")
    kind, place = F.col("video_index") % 5, F.col("tubelet_start") % 64
    dims = F.when(kind == 1, F.array(frames)).when(place == 16, F.array(frames, F.lit(3))).otherwise(
        F.array(frames, F.lit(64)))
    payload = F.when(kind == 0, None).when(place == 8, F.lit(b"")).when(
        place == 24, F.substring("latent_bytes", 1, 7)).otherwise(F.col("latent_bytes"))
    rows = rows.withColumn("dims", dims).withColumn("latent_bytes", payload)
    good, bad = check_payload(rows, SHAPE, dims="dims")
    return good.withColumn("problem", F.lit("none")).unionByName(bad).groupBy("problem").agg(
        F.count("*").alias("n"))


@query("kinetic_gate", sql(*EV_WITH_PSI, select=f"""
SELECT seq_id, start, round(psi, 6) AS psi FROM ev_psi WHERE NOT psi < {TAU}"""))
def kinetic_gate(spark, sf_dir):
    return C.kinetic_gate(ev_psi(spark, sf_dir), TAU).withColumn("psi", r("psi"))


# --- shuffled shards, workers, caps, batches ---------------------------------

FILES = f"""files AS (
  SELECT path, row_number() OVER (ORDER BY {hash_sql('path')}, path) - 1 AS pos
  FROM (SELECT DISTINCT source || '/' || lang AS path FROM documents))"""


def files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat_ws("/", "source", "lang").alias("path")).distinct()


@query("shuffle_shards", sql(FILES, select="SELECT path, pos FROM files"))
def shuffle_shards(spark, sf_dir):
    return C.shuffle_shards(files(spark, sf_dir), SEED, "path")


@query("assign_workers", sql(FILES, select=f"""
SELECT path, pos, pos % {N_WORKERS} AS worker FROM files"""))
def assign_workers(spark, sf_dir):
    return C.assign_workers(files(spark, sf_dir), N_WORKERS, SEED, "path")


ORDER_WORKERS = f"""shards AS (
  SELECT shard, row_number() OVER (ORDER BY {hash_sql('shard')}, shard) - 1 AS pos
  FROM (SELECT DISTINCT o_custkey % 32 AS shard FROM orders)),
dealt AS (SELECT o_orderkey, pos, pos % {N_WORKERS} AS worker
          FROM orders JOIN shards ON o_custkey % 32 = shard)"""


def order_workers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 32).alias("shard"))
    shards = C.assign_workers(orders.select("shard").distinct(), N_WORKERS, SEED)
    return orders.join(shards, "shard").drop("shard")


@query("cap_per_worker", sql(ORDER_WORKERS, select=f"""
SELECT o_orderkey, pos, worker, row_number() OVER (
  PARTITION BY worker ORDER BY pos, o_orderkey) - 1 AS row
FROM dealt QUALIFY row < {CAP}"""))
def cap_per_worker(spark, sf_dir):
    return C.cap_per_worker(order_workers(spark, sf_dir), ["pos", "o_orderkey"], CAP)


@query("cap_global", sql(ORDER_WORKERS, select=f"""
SELECT o_orderkey, pos, worker, row_number() OVER (ORDER BY pos, o_orderkey) - 1 AS row
FROM dealt QUALIFY row < {CAP}"""))
def cap_global(spark, sf_dir):
    return C.cap_per_worker(order_workers(spark, sf_dir), ["pos", "o_orderkey"], CAP, "global")


@query("batches", sql(ORDER_WORKERS, select="""
SELECT o_orderkey, worker, row_number() OVER w - 1 AS row, (row_number() OVER w - 1) // 8
  AS batch_id FROM dealt WINDOW w AS (PARTITION BY worker ORDER BY pos, o_orderkey)"""))
def batches(spark, sf_dir):
    return C.with_batches(order_workers(spark, sf_dir), 8, ["pos", "o_orderkey"]).drop("pos")


@query("epoch_sample", sql(*EV_WITH_META, EV_PSI, f"""
scored AS (SELECT m.*, psi, {bucket_sql('factory', 'm.seq_id')} AS bucket
           FROM ev_meta m JOIN ev_psi p ON m.seq_id = p.seq_id AND m.start = p.start),
shards AS (SELECT shard, row_number() OVER (ORDER BY {hash_sql('shard')}, shard) - 1 AS pos
           FROM (SELECT DISTINCT shard FROM scored)),
kept AS (SELECT s.*, pos, pos % {N_WORKERS} AS worker FROM scored s JOIN shards USING (shard)
         WHERE bucket != 0 AND NOT psi < {TAU})""", select=f"""
SELECT seq_id, start, shard, worker, row_number() OVER w - 1 AS row,
       (row_number() OVER w - 1) // 8 AS batch_id, round(psi, 6) AS psi
FROM kept WINDOW w AS (PARTITION BY worker ORDER BY pos, row)
QUALIFY row_number() OVER w <= {CAP}"""))
def epoch_sample_query(spark, sf_dir):
    # Scores do not depend on the epoch: stored once, then read by every epoch.
    scored = materialize(scores(ev_meta(spark, sf_dir), F.lit(EV_EPS)), "scores").select(
        "seq_id", "start", "shard", F.col("row").alias("at"), "psi",
        F.col("factory").alias("factory_id"), F.col("seq_id").alias("video_index"))
    return epoch_sample(scored, TAU, "train", SEED, N_WORKERS, CAP, 8, "shard", "at").select(
        "seq_id", "start", "shard", "worker", "row", "batch_id", r("psi").alias("psi"))
