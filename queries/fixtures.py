"""The reference concepts on the test tables, as DataFrames and as SQL subqueries.

- scalar frames: one sequence per user of `events`, ordered by time;
- vector frames: one sequence per label of `embeddings`, ordered by id;
- windows of 8 frames; a window's tag is its first event type, its motion the mean absolute
  change, or the sentinel when it ends in an error;
- a latent store: the vector windows as float32 payloads in Parquet shards.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from driftgate.functions.payload import encode_latent, payload_size
from driftgate.operators.frames import (
    TUBELET, frame_diff, frame_l1, psi, tubelets,
)
from driftgate.operators.ordering import index_rows
from driftgate.schema import LATENT
from driftgate.session import scratch_path
from driftgate.sources.latents import read_latents

W = 8
DIM = 64
SHAPE = (W, DIM)
EV_EPS = 5.0
EM_EPS = 0.13
SAMPLED = "view"


def table(spark: SparkSession, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark, sf_dir, name) -> int:
    """Row count from the footers: the size bound of what is derived from the table."""
    return table(spark, sf_dir, name).count()


def r(col, places=6):
    return F.round(col, places)


# --- scalar frames -----------------------------------------------------------

def ev_frames(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("seq_id"), "ts", "event_id", F.col("value").alias("x"),
        "event_type")
    return index_rows(events, ["seq_id"], ["ts", "event_id"])


def ev_tubelets(spark, sf_dir):
    return tubelets(ev_frames(spark, sf_dir), W)


def ev_l1(spark, sf_dir):
    return frame_l1(frame_diff(ev_tubelets(spark, sf_dir), "x"))


def ev_psi(spark, sf_dir, eps=EV_EPS):
    return psi(ev_l1(spark, sf_dir), eps)


def ev_meta(spark, sf_dir):
    """One row per window: tag, motion, shard, row in the shard, factory, frame changes."""
    windows = ev_tubelets(spark, sf_dir)
    before = F.lag("x").over(Window.partitionBy(*TUBELET).orderBy("t"))
    changes = windows.withColumn("l1", F.abs(F.col("x") - before))
    by_t = F.sort_array(F.collect_list(F.when(F.col("t") > 0, F.struct("t", "l1"))))
    return (changes.groupBy(*TUBELET).agg(
        F.max(F.when(F.col("t") == 0, F.col("event_type"))).alias("tag"),
        F.max(F.when(F.col("t") == W - 1, F.col("event_type"))).alias("_last"),
        F.max(F.when(F.col("t") == 0, F.col("event_id"))).alias("row"),
        F.avg("l1").alias("_motion"), by_t["l1"].alias("l1"))
        .withColumn("m_flow", F.when(F.col("_last") == "error", -1.0)
                    .otherwise(F.col("_motion")))
        .withColumn("shard", F.col("seq_id") % 16).withColumn("factory", F.col("seq_id") % 8)
        .drop("_last", "_motion"))


EV_FRAMES = """ev_frames AS (
  SELECT user_id AS seq_id, event_id, event_type, value AS x,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx
  FROM events)"""
EV_TUB = """ev_tub AS (
  SELECT *, idx - idx % 8 AS start, idx % 8 AS t FROM ev_frames
  QUALIFY count(*) OVER (PARTITION BY seq_id, idx - idx % 8) = 8)"""
EV_L1 = """ev_l1 AS (
  SELECT seq_id, start, t,
         abs(x - lag(x) OVER (PARTITION BY seq_id, start ORDER BY t)) AS l1
  FROM ev_tub QUALIFY t > 0)"""
EV_PSI = f"""ev_psi AS (
  SELECT seq_id, start, sum(greatest(0.0, l1 - {EV_EPS})) AS psi
  FROM ev_l1 GROUP BY seq_id, start)"""
EV_META = """ev_meta AS (
  SELECT w.seq_id, w.start, max(CASE WHEN t = 0 THEN event_type END) AS tag,
         max(CASE WHEN t = 0 THEN event_id END) AS row,
         CASE WHEN max(CASE WHEN t = 7 THEN event_type END) = 'error' THEN -1.0
              ELSE max(m.motion) END AS m_flow,
         w.seq_id % 16 AS shard, w.seq_id % 8 AS factory
  FROM ev_tub w JOIN (SELECT seq_id, start, avg(l1) AS motion FROM ev_l1
                      GROUP BY seq_id, start) m
    ON w.seq_id = m.seq_id AND w.start = m.start
  GROUP BY w.seq_id, w.start)"""
EV = [EV_FRAMES, EV_TUB]
EV_WITH_L1 = [*EV, EV_L1]
EV_WITH_PSI = [*EV_WITH_L1, EV_PSI]
EV_WITH_META = [*EV_WITH_L1, EV_META]


# --- vector frames -----------------------------------------------------------

def em_frames(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("seq_id"), "vec_id", F.col("embedding").alias("z"))
    return index_rows(vectors, ["seq_id"], ["vec_id"])


def em_tubelets(spark, sf_dir):
    return tubelets(em_frames(spark, sf_dir), W)


def em_l1(spark, sf_dir):
    return frame_l1(frame_diff(em_tubelets(spark, sf_dir), "z", vector=True), vector=True)


EM_FRAMES = """em_frames AS (
  SELECT CAST(label AS BIGINT) AS seq_id, vec_id, embedding AS z,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx
  FROM embeddings)"""
EM_TUB = """em_tub AS (
  SELECT *, idx - idx % 8 AS start, idx % 8 AS t FROM em_frames
  QUALIFY count(*) OVER (PARTITION BY seq_id, idx - idx % 8) = 8)"""
EM_L1 = """em_l1 AS (
  SELECT seq_id, start, t, list_avg(list_transform(list_zip(z, before),
           lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS l1
  FROM (SELECT *, lag(z) OVER (PARTITION BY seq_id, start ORDER BY t) AS before FROM em_tub)
  WHERE t > 0)"""
EM_PSI = f"""em_psi AS (
  SELECT seq_id, start, sum(greatest(0.0, l1 - {EM_EPS})) AS psi
  FROM em_l1 GROUP BY seq_id, start)"""
EM = [EM_FRAMES, EM_TUB]
EM_WITH_L1 = [*EM, EM_L1]
EM_WITH_PSI = [*EM_WITH_L1, EM_PSI]


# --- latent store ------------------------------------------------------------

def latent_rows(spark, sf_dir, whole=True):
    """Vector windows in the latent schema. `whole=False` keeps the short tails too."""
    frames = em_frames(spark, sf_dir)
    windows = (tubelets(frames, W) if whole else
               frames.withColumn("start", F.col("idx") - F.col("idx") % W)
               .withColumn("t", F.col("idx") % W))
    before = F.lag("z").over(Window.partitionBy(*TUBELET).orderBy("t"))
    change = F.aggregate(F.zip_with("z", "_before", lambda a, b: F.abs(a - b).cast("double")),
                         F.lit(0.0), lambda acc, x: acc + x) / DIM
    # One window per group, so each list has at most W frames.
    packed = (windows.withColumn("_before", before).groupBy(*TUBELET).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("t", "z"))),
                              lambda f: f["z"])).alias("values"),
        F.avg(change).alias("motion"), F.min("vec_id").alias("first_id")))
    return packed.select(
        F.concat(F.lit("factory_"), (F.col("seq_id") % 4).cast("string")).alias("factory_id"),
        F.concat(F.lit("worker_"), F.col("seq_id").cast("string")).alias("worker_id"),
        F.col("seq_id").cast("int").alias("video_index"),
        F.col("start").cast("int").alias("tubelet_start"),
        F.when(F.col("first_id") % 3 == 0, "other").otherwise("iid_sample").alias("tag"),
        F.when(F.col("first_id") % 5 == 0, -1.0).otherwise(F.col("motion"))
        .cast("float").alias("m_flow"),
        encode_latent("values").alias("latent_bytes")).select(*LATENT.names)


def latent_store(spark, sf_dir, whole=True):
    """Path of a store written from the vector windows."""
    path = scratch_path(spark, "latents")
    latent_rows(spark, sf_dir, whole).write.parquet(path)
    return path


def payload_rows(spark, sf_dir):
    """The store's rows for reading payloads: batches bounded by the size of one."""
    return read_latents(spark, latent_store(spark, sf_dir), payload_bytes=payload_size(SHAPE))


LATENTS = """latents AS (
  SELECT 'factory_' || (w.seq_id % 4) AS factory_id, 'worker_' || w.seq_id AS worker_id,
         CAST(w.seq_id AS INTEGER) AS video_index, CAST(w.start AS INTEGER) AS tubelet_start,
         CASE WHEN min(vec_id) % 3 = 0 THEN 'other' ELSE 'iid_sample' END AS tag,
         CASE WHEN min(vec_id) % 5 = 0 THEN -1.0 ELSE avg(l.l1) END AS m_flow,
         w.seq_id, w.start
  FROM em_tub w LEFT JOIN em_l1 l
    ON w.seq_id = l.seq_id AND w.start = l.start AND w.t = l.t
  GROUP BY w.seq_id, w.start)"""
EM_WITH_LATENTS = [*EM_WITH_L1, LATENTS]
