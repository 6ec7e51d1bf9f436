"""Manifests, video selection, resume, quotas, index merges, shard assignment."""

from pyspark.sql import functions as F

from driftgate.operators import planning as P
from driftgate.plans.extraction import window_starts, work_list
from driftgate.sources.archives import archive_manifest
from queries.curation import hash_sql
from queries.fixtures import table
from queries.registry import query, sql

SEED = 42
FACTORIES = ["src1", "src4", "src7", "src11"]
TARGET = 20_000
SHARD_LIMIT = 20_000

ARCHIVE_PATH = """source || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '/workers/worker_' || lang END
  || '/part' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.json' ELSE '.tar' END"""


@query("archive_manifest", sql(f"""
paths AS (SELECT doc_id, source, lang, {ARCHIVE_PATH} AS path FROM documents)""", select="""
SELECT doc_id, path, source AS factory_id,
       CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE 'worker_' || lang END AS worker_id
FROM paths WHERE doc_id % 3 != 0 AND source IN ('src1', 'src4', 'src7', 'src11')"""))
def archive_manifest_query(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select("doc_id", F.expr(ARCHIVE_PATH).alias("path"))
    return archive_manifest(paths, FACTORIES)


def videos(spark, sf_dir):
    """Documents in the part of videos."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("factory_id"), F.col("lang").alias("worker_id"), "doc_id",
        F.floor(F.col("n_chars") / 10).alias("n_frames"))


@query("select_videos", f"""
SELECT source AS factory_id, lang AS worker_id, doc_id, n_chars // 10 AS n_frames,
       row_number() OVER (PARTITION BY source ORDER BY {hash_sql('doc_id')}, doc_id) - 1
         AS video_index
FROM documents WHERE n_chars // 10 >= 64 QUALIFY video_index < 20""")
def select_videos(spark, sf_dir):
    return P.select_videos(videos(spark, sf_dir), "doc_id", F.col("n_frames") >= 64, 20, SEED)


@query("shuffle_videos", f"""
SELECT source AS factory_id, doc_id,
       row_number() OVER (PARTITION BY source ORDER BY {hash_sql('doc_id')}, doc_id) - 1 AS pos
FROM documents""")
def shuffle_videos(spark, sf_dir):
    return P.shuffle_videos(videos(spark, sf_dir).select("factory_id", "doc_id"), "doc_id", SEED)


@query("for_factories", """
SELECT doc_id, source AS factory_id FROM documents
WHERE source IN (SELECT source FROM documents WHERE lang = 'de' AND n_chars > 8000)""")
def for_factories(spark, sf_dir):
    docs = videos(spark, sf_dir).select("doc_id", "factory_id", "worker_id", "n_frames")
    wanted = docs.where((F.col("worker_id") == "de") & (F.col("n_frames") > 800))
    return P.for_factories(docs, wanted).select("doc_id", "factory_id")


def plan_sql(n):
    return f"""
WITH todo AS (SELECT {TARGET} - (SELECT count(DISTINCT o_orderkey) FROM orders) AS rest),
shards AS (SELECT unnest(range({n})) AS shard),
facts AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS pos,
                 count(*) OVER () // {n} AS size
          FROM (SELECT DISTINCT source FROM documents)),
cut AS (SELECT source, CASE WHEN size = 0 THEN {n} - 1
                       ELSE least(pos // greatest(size, 1), {n} - 1) END AS shard FROM facts)
SELECT s.shard, rest // {n} + CASE WHEN s.shard < rest % {n} THEN 1 ELSE 0 END AS quota,
       (SELECT string_agg(source, ',' ORDER BY source) FROM cut c WHERE c.shard = s.shard)
         AS factories
FROM shards s, todo WHERE rest > 0"""


def plan_shards(spark, sf_dir, n):
    done = table(spark, sf_dir, "orders").agg(F.count_distinct("o_orderkey"))
    factories = table(spark, sf_dir, "documents").select(
        F.col("source").alias("factory_id")).distinct()
    chunks = P.shard_factories(factories, n).groupBy("shard").agg(
        F.array_join(F.sort_array(F.collect_list("factory_id")), ",").alias("factories"))
    return P.shard_quotas(spark, done, TARGET, n).join(chunks, "shard", "left")


@query("plan_shards", plan_sql(7))
def plan_shards_query(spark, sf_dir):
    return plan_shards(spark, sf_dir, 7)


@query("plan_more_shards_than_factories", plan_sql(32))
def plan_more_shards(spark, sf_dir):
    return plan_shards(spark, sf_dir, 32)


@query("progress", """
SELECT count(*) AS done, CAST(50000 AS BIGINT) AS target, greatest(0, 50000 - count(*)) AS remaining,
       count(*) >= 50000 AS reached
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def progress(spark, sf_dir):
    return P.progress(table(spark, sf_dir, "lineitem"), 50_000, ["l_orderkey", "l_linenumber"])


@query("dedup_ids", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                           ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1""")
def dedup_ids(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return P.dedup(items, ["l_partkey", "l_suppkey", "l_extendedprice"],
                   ["l_orderkey", "l_linenumber"])


NULL_KEYED = """SELECT o_orderkey, o_orderstatus,
  CASE WHEN o_custkey % 5 != 0 THEN o_custkey END AS cust,
  CASE WHEN o_orderkey % 7 != 0 THEN o_orderpriority END AS prio FROM orders"""


def null_keyed(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "CASE WHEN o_custkey % 5 != 0 THEN o_custkey END AS cust",
        "CASE WHEN o_orderkey % 7 != 0 THEN o_orderpriority END AS prio")


def new_orders(spark, sf_dir):
    orders = null_keyed(spark, sf_dir)
    stored = orders.where(F.col("o_orderstatus") == "F")
    return P.todo(orders.where(F.col("o_orderstatus") != "F"), stored, ["cust", "prio"])


TODO = f"""keyed AS ({NULL_KEYED}),
todo AS (SELECT o_orderkey, cust, prio FROM keyed c WHERE o_orderstatus != 'F' AND NOT EXISTS (
  SELECT 1 FROM keyed s WHERE s.o_orderstatus = 'F' AND s.cust IS NOT DISTINCT FROM c.cust
    AND s.prio IS NOT DISTINCT FROM c.prio))"""


@query("resume_todo", sql(TODO, select="SELECT o_orderkey, cust, prio FROM todo"))
def resume_todo(spark, sf_dir):
    return new_orders(spark, sf_dir).select("o_orderkey", "cust", "prio")


@query("take_quota", sql(TODO, select="""
SELECT o_orderkey, cust, prio FROM todo ORDER BY o_orderkey LIMIT 500"""))
def take_quota(spark, sf_dir):
    return P.take_quota(new_orders(spark, sf_dir), 500, ["o_orderkey"]).select(
        "o_orderkey", "cust", "prio")


@query("gather", """
SELECT kind, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (
  SELECT 'order' AS kind, o_orderkey AS id FROM orders UNION ALL
  SELECT 'line', l_orderkey FROM lineitem UNION ALL
  SELECT 'event', event_id FROM events) GROUP BY kind""")
def gather(spark, sf_dir):
    parts = [table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
             for name, kind, key in (("orders", "order", "o_orderkey"),
                                     ("lineitem", "line", "l_orderkey"),
                                     ("events", "event", "event_id"))]
    return P.gather(parts).groupBy("kind").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("merge_index", """
SELECT o_orderkey AS id, o_custkey % 3 AS part FROM orders UNION
SELECT l_orderkey, l_linenumber % 3 FROM lineitem""")
def merge_index(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("part"))
    new = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 3).cast("long").alias("part"))
    return P.merge_index(old, new, ["id", "part"])


@query("assign_shards", f"""
WITH RECURSIVE numbered AS (
  SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
  FROM documents),
filled AS (
  SELECT source, doc_id, rn, CAST(0 AS BIGINT) AS shard, n_chars AS held
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.source, n.doc_id, n.rn,
         f.shard + CASE WHEN f.held >= {SHARD_LIMIT} THEN 1 ELSE 0 END,
         CASE WHEN f.held >= {SHARD_LIMIT} THEN n.n_chars ELSE f.held + n.n_chars END
  FROM filled f JOIN numbered n ON n.source = f.source AND n.rn = f.rn + 1)
SELECT source, doc_id, shard FROM filled""")
def assign_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return P.assign_shards(docs, ["source"], ["doc_id"], "n_chars", SHARD_LIMIT).drop("n_chars")


WORK = f"""
chosen AS (
  SELECT source AS factory_id, lang AS worker_id, n_chars // 10 AS n_frames,
         row_number() OVER (PARTITION BY source ORDER BY {hash_sql('doc_id')}, doc_id) - 1
           AS video_index
  FROM documents WHERE n_chars // 10 >= 64 QUALIFY video_index < 20),
windows AS (SELECT factory_id, worker_id, video_index,
                   unnest(range(0, n_frames - 64 + 1, 64)) AS tubelet_start FROM chosen),
stored AS (SELECT * FROM windows WHERE tubelet_start % 128 = 0)"""


def work(spark, sf_dir, target, n_shards=1):
    """Tubelets left to extract when every second window of each video is stored."""
    listed = videos(spark, sf_dir)
    chosen = P.select_videos(listed, "doc_id", F.col("n_frames") >= 64, 20, SEED)
    stored = window_starts(chosen).where(F.col("tubelet_start") % 128 == 0)
    return work_list(listed, stored, "doc_id", target, 20, 64, SEED, n_shards)


@query("work_list", sql(WORK, select="""
SELECT factory_id, worker_id, CAST(video_index AS INTEGER) AS video_index,
       CAST(tubelet_start AS INTEGER) AS tubelet_start
FROM windows WHERE tubelet_start % 128 != 0
ORDER BY factory_id, video_index, tubelet_start
LIMIT greatest(0, 3000 - (SELECT count(*) FROM stored))"""))
def work_list_query(spark, sf_dir):
    return work(spark, sf_dir, 3000).select(
        "factory_id", "worker_id", "video_index", "tubelet_start")


def shard_work_sql(n):
    """Half of what is left is wanted, so that shards stop inside their factories."""
    return sql(WORK, f"""
rest AS (SELECT count(*) // 2 AS n FROM windows WHERE tubelet_start % 128 != 0),
facts AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS pos, count(*) OVER () // {n} AS size
          FROM (SELECT DISTINCT source FROM documents)),
cut AS (SELECT source, CASE WHEN size = 0 THEN {n} - 1
                       ELSE least(pos // greatest(size, 1), {n} - 1) END AS shard FROM facts),
ranked AS (SELECT w.*, shard, row_number() OVER (PARTITION BY shard
             ORDER BY factory_id, video_index, tubelet_start) AS place
           FROM windows w JOIN cut ON source = factory_id WHERE tubelet_start % 128 != 0)""", select=f"""
SELECT factory_id, worker_id, CAST(video_index AS INTEGER) AS video_index,
       CAST(tubelet_start AS INTEGER) AS tubelet_start, shard
FROM ranked, rest WHERE place <= n // {n} + CASE WHEN shard < n % {n} THEN 1 ELSE 0 END""")


def shard_work(spark, sf_dir, n):
    listed = videos(spark, sf_dir)
    chosen = P.select_videos(listed, "doc_id", F.col("n_frames") >= 64, 20, SEED)
    by_state = window_starts(chosen).groupBy((F.col("tubelet_start") % 128 == 0).alias("stored")).count()
    counts = {row["stored"]: row["count"] for row in by_state.collect()}
    target = counts.get(True, 0) + counts.get(False, 0) // 2
    return work(spark, sf_dir, target, n).select(
        "factory_id", "worker_id", "video_index", "tubelet_start", "shard")


@query("work_list_shards", shard_work_sql(3))
def work_list_shards(spark, sf_dir):
    return shard_work(spark, sf_dir, 3)


@query("work_list_more_shards_than_factories", shard_work_sql(32))
def work_list_more_shards(spark, sf_dir):
    return shard_work(spark, sf_dir, 32)


PER_ARCHIVE = 10


@query("select_from_archives", f"""
WITH videos AS (
  SELECT source AS factory_id, source || '/part' || (doc_id // {PER_ARCHIVE}) AS path, doc_id,
         n_chars // 10 >= 64 AS valid FROM documents),
archives AS (SELECT factory_id, path, {hash_sql('path')} AS h, count(CASE WHEN valid THEN 1 END) AS n
             FROM videos GROUP BY ALL),
opened AS (SELECT factory_id, path, h FROM archives
  QUALIFY coalesce(sum(n) OVER (PARTITION BY factory_id ORDER BY h, path
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 15),
counted AS (SELECT factory_id, count(*) AS n_opened FROM opened GROUP BY factory_id)
SELECT factory_id, path, doc_id, n_opened,
       row_number() OVER (PARTITION BY factory_id ORDER BY h, path, doc_id) - 1 AS video_index
FROM videos JOIN opened USING (factory_id, path) JOIN counted USING (factory_id) WHERE valid
QUALIFY video_index < 15""")
def select_from_archives(spark, sf_dir):
    """Documents in the part of videos, ten ids to an archive, fifteen videos to a factory."""
    docs = videos(spark, sf_dir).withColumn("path", F.concat(
        "factory_id", F.lit("/part"), F.floor(F.col("doc_id") / PER_ARCHIVE).cast("string")))

    def members(archives):
        return docs.join(archives, ["factory_id", "path"])

    chosen, opened = P.select_from_archives(
        docs.select("factory_id", "path").distinct(), members, F.col("n_frames") >= 64, PER_ARCHIVE,
        15, SEED, at="doc_id")
    n_opened = opened.groupBy("factory_id").agg(F.count("*").alias("n_opened"))
    return chosen.join(n_opened, "factory_id").select(
        "factory_id", "path", "doc_id", "n_opened", "video_index")
