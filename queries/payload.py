"""Codec, payload reductions, shard listing, archives, tolerant scans, SQL functions."""

import io
import tarfile

from pyspark.sql import Window, functions as F

from driftgate.functions.payload import decode_latent, encode_latent, psi_from_payload
from driftgate.functions.udfs import register
from driftgate.operators.evaluation import adaptive_delta
from driftgate.operators.planning import assign_shards
from driftgate.plans.epoch import epoch_payloads, epoch_sample, store_epoch
from driftgate.plans.evaluate import batch_volatility
from driftgate.session import materialize, scratch_path
from driftgate.sources.archives import create_shared, explode_archives
from driftgate.sources.latents import (
    list_shards, only_tag, read_latents, skipped_shards, with_address,
)
from driftgate.sources.shards import write_assigned_shards, write_shards
from driftgate.sources.store import dedup_rows
from driftgate.streaming.metrics import file_metrics
from queries.evaluation import EM_WITH_PAIRS, PAIRS, SIGMAS, fold_sql
from queries.fixtures import (
    DIM, EM, EM_EPS, EM_FRAMES, EM_PSI, EM_WITH_LATENTS, SHAPE, W, latent_rows, latent_store,
    payload_rows, r, table,
)
from queries.registry import query, sql

SAMPLED_PSI = sql(*EM_WITH_LATENTS, EM_PSI, select="""
SELECT video_index, tubelet_start, round(psi, 4) AS psi
FROM latents l JOIN em_psi p ON l.seq_id = p.seq_id AND l.start = p.start
WHERE tag = 'iid_sample'""")


@query("codec_roundtrip", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[1] AS DOUBLE) AS head,
       CAST(embedding[64] AS DOUBLE) AS tail, 256 AS n_bytes FROM embeddings""")
def codec_roundtrip(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", encode_latent("embedding").alias("bytes"))
    decoded = vectors.withColumn("z", decode_latent(DIM)("bytes"))
    return decoded.select("vec_id", F.size("z").alias("n"),
                          F.col("z")[0].cast("double").alias("head"),
                          F.col("z")[DIM - 1].cast("double").alias("tail"),
                          F.octet_length("bytes").alias("n_bytes"))


@query("payload_psi", SAMPLED_PSI)
def payload_psi(spark, sf_dir):
    latents = only_tag(payload_rows(spark, sf_dir), "iid_sample")
    return psi_from_payload(latents, EM_EPS, ["video_index", "tubelet_start"], SHAPE).withColumn(
        "psi", r("psi", 4))


@query("psi_sql_function", SAMPLED_PSI)
def psi_sql_function(spark, sf_dir):
    register(spark)
    read_latents(spark, latent_store(spark, sf_dir)).createOrReplaceTempView("latent_rows")
    return spark.sql(f"""
        SELECT video_index, tubelet_start,
               round(psi(latent_bytes, {W}, CAST({EM_EPS} AS DOUBLE)), 4) AS psi
        FROM latent_rows WHERE tag = 'iid_sample'""")


BY_FACTORY = """
factories AS (SELECT 'factory_' || (seq_id % 4) AS factory_id, count(*) AS n
              FROM (SELECT DISTINCT seq_id, start FROM em_tub) GROUP BY seq_id % 4)"""


def shards_by_factory(spark, sf_dir):
    """A store with shards of up to three windows of one factory."""
    path = scratch_path(spark, "by-factory")
    (latent_rows(spark, sf_dir).withColumn("by", F.col("factory_id")).repartition("by")
     .write.partitionBy("by").option("maxRecordsPerFile", 3).parquet(path))
    return path


@query("list_shards", sql(*EM, BY_FACTORY, select="""
SELECT factory_id, CAST(ceil(n / 3) AS BIGINT) AS n_shards, TRUE AS sized FROM factories"""))
def list_shards_query(spark, sf_dir):
    """Shards that are written, then found again by listing."""
    shards = list_shards(spark, shards_by_factory(spark, sf_dir))
    return shards.groupBy(F.regexp_extract("path", "by=([^/]+)/", 1).alias("factory_id")).agg(
        F.count("*").alias("n_shards"), F.bool_and(F.col("length") > 0).alias("sized"))


@query("file_metrics", sql(*EM, BY_FACTORY, select="""
SELECT CAST(sum(ceil(n / 3)) + 1 AS BIGINT) AS n_files, CAST(sum(ceil(n / 3)) AS BIGINT) AS n_read,
       0 AS n_partly, 1 AS n_skipped, CAST(sum(n) AS BIGINT) AS rows_read, 0 AS rows_lost
FROM factories"""))
def file_metrics_query(spark, sf_dir):
    """Counters of a store with one unreadable shard."""
    path = shards_by_factory(spark, sf_dir)
    (table(spark, sf_dir, "nation").selectExpr("CAST(count(*) AS STRING) AS value")
     .coalesce(1).write.mode("append").text(f"{path}/damaged"))
    return file_metrics(spark, path, glob="part-*")


MEMBERS_PER_ARCHIVE = 40


def archives(spark, sf_dir):
    """Tar archives of whole document texts, written by the tasks that hold them.

    A group is a range of ids, so its size is fixed."""
    root = scratch_path(spark, "archives")
    docs = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / MEMBERS_PER_ARCHIVE).alias("part"), "doc_id", "text")

    def pack(pdf):
        path = f"{root}/part{pdf['part'].iloc[0]}.tar"
        with create_shared(path) as sink, tarfile.open(fileobj=sink, mode="w|") as archive:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                data = text.encode()
                member = tarfile.TarInfo(f"{doc_id}.{'json' if doc_id % 5 == 0 else 'mp4'}")
                member.size = len(data)
                archive.addfile(member, io.BytesIO(data))
        return pdf[["part"]].head(1).assign(path=path)

    return docs.groupBy("part").applyInPandas(pack, "part long, path string")


ARCHIVE_MEMBERS = f"""
SELECT doc_id // {MEMBERS_PER_ARCHIVE} AS part, doc_id || '.mp4' AS member,
       strlen(text) AS size FROM documents WHERE doc_id % 5 != 0"""


@query("archive_members", ARCHIVE_MEMBERS)
def archive_members(spark, sf_dir):
    # The archives exist once the manifest is written; listing reads the manifest.
    return explode_archives(materialize(archives(spark, sf_dir), "manifest")).drop("path")


@query("archive_members_sql", ARCHIVE_MEMBERS)
def archive_members_sql(spark, sf_dir):
    """The same listing as a SQL table function."""
    register(spark)
    materialize(archives(spark, sf_dir), "manifest").createOrReplaceTempView("archive_manifest")
    return spark.sql("SELECT part, member, size FROM archive_manifest, "
                     "LATERAL archive_members(archive_manifest.path)")


@query("tolerant_scan", sql(*EM_WITH_LATENTS, select="""
SELECT count(*) AS n_rows, CAST(1 AS BIGINT) AS n_skipped FROM latents"""))
def tolerant_scan(spark, sf_dir):
    """A store with one unreadable shard: the rest is read, the shard is reported."""
    store = latent_store(spark, sf_dir)
    (table(spark, sf_dir, "nation").selectExpr("CAST(count(*) AS STRING) AS value")
     .coalesce(1).write.mode("append").text(f"{store}/damaged"))
    read = read_latents(spark, store, on_error="skip", glob="part-*").agg(
        F.count("*").alias("n_rows"))
    skipped = skipped_shards(spark, store, glob="part-*").agg(F.count("*"))
    return read.withColumn("n_skipped", skipped.scalar())


@query("shard_sink", sql(*EM_WITH_LATENTS, select="""
SELECT count(*) AS n_rows, TRUE AS bounded FROM latents"""))
def shard_sink(spark, sf_dir):
    """Shards that close with the row that brings them to 5000 bytes: three payloads."""
    path = scratch_path(spark, "shards")
    write_shards(latent_rows(spark, sf_dir), path, SHAPE[0] * SHAPE[1] * 4, max_bytes=5000)
    per_file = read_latents(spark, path).groupBy(
        F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    return per_file.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 3).alias("bounded"))


FILE_BYTES = 5000


@query("shard_membership", sql(EM_FRAMES, f"""
windows AS (SELECT seq_id, idx - idx % 8 AS start, count(*) * 256 AS n FROM em_frames
            GROUP BY seq_id, idx - idx % 8),
numbered AS (SELECT *, seq_id % 4 AS writer, row_number() OVER (
               PARTITION BY seq_id % 4 ORDER BY seq_id, start) AS rn FROM windows),
filled AS (
  SELECT writer, seq_id, start, n, rn, CAST(0 AS BIGINT) AS shard, n AS held FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.writer, n.seq_id, n.start, n.n, n.rn, f.shard + CASE WHEN f.held >= {FILE_BYTES} THEN 1 ELSE 0 END,
         CASE WHEN f.held >= {FILE_BYTES} THEN n.n ELSE f.held + n.n END
  FROM filled f JOIN numbered n ON n.writer = f.writer AND n.rn = f.rn + 1)""", select=f"""
SELECT 'factory_' || writer AS factory_id, CAST(seq_id AS INTEGER) AS video_index,
       CAST(start AS INTEGER) AS tubelet_start, shard, CAST(n AS INTEGER) AS n_bytes,
       CAST(sum(n) OVER w AS BIGINT) AS shard_bytes,
       shard < max(shard) OVER (PARTITION BY writer) AS closed,
       sum(n) OVER w >= {FILE_BYTES} AS reached FROM filled
WINDOW w AS (PARTITION BY writer, shard)""").replace("WITH ", "WITH RECURSIVE ", 1))
def shard_membership(spark, sf_dir):
    """Files whose members are read back: each closed one reaches the limit, and its last row did it."""
    store = materialize(latent_rows(spark, sf_dir, whole=False), "rows")
    order = ["video_index", "tubelet_start"]
    sizes = store.select("factory_id", *order, F.octet_length("latent_bytes").alias("size"))
    assigned = assign_shards(sizes, ["factory_id"], order, "size", FILE_BYTES, block_rows=4, fan=2)
    root = scratch_path(spark, "assigned")
    write_assigned_shards(store.join(assigned.drop("size"), ["factory_id", *order]), root, ["factory_id"])
    path = F.col("_metadata.file_path")
    rows = read_latents(spark, root).select(
        "factory_id", *order, F.octet_length("latent_bytes").alias("n_bytes"), path.alias("file"),
        F.regexp_extract(path, "by_shard=([0-9]+)/", 1).cast("long").alias("shard"))
    by_file, by_writer = Window.partitionBy("file"), Window.partitionBy("factory_id")
    return rows.select(
        "factory_id", *order, "shard", "n_bytes", F.sum("n_bytes").over(by_file).alias("shard_bytes"),
        (F.col("shard") < F.max("shard").over(by_writer)).alias("closed"),
        (F.sum("n_bytes").over(by_file) >= FILE_BYTES).alias("reached"))


@query("epoch_payloads", sql(*EM, *EM_WITH_LATENTS[2:], EM_PSI, select="""
SELECT l.video_index, l.tubelet_start, 2048 AS n_bytes, round(s.head, 4) AS head,
       round(s.next, 4) AS next
FROM latents l JOIN em_psi p ON l.seq_id = p.seq_id AND l.start = p.start
JOIN (SELECT seq_id, start, sum(CAST(z[1] AS DOUBLE)) AS head,
             sum(CAST(z[2] AS DOUBLE)) AS next FROM em_tub GROUP BY seq_id, start) s
  ON l.seq_id = s.seq_id AND l.start = s.start
WHERE tag = 'iid_sample' AND NOT psi < 0.1 AND ('0x' || substr(
  md5(l.factory_id || '_' || l.video_index), 1, 8))::UBIGINT % 10 != 0"""))
def epoch_payloads_query(spark, sf_dir):
    """Scores first, then one epoch on keys, then only the kept payloads, channel-major:
    the first values are one channel over time."""
    latents = only_tag(payload_rows(spark, sf_dir), "iid_sample")
    keep = ["factory_id", "video_index", "file_path", "row_index"]
    scored = materialize(psi_from_payload(with_address(latents), EM_EPS, keep, SHAPE), "psi")
    sample = epoch_sample(scored, 0.1, n_workers=2)
    series = decode_latent(W * DIM)("latent_bytes")
    out = epoch_payloads(sample, SHAPE).withColumn("z", series)

    def channel(i):
        values = F.slice(F.col("z"), i * W + 1, W)
        return r(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), 4)
    return out.select("video_index", "tubelet_start",
                      F.octet_length("latent_bytes").alias("n_bytes"),
                      channel(0).alias("head"), channel(1).alias("next"))


@query("dedup_payloads", sql(*EM, *EM_WITH_LATENTS[2:], select="""
SELECT l.video_index, l.tubelet_start, CASE WHEN l.video_index % 2 = 0 THEN 'again' ELSE tag END AS tag,
       2048 AS n_bytes, round(s.head, 4) AS head
FROM latents l JOIN (SELECT seq_id, start, sum(CAST(z[1] AS DOUBLE)) AS head FROM em_tub
                     GROUP BY seq_id, start) s ON l.seq_id = s.seq_id AND l.start = s.start"""))
def dedup_payloads(spark, sf_dir):
    """A store that holds the windows of every second video twice, the second time with less motion."""
    store = latent_store(spark, sf_dir)
    again = latent_rows(spark, sf_dir).where(F.col("video_index") % 2 == 0).withColumns(
        {"m_flow": (F.col("m_flow") - 5).cast("float"), "tag": F.lit("again")})
    again.write.mode("append").parquet(store)
    out = dedup_rows(read_latents(spark, store), ["m_flow"]).withColumn(
        "z", decode_latent(W * DIM)("latent_bytes"))
    first = F.transform(F.sequence(F.lit(0), F.lit(W - 1)), lambda t: F.col("z")[t * DIM])
    head = F.aggregate(first, F.lit(0.0), lambda acc, x: acc + x)
    return out.select("video_index", "tubelet_start", "tag",
                      F.octet_length("latent_bytes").alias("n_bytes"), r(head, 4).alias("head"))


def payload_sigmas(spark, sf_dir):
    """Two windows of a video to a batch, as in the column form."""
    latents = payload_rows(spark, sf_dir).select(
        F.col("video_index").cast("long").alias("run"),
        F.floor(F.col("tubelet_start") / 16).alias("step"), "latent_bytes")
    return batch_volatility(latents, ["run", "step"], SHAPE, PAIRS)


@query("payload_sigma", sql(*EM_WITH_PAIRS, SIGMAS, select="""
SELECT run, step, direction, round(sigma, 4) AS sigma FROM sigmas"""))
def payload_sigma(spark, sf_dir):
    return payload_sigmas(spark, sf_dir).withColumn("sigma", r("sigma", 4))


@query("payload_delta", fold_sql("""
SELECT run, step, direction, round(sigma, 4) AS sigma, round(delta, 4) AS delta FROM deltas"""))
def payload_delta(spark, sf_dir):
    """The adaptive threshold straight from payloads."""
    return adaptive_delta(payload_sigmas(spark, sf_dir)).withColumns(
        {"sigma": r("sigma", 4), "delta": r("delta", 4)})


LISTED = f"""
latent_psi AS (SELECT l.*, psi, 'shard_' || l.video_index AS shard, ('0x' || substr(
    md5(l.factory_id || '_' || l.video_index), 1, 8))::UBIGINT % 10 AS bucket
  FROM latents l JOIN em_psi p ON l.seq_id = p.seq_id AND l.start = p.start),
shards AS (SELECT shard, row_number() OVER (ORDER BY md5('42:' || shard), shard) - 1 AS pos
           FROM (SELECT DISTINCT shard FROM latent_psi))"""


@query("epoch_sample_tags", sql(*EM_WITH_LATENTS, EM_PSI, LISTED, select="""
SELECT video_index, tubelet_start, tag, pos % 2 AS worker, row_number() OVER w - 1 AS row,
       (row_number() OVER w - 1) // 8 AS batch_id
FROM latent_psi JOIN shards USING (shard)
WHERE video_index % 3 != 1 AND bucket != 0 AND NOT psi < 0.1
WINDOW w AS (PARTITION BY pos % 2 ORDER BY pos, tubelet_start)
QUALIFY row_number() OVER w <= 100"""))
def epoch_sample_tags(spark, sf_dir):
    """Rows of every tag; the shards of a third of the videos are listed but lose all rows."""
    latents = payload_rows(spark, sf_dir)
    keep = ["factory_id", "video_index", "tubelet_start", "tag"]
    scored = materialize(psi_from_payload(latents, EM_EPS, keep, SHAPE), "psi").withColumn(
        "shard", F.concat(F.lit("shard_"), F.col("video_index").cast("string")))
    sample = epoch_sample(scored.where("video_index % 3 != 1"), 0.1, "train", 42, 2, 100, 8, "shard",
                          "tubelet_start", listing=scored.select("shard"))
    return sample.select("video_index", "tubelet_start", "tag", "worker", "row", "batch_id")


@query("store_epoch", sql(*EM_WITH_LATENTS, EM_PSI, LISTED, select="""
SELECT video_index, tubelet_start, tag, (SELECT count(*) FROM shards) AS n_shards
FROM latent_psi WHERE bucket != 0 AND NOT psi < 0.1"""))
def store_epoch_query(spark, sf_dir):
    """An epoch over a store: its listed shards, one per video, are dealt, also those that lose all rows."""
    root = scratch_path(spark, "by-video")
    (latent_rows(spark, sf_dir).withColumn("by", F.col("video_index")).repartition("by")
     .write.partitionBy("by").parquet(root))
    epoch = store_epoch(spark, root, EM_EPS, 0.1, shape=SHAPE, n_workers=2, cap=1_000_000)
    listed = list_shards(spark, root).agg(F.count("*").alias("n_shards"))
    return epoch.select("video_index", "tubelet_start", "tag").withColumn("n_shards", listed.scalar())
