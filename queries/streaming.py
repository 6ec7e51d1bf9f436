"""Streaming forms. Each stream ends when its input is read and is compared as a table."""

from pyspark.sql import functions as F

from driftgate.functions.payload import psi_from_payload
from driftgate.operators.frames import psi
from driftgate.operators.planning import gather
from driftgate.plans.replay import Replay, steps_per_epoch
from driftgate.session import materialize, scratch_path
from driftgate.sources.latents import only_tag
from driftgate.streaming.delta import adaptive_delta_stream
from driftgate.streaming.metrics import write_with_metrics
from driftgate.streaming.resume import dedup_stream
from driftgate.streaming.shards import run_available, stream_latents
from driftgate.streaming.tau import online_tau
from queries.calibration import EVENT_FLOW, STOP_STEP, STOP_TOL, STOPPED, file_stop
from queries.evaluation import ADAPTIVE, sigmas
from queries.fixtures import (
    EM_EPS, EM_PSI, EM_WITH_LATENTS, EM_WITH_PSI, SAMPLED, SHAPE, em_l1, latent_rows, latent_store, r,
    table,
)
from queries.payload import SAMPLED_PSI
from queries.registry import query, sql


@query("stream_psi", SAMPLED_PSI)
def stream_psi(spark, sf_dir):
    latents = stream_latents(spark, latent_store(spark, sf_dir))
    scored = psi_from_payload(only_tag(latents, "iid_sample"), EM_EPS,
                              ["video_index", "tubelet_start"], SHAPE)
    out = scratch_path(spark, "stream-psi")
    run_available(scored, out, scratch_path(spark, "stream-state"))
    return spark.read.schema(scored.schema).parquet(out).withColumn("psi", r("psi", 4))


@query("stream_delta", ADAPTIVE)
def stream_delta(spark, sf_dir):
    """Three arrivals on one continued state; each has steps that come before some of the earlier arrivals'."""
    values = sigmas(spark, sf_dir)
    source, out, state = (scratch_path(spark, f"stream-{n}") for n in ("in", "out", "state"))
    forward = (F.col("direction") == "fwd").cast("int")
    for arrival in (1, 2, 0):
        values.where((F.col("step") + forward) % 3 == arrival).write.mode("append").parquet(source)
        stream = adaptive_delta_stream(spark.readStream.schema(values.schema).parquet(source))
        run_available(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out).withColumns(
        {"sigma": r("sigma"), "delta": r("delta")})


@query("stream_tau", sql(
    *EM_WITH_PSI, file_stop("em_psi", "seq_id", STOP_STEP, STOP_TOL),
    select=STOPPED.format(source="em_psi", places=4)))
def stream_tau(spark, sf_dir):
    """Scores arrive in one file per video until the gate changes by less than the tolerance."""
    source = scratch_path(spark, "scores")
    scored = materialize(psi(em_l1(spark, sf_dir), EM_EPS), "psi")
    for video in sorted(r["seq_id"] for r in scored.select("seq_id").distinct().collect()):
        scored.where(F.col("seq_id") == video).select("psi").coalesce(1).write.mode("append").parquet(
            source)
    stream = (spark.readStream.schema("psi double").option("maxFilesPerTrigger", 1)
              .parquet(source))
    return online_tau(stream, scratch_path(spark, "tau"), scratch_path(spark, "tau-state"),
                      step=STOP_STEP, tol=STOP_TOL, limit=16).withColumn("tau", r("tau", 4))


REPLAY_STEPS, REPLAY_CAP, REPLAY_BATCH, REPLAY_VIDEOS = 3, 8, 4, 7


def pass_sql(number, seed, landed):
    """Batches of one pass in their turn."""
    return f"""
dealt{number} AS (SELECT shard, row_number() OVER (ORDER BY md5({seed} || ':' || shard), shard) - 1 AS pos
  FROM (SELECT DISTINCT shard FROM scored WHERE {landed})),
rows{number} AS (SELECT video_index, tubelet_start, pos % 2 AS worker, row_number() OVER w - 1 AS row
  FROM scored JOIN dealt{number} USING (shard) WHERE bucket != 0
  WINDOW w AS (PARTITION BY pos % 2 ORDER BY pos, tubelet_start)
  QUALIFY row_number() OVER w <= {REPLAY_CAP}),
turns{number} AS (SELECT *, row // {REPLAY_BATCH} AS batch_id,
  dense_rank() OVER (ORDER BY row // {REPLAY_BATCH}, worker) - 1 AS turn FROM rows{number})"""


@query("replay_epochs", sql(*EM_WITH_LATENTS, EM_PSI, """
scored AS (SELECT l.*, psi, 'shard_' || l.video_index AS shard, ('0x' || substr(
    md5(l.factory_id || '_' || l.video_index), 1, 8))::UBIGINT % 10 AS bucket
  FROM latents l JOIN em_psi p ON l.seq_id = p.seq_id AND l.start = p.start)""",
    pass_sql(0, 42, f"video_index < {REPLAY_VIDEOS}"), f"""
dry AS (SELECT max(turn) + 1 AS n FROM turns0),
begun AS (SELECT 1 + n // {REPLAY_STEPS} + n % {REPLAY_STEPS} AS seed FROM dry)""",
    pass_sql(1, "(SELECT seed FROM begun)", "TRUE"), f"""
served AS (
  SELECT 0 AS pass, 42 AS seed, turn AS served_at, * EXCLUDE (turn) FROM turns0
  UNION ALL
  SELECT 1, (SELECT seed FROM begun), turn + (SELECT n FROM dry), * EXCLUDE (turn) FROM turns1)""",
    select=f"""
SELECT CAST(1 + served_at // {REPLAY_STEPS} AS BIGINT) AS epoch, CAST(served_at % {REPLAY_STEPS} AS BIGINT) AS step,
       CAST(pass AS BIGINT) AS pass, CAST(seed AS BIGINT) AS seed, worker, row, video_index, tubelet_start
FROM served WHERE served_at < 2 * {REPLAY_STEPS}"""))
def replay_epochs(spark, sf_dir):
    """Two epochs of three steps; further videos land after the first, and the first pass, which does not
    know them, runs dry inside the second."""
    root = scratch_path(spark, "growing")
    rows = materialize(latent_rows(spark, sf_dir), "rows")
    keep = ["factory_id", "video_index", "tubelet_start"]
    first = F.col("video_index") < REPLAY_VIDEOS
    rows.where(first).write.parquet(root)
    shard = F.concat(F.lit("shard_"), F.col("video_index").cast("string"))
    replay = Replay(
        spark, psi_from_payload(stream_latents(spark, root), EM_EPS, keep, SHAPE),
        scratch_path(spark, "replay"), 0.0, steps_per_epoch(12, REPLAY_BATCH),
        prepare=lambda scores: scores.withColumn("shard", shard), n_workers=2, cap=REPLAY_CAP,
        batch_size=REPLAY_BATCH, shard="shard", row="tubelet_start")
    epochs = [replay.next_epoch()]
    rows.where(~first).write.mode("append").parquet(root)
    epochs.append(replay.next_epoch())
    return gather(epochs).select("epoch", "step", "pass", "seed", "worker", "row", "video_index",
                                 "tubelet_start")


TURN = ["conv_id", "turn"]


@query("stream_dedup", """
WITH arrived AS (
  SELECT conv_id, turn, role || batch AS role, text, batch
  FROM conversations, (SELECT unnest([0, 1, 2]) AS batch) WHERE conv_id % 3 <= batch)
SELECT conv_id, turn, role, strlen(text) AS n_bytes, md5(text) AS content, CAST(batch AS INTEGER) AS batch
FROM arrived WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM conversations WHERE turn = 1)
QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY batch, role) = 1""")
def stream_dedup(spark, sf_dir):
    """Three micro-batches, each with all identities of those before; second turns are stored elsewhere
    already. What is kept is the first arrival, with its text, which no exchange has carried."""
    turns = table(spark, sf_dir, "conversations")
    stored = turns.where("turn = 1").select(*TURN)
    source, store, state = (scratch_path(spark, f"dedup-{n}") for n in ("in", "store", "state"))
    for batch in range(3):
        turns.where(F.col("conv_id") % 3 <= batch).withColumn(
            "role", F.concat("role", F.lit(str(batch)))).write.mode("append").parquet(source)
        dedup_stream(spark.readStream.schema(turns.schema).parquet(source), store, state, ["role"],
                     TURN, stored, buckets=8)
    return spark.read.parquet(store).select(
        *TURN, "role", F.octet_length("text").cast("long").alias("n_bytes"),
        F.md5(F.col("text").cast("binary")).alias("content"), F.col("batch").cast("int").alias("batch"))


@query("run_metrics", f"""
SELECT count(*) AS n_rows, count(CASE WHEN event_type = '{SAMPLED}' THEN 1 END) AS n_samples,
       count(CASE WHEN {EVENT_FLOW} >= 0 THEN 1 END) AS n_measured,
       CAST(sum(strlen(props)) AS BIGINT) AS n_bytes FROM events""")
def run_metrics(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("m_flow", F.expr(EVENT_FLOW))
    return write_with_metrics(events, scratch_path(spark, "measured"), {
        "n_rows": F.count("*"), "n_samples": F.count_if(F.col("event_type") == SAMPLED),
        "n_measured": F.count_if(F.col("m_flow") >= 0), "n_bytes": F.sum(F.octet_length("props"))})
