"""Windows, differences, motion scores, noise floor, gate, convergence."""

from pyspark.sql import functions as F

from driftgate.functions.expressions import latent_id
from driftgate.operators import calibration as C
from driftgate.operators.frames import psi, tubelets
from driftgate.operators.planning import gather
from driftgate.plans.calibrate import calibrate, frame_changes, scores
from driftgate.schema import LATENT_KEYS
from driftgate.session import materialize, scratch_path
from driftgate.sources.calibration import (
    read_calibration, with_calibration, write_calibration,
)
from driftgate.sources.latents import (
    fetch_payloads, index_of, only_tag, read_latents, scan_motion, with_address, with_defaults,
)
from queries.fixtures import (
    EM_EPS, EM_WITH_L1, EM_WITH_LATENTS, EM_WITH_PSI, EV, EV_EPS, EV_FRAMES, EV_WITH_L1,
    EV_WITH_META, EV_WITH_PSI, SAMPLED, SHAPE, W, em_l1, ev_frames, ev_l1, ev_meta, ev_psi,
    ev_tubelets, latent_store, payload_rows, r, rows, table,
)
from queries.registry import query, sql

N_STATIC = 100
ADDRESS = ["shard", "row"]
STEP = 100
FILE_TOL = 1.0
ROW_TOL = 1.0
ROW_MIN = 300


# --- windows and scores ------------------------------------------------------

@query("scan_frames", sql(EV_FRAMES, select="""
SELECT seq_id, idx, event_id, event_type, x FROM ev_frames"""))
def scan_frames(spark, sf_dir):
    return ev_frames(spark, sf_dir).select("seq_id", "idx", "event_id", "event_type", "x")


@query("tubelets", sql(*EV, select="SELECT seq_id, start, t, x FROM ev_tub"))
def tubelets_query(spark, sf_dir):
    return ev_tubelets(spark, sf_dir).select("seq_id", "start", "t", "x")


@query("tubelets_overlapping", sql(EV_FRAMES, select="""
SELECT f.seq_id, s.start, f.idx - s.start AS t, f.x
FROM ev_frames f
JOIN (SELECT seq_id, unnest(range(0, max(idx) + 1 - 8 + 1, 4)) AS start
      FROM ev_frames GROUP BY seq_id) s
  ON f.seq_id = s.seq_id AND f.idx >= s.start AND f.idx < s.start + 8"""))
def tubelets_overlapping(spark, sf_dir):
    return tubelets(ev_frames(spark, sf_dir), W, stride=4).select("seq_id", "start", "t", "x")


@query("frame_diff", sql(*EV_WITH_L1, select="""
SELECT seq_id, start, t, round(l1, 6) AS diff FROM ev_l1"""))
def frame_diff_query(spark, sf_dir):
    return ev_l1(spark, sf_dir).select("seq_id", "start", "t", r("diff").alias("diff"))


@query("frame_l1", sql(*EM_WITH_L1, select="""
SELECT seq_id, start, t, round(l1, 6) AS l1 FROM em_l1"""))
def frame_l1_query(spark, sf_dir):
    return em_l1(spark, sf_dir).select("seq_id", "start", "t", r("l1").alias("l1"))


@query("psi", sql(*EM_WITH_PSI, select="""
SELECT seq_id, start, round(psi, 6) AS psi FROM em_psi"""))
def psi_query(spark, sf_dir):
    return psi(em_l1(spark, sf_dir), EM_EPS).select("seq_id", "start", r("psi").alias("psi"))


@query("tau", sql(*EV_WITH_PSI, select="""
SELECT round(quantile_cont(psi, 0.2), 6) AS tau FROM ev_psi"""))
def tau_query(spark, sf_dir):
    bound = rows(spark, sf_dir, "events")
    return C.tau(ev_psi(spark, sf_dir), row_bound=bound).select(r("tau").alias("tau"))


# --- narrow scans ------------------------------------------------------------

EVENT_FLOW = "CASE WHEN event_type = 'error' THEN -1.0 ELSE value END"


def event_motion(spark, sf_dir):
    """Events in the part of latent rows: tag and motion with their row address."""
    events = table(spark, sf_dir, "events").withColumn("_flow", F.expr(EVENT_FLOW))
    return scan_motion(events, "_flow", "event_type")


@query("scan_motion", f"""
SELECT 'events.parquet' AS file, event_id AS row_index, event_type AS tag,
       {EVENT_FLOW} AS m_flow FROM events""")
def scan_motion_query(spark, sf_dir):
    return event_motion(spark, sf_dir).select(
        F.regexp_extract("file_path", "[^/]+$", 0).alias("file"), "row_index", "tag", "m_flow")


@query("only_tag", f"""
SELECT event_id AS row_index, {EVENT_FLOW} AS m_flow FROM events
WHERE event_type = '{SAMPLED}'""")
def only_tag_query(spark, sf_dir):
    return only_tag(event_motion(spark, sf_dir), SAMPLED).select("row_index", "m_flow")


ODD_FLOW = """CASE event_type WHEN 'error' THEN -1.0 WHEN 'signup' THEN CAST('NaN' AS DOUBLE)
  WHEN 'click' THEN NULL ELSE value END"""


@query("valid_motion", f"""
SELECT event_id, m_flow FROM (SELECT event_id, {ODD_FLOW} AS m_flow FROM events)
WHERE m_flow >= 0 AND NOT isnan(m_flow)""")
def valid_motion_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.expr(ODD_FLOW).alias("m_flow"))
    return C.valid_motion(events)


@query("with_defaults", """
SELECT event_id,
       CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS tag,
       CASE WHEN user_id % 3 = 0 THEN 'unknown' ELSE 'f' || user_id END AS factory_id,
       CASE WHEN user_id % 4 = 0 THEN -1 ELSE user_id END AS video_index,
       CASE WHEN event_id % 5 = 0 THEN -1.0 ELSE value END AS m_flow
FROM events""")
def with_defaults_query(spark, sf_dir):
    holes = table(spark, sf_dir, "events").selectExpr(
        "event_id", "nullif(event_type, 'error') AS tag",
        "CASE WHEN user_id % 3 != 0 THEN 'f' || user_id END AS factory_id",
        "CASE WHEN user_id % 4 != 0 THEN user_id END AS video_index",
        "CASE WHEN event_id % 5 != 0 THEN value END AS m_flow")
    return with_defaults(holes)


@query("latent_id", """
SELECT count(*) AS n_ids, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS most
FROM (SELECT user_id % 8, user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3)""")
def latent_id_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("factory", F.col("user_id") % 8)
    per_id = events.groupBy(latent_id("factory", "user_id", "event_type").alias("id")).agg(
        F.count("*").alias("n"))
    return per_id.agg(F.count("*").alias("n_ids"), F.sum("n").alias("n_rows"),
                      F.max("n").alias("most"))


# --- noise floor -------------------------------------------------------------

STATIC = f"""static AS (
  SELECT * FROM ev_meta WHERE tag = '{SAMPLED}' AND m_flow >= 0
  ORDER BY m_flow, shard, row LIMIT {N_STATIC})"""
EV_STATIC = [*EV_WITH_META, STATIC]


def static(spark, sf_dir):
    return C.most_static(ev_meta(spark, sf_dir), N_STATIC, SAMPLED, ADDRESS)


def static_l1(spark, sf_dir):
    return static(spark, sf_dir).select("seq_id", "start", F.explode("l1").alias("l1"))


@query("most_static", sql(*EV_STATIC, select="""
SELECT seq_id, start, round(m_flow, 6) AS m_flow FROM static"""))
def most_static_query(spark, sf_dir):
    return static(spark, sf_dir).select("seq_id", "start", r("m_flow").alias("m_flow"))


@query("epsilon", sql(*EV_STATIC, select="""
SELECT round(quantile_cont(l.l1, 0.95), 6) AS epsilon
FROM ev_l1 l JOIN static s ON l.seq_id = s.seq_id AND l.start = s.start"""))
def epsilon_query(spark, sf_dir):
    bound = N_STATIC * (W - 1)
    return C.epsilon(static_l1(spark, sf_dir), row_bound=bound).select(
        r("epsilon").alias("epsilon"))


@query("winners_by_shard", sql(*EV_STATIC, select="""
SELECT shard, string_agg(CAST(row AS VARCHAR), ',' ORDER BY row) AS row_list,
       count(*) AS n_rows FROM static GROUP BY shard"""))
def winners_by_shard_query(spark, sf_dir):
    return C.winners_by_shard(static(spark, sf_dir), *ADDRESS).select(
        "shard", F.array_join(F.col("rows").cast("array<string>"), ",").alias("row_list"),
        "n_rows")


@query("sufficiency", sql(*EV_STATIC, select=f"""
SELECT count(*) AS n_diffs, count(DISTINCT (l.seq_id, l.start)) AS n_tubelets,
       count(*) > 0 AND count(DISTINCT (l.seq_id, l.start)) >= 100 AS sufficient
FROM ev_l1 l JOIN static s ON l.seq_id = s.seq_id AND l.start = s.start"""))
def sufficiency_query(spark, sf_dir):
    return C.sufficiency(static_l1(spark, sf_dir), ["seq_id", "start"])


@query("fetch_rows", f"""
SELECT event_id, user_id, props FROM (
  SELECT *, {EVENT_FLOW} AS m_flow FROM events)
WHERE event_type = '{SAMPLED}' AND m_flow >= 0
ORDER BY m_flow, event_id LIMIT {N_STATIC}""")
def fetch_rows_query(spark, sf_dir):
    winners = C.most_static(event_motion(spark, sf_dir), N_STATIC, SAMPLED)
    wide = with_address(table(spark, sf_dir, "events"))
    return C.fetch_rows(wide, winners, N_STATIC).select("event_id", "user_id", "props")


@query("fetch_payloads", sql(*EM_WITH_LATENTS, select="""
SELECT video_index, tubelet_start, tag, 2048 AS n_bytes FROM latents
WHERE tag = 'iid_sample' AND m_flow >= 0 ORDER BY m_flow LIMIT 20"""))
def fetch_payloads_query(spark, sf_dir):
    """Two-phase read: motion first, then payloads from the winners' shards and row groups only."""
    latents = read_latents(spark, latent_store(spark, sf_dir))
    motion = scan_motion(latents, keep=LATENT_KEYS)
    winners = materialize(C.most_static(motion, 20), "winners")
    return fetch_payloads(winners).select(
        "video_index", "tubelet_start", "tag", F.octet_length("latent_bytes").alias("n_bytes"))


# --- gate and record ---------------------------------------------------------

PSI_STATS = """round(avg(psi), 6) AS mean, round(stddev_pop(psi), 6) AS std,
  round(quantile_cont(psi, 0.2), 6) AS p20, round(quantile_cont(psi, 0.5), 6) AS p50,
  round(quantile_cont(psi, 0.8), 6) AS p80"""


@query("psi_stats", sql(*EV_WITH_PSI, select=f"""
SELECT {PSI_STATS}, count(*) AS n FROM ev_psi"""))
def psi_stats_query(spark, sf_dir):
    stats = C.psi_stats(ev_psi(spark, sf_dir), rows(spark, sf_dir, "events"))
    return stats.select(*[r(c).alias(c) for c in ("mean", "std", "p20", "p50", "p80")], "n")


RECORD = f"""eps AS (
  SELECT quantile_cont(l.l1, 0.95) AS epsilon, count(DISTINCT (l.seq_id, l.start)) AS n_static
  FROM ev_l1 l JOIN static s ON l.seq_id = s.seq_id AND l.start = s.start),
view_psi AS (
  SELECT l.seq_id, l.start, sum(greatest(0.0, l.l1 - epsilon)) AS psi
  FROM ev_l1 l JOIN ev_meta m ON l.seq_id = m.seq_id AND l.start = m.start, eps
  WHERE m.tag = '{SAMPLED}' GROUP BY l.seq_id, l.start)"""
RECORD_COLUMNS = ["epsilon_noise_floor", "tau_kinetic_gate", "samples_used_for_epsilon",
                  "samples_used_for_tau"]


def flat_record(record, places):
    return record.select(
        *[r(c, places).alias(c) for c in RECORD_COLUMNS[:2]], *RECORD_COLUMNS[2:],
        *[r(f"psi_stats.{c}", places).alias(c) for c in ("mean", "std", "p20", "p50", "p80")])


@query("calibration_record", sql(*EV_STATIC, RECORD, select=f"""
SELECT round(max(epsilon), 6) AS epsilon_noise_floor,
       round(quantile_cont(psi, 0.2), 6) AS tau_kinetic_gate,
       max(n_static) AS samples_used_for_epsilon, count(*) AS samples_used_for_tau,
       {PSI_STATS} FROM view_psi, eps"""))
def calibration_record_query(spark, sf_dir):
    # Windows with their changes are written once; floor, scores and gate all read that.
    meta = ev_meta(spark, sf_dir).select("shard", "row", "tag", "m_flow", "l1")
    changes = materialize(only_tag(meta, SAMPLED), "frame-changes")
    winners = C.most_static(changes, N_STATIC, SAMPLED, ADDRESS)
    eps = C.epsilon(winners.select(F.explode("l1").alias("l1")),
                    row_bound=N_STATIC * (W - 1))
    scored = scores(changes, eps.scalar()).select("psi")
    record = C.calibration_record(eps, winners.agg(F.count("*")),
                                  C.psi_stats(scored, changes.count()))
    return flat_record(record, 6)


@query("calibration_roundtrip", sql(*EM_WITH_LATENTS, f"""
static AS (SELECT * FROM latents WHERE tag = 'iid_sample' AND m_flow >= 0
           ORDER BY m_flow LIMIT 20),
eps AS (SELECT quantile_cont(l.l1, 0.95) AS epsilon, count(DISTINCT (l.seq_id, l.start)) AS n
        FROM em_l1 l JOIN static s ON l.seq_id = s.seq_id AND l.start = s.start),
sampled AS (SELECT l.seq_id, l.start, sum(greatest(0.0, l.l1 - epsilon)) AS psi
        FROM em_l1 l JOIN latents m ON l.seq_id = m.seq_id AND l.start = m.start, eps
        WHERE m.tag = 'iid_sample' GROUP BY l.seq_id, l.start)""", select=f"""
SELECT round(max(epsilon), 4) AS epsilon_noise_floor,
       round(quantile_cont(psi, 0.2), 4) AS tau_kinetic_gate,
       max(n) AS samples_used_for_epsilon, count(*) AS samples_used_for_tau,
       {PSI_STATS.replace(', 6)', ', 4)')} FROM sampled, eps"""))
def calibration_roundtrip(spark, sf_dir):
    latents = payload_rows(spark, sf_dir)
    record = calibrate(frame_changes(latents, SHAPE), n_static=20)
    path = scratch_path(spark, "calibration")
    write_calibration(record, path)
    return flat_record(read_calibration(spark, path), 4)


@query("with_calibration", sql(*EV_WITH_PSI, f"""
rec AS (SELECT quantile_cont(l1, 0.05) AS epsilon, quantile_cont(psi, 0.2) AS tau
        FROM ev_psi p JOIN ev_l1 l ON p.seq_id = l.seq_id AND p.start = l.start
        WHERE l.t = 1)""", select="""
SELECT seq_id, start, round(psi, 6) AS psi, round(epsilon, 6) AS epsilon,
       round(tau, 6) AS tau, NOT psi < tau AS passes FROM ev_psi, rec"""))
def with_calibration_query(spark, sf_dir):
    bound = rows(spark, sf_dir, "events")
    l1 = ev_l1(spark, sf_dir)
    scored = psi(l1, EV_EPS)
    eps = C.epsilon(l1.where(F.col("t") == 1), 0.05, bound)
    record = C.calibration_record(eps, l1.agg(F.count("*")), C.psi_stats(scored, bound))
    path = scratch_path(spark, "calibration")
    write_calibration(record, path)
    return with_calibration(scored, read_calibration(spark, path)).select(
        "seq_id", "start", r("psi").alias("psi"), r("epsilon").alias("epsilon"),
        r("tau").alias("tau"), (~(F.col("psi") < F.col("tau"))).alias("passes"))


# --- convergence -------------------------------------------------------------

CHECKPOINTS = f"""numbered AS (
  SELECT psi, row_number() OVER (ORDER BY seq_id, start) AS rn FROM ev_psi),
grid AS (SELECT rn AS k FROM numbered WHERE rn % {STEP} = 0),
points AS (SELECT k AS n_samples, quantile_cont(psi, 0.2) AS tau
  FROM grid JOIN numbered ON rn <= k GROUP BY k)"""


def checkpoints(spark, sf_dir, scored):
    return C.tau_checkpoints(scored, ["seq_id", "start"], STEP,
                             row_bound=rows(spark, sf_dir, "events"))


@query("tau_checkpoints", sql(*EV_WITH_PSI, CHECKPOINTS, select="""
SELECT n_samples, round(tau, 6) AS tau FROM points"""))
def tau_checkpoints_query(spark, sf_dir):
    return checkpoints(spark, sf_dir, ev_psi(spark, sf_dir)).select(
        "n_samples", r("tau").alias("tau"))


@query("tau_curve", sql(*EV_WITH_PSI, CHECKPOINTS, select="""
SELECT n_samples, round(tau, 6) AS tau FROM points"""))
def tau_curve(spark, sf_dir):
    """The curve as a stored table."""
    curve = checkpoints(spark, sf_dir, ev_psi(spark, sf_dir))
    path = scratch_path(spark, "tau-curve")
    curve.write.parquet(path)
    return spark.read.schema(curve.schema).parquet(path).select(
        "n_samples", r("tau").alias("tau"))


@query("tau_converged_row", sql(*EV_WITH_PSI, CHECKPOINTS, f"""
moves AS (SELECT *, row_number() OVER w AS n, abs(tau - lag(tau) OVER w) AS d1,
                 abs(lag(tau) OVER w - lag(tau, 2) OVER w) AS d2
          FROM points WINDOW w AS (ORDER BY n_samples)),
stops AS (SELECT n_samples, tau FROM moves
          WHERE d1 < {ROW_TOL} AND d2 < {ROW_TOL} AND n >= 3 AND n_samples >= {ROW_MIN}
          ORDER BY n_samples LIMIT 1)""", select="""
SELECT (SELECT count(*) FROM stops) = 1 AS converged,
       (SELECT n_samples FROM stops) AS n_samples,
       round(coalesce((SELECT tau FROM stops),
                      (SELECT quantile_cont(psi, 0.2) FROM ev_psi)), 6) AS tau"""))
def tau_converged_row(spark, sf_dir):
    scored = materialize(ev_psi(spark, sf_dir), "psi")
    return C.converge_by_row(checkpoints(spark, sf_dir, scored), C.tau(scored), ROW_TOL,
                             ROW_MIN).withColumn("tau", r("tau"))


def file_stop(source, file, step, tol):
    """Stops at file ends, as subqueries over a table of scores."""
    return f"""
per_file AS (SELECT {file} AS file, count(*) AS n FROM {source} GROUP BY 1),
files AS (SELECT file, row_number() OVER w AS i, sum(n) OVER w AS n_samples
          FROM per_file WINDOW w AS (ORDER BY file)),
marks AS (SELECT *, i + least(0, min(n_samples // {step} - i) OVER (ORDER BY i)) AS checks
          FROM files),
points AS (
  SELECT m.i, m.n_samples,
         (SELECT quantile_cont(psi, 0.2) FROM {source} p WHERE {file} <= m.file) AS tau
  FROM (SELECT * FROM marks QUALIFY checks > lag(checks, 1, 0) OVER (ORDER BY i)) m),
small AS (SELECT *, CAST(abs(tau - lag(tau, 1, 0.0) OVER (ORDER BY i)) < {tol} AS INT) AS s
          FROM points),
stops AS (SELECT n_samples, tau FROM (
            SELECT *, sum(s) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run
            FROM small) WHERE run >= 3 ORDER BY i LIMIT 1)"""


STOPPED = """
SELECT (SELECT count(*) FROM stops) = 1 AS converged,
       (SELECT CAST(n_samples AS BIGINT) FROM stops) AS n_samples,
       round(coalesce((SELECT tau FROM stops),
                      (SELECT quantile_cont(psi, 0.2) FROM {source})), {places}) AS tau"""


@query("tau_converged_file", sql(
    *EV_WITH_PSI, file_stop("ev_psi", "seq_id % 16", STEP, FILE_TOL),
    select=STOPPED.format(source="ev_psi", places=6)))
def tau_converged_file(spark, sf_dir):
    scored = materialize(ev_psi(spark, sf_dir).withColumn("file", F.col("seq_id") % 16), "psi")
    return C.converge_by_file(C.file_checks(scored, "file", STEP), C.tau(scored),
                              FILE_TOL).withColumn("tau", r("tau"))


STOP_STEP, STOP_TOL, STOP_MIN = 8, 0.05, 16
AT_STOP = """
SELECT '{policy}' AS policy, round((SELECT epsilon FROM eps), 4) AS epsilon_noise_floor,
       round(coalesce((SELECT tau FROM stops), quantile_cont(psi, 0.2)), 4) AS tau_kinetic_gate,
       (SELECT n_static FROM eps) AS samples_used_for_epsilon, count(*) AS samples_used_for_tau,
       {stats} FROM scored WHERE (SELECT count(*) FROM stops) = 0 OR {upto}"""
STOP_SCORES = """
static AS (SELECT * FROM latents WHERE m_flow >= 0 ORDER BY m_flow LIMIT 20),
eps AS (SELECT quantile_cont(l.l1, 0.95) AS epsilon, count(DISTINCT (l.seq_id, l.start)) AS n_static
        FROM em_l1 l JOIN static s ON l.seq_id = s.seq_id AND l.start = s.start),
scored AS (SELECT seq_id, start, sum(greatest(0.0, l1 - epsilon)) AS psi FROM em_l1, eps
           GROUP BY seq_id, start)"""
ROW_STOP = f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY seq_id, start) AS rn FROM scored),
points AS (SELECT k.rn AS n_samples, quantile_cont(n.psi, 0.2) AS tau
  FROM numbered k JOIN numbered n ON n.rn <= k.rn WHERE k.rn % {STOP_STEP} = 0 GROUP BY k.rn),
moves AS (SELECT *, row_number() OVER w AS n, abs(tau - lag(tau) OVER w) AS d1,
                 abs(lag(tau) OVER w - lag(tau, 2) OVER w) AS d2
          FROM points WINDOW w AS (ORDER BY n_samples)),
stops AS (SELECT n_samples, tau FROM moves
          WHERE d1 < {STOP_TOL} AND d2 < {STOP_TOL} AND n >= 3 AND n_samples >= {STOP_MIN}
          ORDER BY n_samples LIMIT 1)"""


def stopped_sql(policy):
    """One policy's record as a subquery."""
    stop, upto = {
        "exact": ("stops AS (SELECT 0 AS n_samples, 0.0 AS tau WHERE FALSE)", "TRUE"),
        "row": (ROW_STOP, "(seq_id, start) IN (SELECT (seq_id, start) FROM numbered WHERE rn <= "
                          "(SELECT n_samples FROM stops))"),
        "file": (file_stop("scored", "seq_id", STOP_STEP, STOP_TOL),
                 "seq_id <= (SELECT file FROM files WHERE n_samples = "
                 "(SELECT n_samples FROM stops))"),
    }[policy]
    return "(" + sql(*EM_WITH_LATENTS, STOP_SCORES, stop, select=AT_STOP.format(
        policy=policy, stats=PSI_STATS.replace(", 6)", ", 4)"), upto=upto)) + ")"


@query("calibration_stopped", " UNION ALL ".join(map(stopped_sql, ("exact", "row", "file"))))
def calibration_stopped(spark, sf_dir):
    """The record of each stop policy from one pass over the payloads; a shard per video."""
    latents = payload_rows(spark, sf_dir)
    shard = F.format_string("shard_%06d", "video_index")
    changes = materialize(frame_changes(latents, SHAPE, tag=None).withColumns(
        {"file_path": shard, "row_index": F.col("tubelet_start").cast("long"), "tag": F.lit("all")}),
        "by-video")
    return gather([
        flat_record(calibrate(changes, 20, "all", policy, STOP_STEP, STOP_TOL, STOP_MIN), 4)
        .withColumn("policy", F.lit(policy)) for policy in ("exact", "row", "file")])


@query("latent_index", sql(*EM_WITH_LATENTS, select="""
SELECT DISTINCT factory_id, worker_id, video_index, tubelet_start FROM latents"""))
def latent_index_query(spark, sf_dir):
    store = latent_store(spark, sf_dir)
    # Read twice to show set semantics: the same rows make the same index.
    both = read_latents(spark, store).unionByName(read_latents(spark, store))
    return index_of(both)
