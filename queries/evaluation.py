"""Target pairs, volatility, adaptive threshold, robust loss, early stopping.

A run is one label; a batch is two consecutive windows of its sequence.
"""

import pandas as pd
from pyspark.sql import functions as F, types as T

from driftgate.functions.expressions import huber
from driftgate.functions.udfs import huber_mean
from driftgate.operators import evaluation as E
from driftgate.operators.frames import shift_pairs
from queries.fixtures import (
    EM, EV_TUB, EV_FRAMES, em_tubelets, ev_tubelets, r, rows, table,
)
from queries.registry import query, sql

PAIRS = 6
PART_ROWS = 50_000
DELTA = 0.1
KEYS = ["run", "step", "direction"]

EM_PAIRS = f"""pairs AS (
  SELECT seq_id AS run, start, t, start // 16 AS step, 'fwd' AS direction, z AS input,
         lead(z) OVER w AS target FROM em_tub
  WINDOW w AS (PARTITION BY seq_id, start ORDER BY t) QUALIFY t < {PAIRS}
  UNION ALL
  SELECT seq_id, start, t, start // 16, 'rev', lead(z) OVER w, z FROM em_tub
  WINDOW w AS (PARTITION BY seq_id, start ORDER BY t) QUALIFY t < {PAIRS})"""
EM_WITH_PAIRS = [*EM, EM_PAIRS]


def em_pairs(spark, sf_dir):
    """Pairs with their batch; the prediction is the input (persistence)."""
    pairs = shift_pairs(em_tubelets(spark, sf_dir), "z", PAIRS)
    return pairs.select(F.col("seq_id").alias("run"), "start", "t",
                        F.floor(F.col("start") / 16).alias("step"), "direction", "input",
                        "target")


@query("shift_pairs", sql(*EM_WITH_PAIRS, select="""
SELECT run, start, t, direction, CAST(input[1] AS DOUBLE) AS input_head,
       CAST(target[64] AS DOUBLE) AS target_tail FROM pairs"""))
def shift_pairs_query(spark, sf_dir):
    return em_pairs(spark, sf_dir).select(
        "run", "start", "t", "direction", F.col("input")[0].cast("double").alias("input_head"),
        F.col("target")[63].cast("double").alias("target_tail"))


# --- volatility and adaptive threshold ---------------------------------------

SIGMAS = """sigmas AS (
  SELECT run, step, direction, sqrt(var_samp(CAST(v AS DOUBLE)) + 1e-8) AS sigma
  FROM (SELECT run, step, direction, unnest(target) AS v FROM pairs) GROUP BY ALL)"""


def sigmas(spark, sf_dir):
    return E.batch_sigma(em_pairs(spark, sf_dir), keys=KEYS)


@query("batch_sigma", sql(*EM_WITH_PAIRS, SIGMAS, select="""
SELECT run, step, direction, round(sigma, 6) AS sigma FROM sigmas"""))
def batch_sigma(spark, sf_dir):
    return sigmas(spark, sf_dir).withColumn("sigma", r("sigma"))


@query("validation_delta", sql(*EM, select="""
SELECT round(sqrt(avg(v) + 1e-8), 6) AS delta, count(*) AS n_batches FROM (
  SELECT batch_id, var_samp(CAST(x AS DOUBLE)) AS v
  FROM (SELECT start // 8 AS batch_id, unnest(z) AS x FROM em_tub) WHERE batch_id < 4
  GROUP BY batch_id)"""))
def validation_delta(spark, sf_dir):
    batched = em_tubelets(spark, sf_dir).select(
        F.floor(F.col("start") / 8).alias("batch_id"), "z")
    return E.validation_delta(batched, "z", n=4).withColumn("delta", r("delta"))


# Recursive: the threshold before, the shock, the momentum, the threshold after.
FOLD = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY step, direction) AS n FROM sigmas),
folded AS (
  SELECT run, n, sigma AS delta FROM numbered WHERE n = 1
  UNION ALL
  SELECT s.run, s.n, b * f.delta + (1 - b) * s.sigma
  FROM folded f JOIN numbered s ON s.run = f.run AND s.n = f.n + 1,
  LATERAL (SELECT 0.50 + 0.49 * exp(-2.0 * abs(s.sigma - f.delta) / (f.delta + 1e-8)) AS b)),
deltas AS (SELECT s.run, step, direction, sigma, delta
           FROM numbered s JOIN folded f ON s.run = f.run AND s.n = f.n)"""


def fold_sql(select):
    return sql(*EM_WITH_PAIRS, SIGMAS, FOLD, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


ADAPTIVE = fold_sql("""
SELECT run, step, direction, round(sigma, 6) AS sigma, round(delta, 6) AS delta FROM deltas""")


@query("adaptive_delta", ADAPTIVE)
def adaptive_delta(spark, sf_dir):
    return E.adaptive_delta(sigmas(spark, sf_dir)).withColumns(
        {"sigma": r("sigma"), "delta": r("delta")})


@query("delta_modes", sql(*EM_WITH_PAIRS, SIGMAS, FOLD, """
trained AS (SELECT run, max_by(delta, step * 10 + CASE direction WHEN 'rev' THEN 1 ELSE 0 END)
              AS delta FROM deltas WHERE run < 7 GROUP BY run),
first_sigma AS (SELECT run, sigma AS delta FROM numbered WHERE n = 1)""", select="""
SELECT 'adaptive' AS mode, run, step, direction, round(delta, 6) AS delta FROM deltas
UNION ALL
SELECT 'fixed', run, step, direction, 0.25 FROM sigmas
UNION ALL
SELECT 'frozen', s.run, step, direction, round(coalesce(t.delta, f.delta), 6)
FROM sigmas s JOIN first_sigma f ON s.run = f.run LEFT JOIN trained t ON s.run = t.run
""").replace("WITH ", "WITH RECURSIVE ", 1))
def delta_modes(spark, sf_dir):
    """All three modes; runs 7 and up were never trained, so frozen falls back there."""
    values = sigmas(spark, sf_dir)
    trained = E.adaptive_delta(values.where(F.col("run") < 7))
    modes = [E.delta_for(values, "adaptive"), E.delta_for(values, "fixed", fixed=0.25),
             E.delta_for(values, "frozen", trained=trained)]
    named = [m.select(F.lit(name).alias("mode"), "run", "step", "direction",
                      r("delta").alias("delta"))
             for name, m in zip(("adaptive", "fixed", "frozen"), modes)]
    return named[0].unionByName(named[1]).unionByName(named[2])


# --- loss --------------------------------------------------------------------

HUBER = f"""CASE WHEN abs(e) <= {DELTA} THEN 0.5 * e * e
  ELSE {DELTA} * (abs(e) - 0.5 * {DELTA}) END"""
LOSSES = f"""losses AS (
  SELECT step, direction, sum({HUBER}) / count(DISTINCT (run, start, t)) AS loss
  FROM (SELECT run, start, t, step, direction,
               unnest(list_transform(list_zip(input, target),
                      lambda p: CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))) AS e
        FROM pairs) GROUP BY step, direction)"""


def losses(spark, sf_dir):
    return E.huber_loss(em_pairs(spark, sf_dir), DELTA, "input", keys=["step", "direction"])


@query("huber_loss", sql(*EM_WITH_PAIRS, LOSSES, select="""
SELECT step, direction, round(loss, 6) AS loss FROM losses"""))
def huber_loss(spark, sf_dir):
    return losses(spark, sf_dir).withColumn("loss", r("loss"))


@query("eval_summary", sql(*EM_WITH_PAIRS, LOSSES, select="""
SELECT round(sum(loss) / 10, 6) AS mean_requested, round(avg(loss), 6) AS mean_actual,
       count(*) AS n_steps
FROM (SELECT step, sum(loss) AS loss FROM losses WHERE step < 10 GROUP BY step)"""))
def eval_summary(spark, sf_dir):
    return E.eval_summary(losses(spark, sf_dir), 10, "step").withColumns(
        {"mean_requested": r("mean_requested"), "mean_actual": r("mean_actual")})


@F.pandas_udf(T.LongType())
def group_size(values: pd.Series) -> int:
    return len(values)


@query("huber_udaf", sql(EV_FRAMES, EV_TUB, select="""
SELECT tag, round(avg(CASE WHEN abs(e) <= 20 THEN 0.5 * e * e ELSE 20 * (abs(e) - 10) END), 6)
  AS loss, count(*) AS n
FROM (SELECT event_type AS tag, lead(x) OVER (PARTITION BY seq_id, start ORDER BY t) - x AS e, t
      FROM ev_tub) WHERE t < 6 GROUP BY tag"""))
def huber_udaf(spark, sf_dir):
    """The Python aggregate per tag. It has no partial form, so each tag is cut into salted
    parts of bounded size first and the means are combined."""
    pairs = shift_pairs(ev_tubelets(spark, sf_dir), "x", PAIRS).where(
        F.col("direction") == "fwd")
    parts = max(64, rows(spark, sf_dir, "events") // PART_ROWS)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("seq_id", "start"), F.lit(parts)))
    parts = salted.groupBy(F.col("event_type").alias("tag"), "salt").agg(
        huber_mean("input", "target", F.lit(20.0)).alias("mean"), group_size("t").alias("n"))
    return parts.groupBy("tag").agg(
        r(F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("loss"),
        F.sum("n").alias("n"))


@query("huber_expression", sql(EV_FRAMES, EV_TUB, select="""
SELECT tag, round(avg(CASE WHEN abs(e) <= 20 THEN 0.5 * e * e ELSE 20 * (abs(e) - 10) END), 6)
  AS loss, count(*) AS n
FROM (SELECT event_type AS tag, lead(x) OVER (PARTITION BY seq_id, start ORDER BY t) - x AS e, t
      FROM ev_tub) WHERE t < 6 GROUP BY tag"""))
def huber_expression(spark, sf_dir):
    """The same loss as a JVM expression, which is the form to use."""
    pairs = shift_pairs(ev_tubelets(spark, sf_dir), "x", PAIRS).where(
        F.col("direction") == "fwd")
    return pairs.groupBy(F.col("event_type").alias("tag")).agg(
        r(F.avg(huber(F.col("input"), F.col("target"), F.lit(20.0)))).alias("loss"),
        F.count("*").alias("n"))


# --- early stopping ----------------------------------------------------------

@query("early_stop", """
WITH metrics AS (SELECT user_id AS run, CAST(day(ts) AS BIGINT) AS epoch,
                        round(avg(value), 4) AS val_loss FROM events GROUP BY ALL),
marked AS (SELECT *, row_number() OVER w AS n,
                  val_loss < coalesce(min(val_loss) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
                    AND 1 PRECEDING), CAST('Infinity' AS DOUBLE)) AS better
           FROM metrics WINDOW w AS (PARTITION BY run ORDER BY epoch)),
counted AS (SELECT *, n - coalesce(max(CASE WHEN better THEN n END) OVER (
                     PARTITION BY run ORDER BY epoch), 0) >= 5 AS stop FROM marked),
kept AS (SELECT *, coalesce(bool_or(stop) OVER (PARTITION BY run ORDER BY epoch
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS over
         FROM counted)
SELECT run, max(CASE WHEN better THEN epoch END) AS best_epoch,
       min(CASE WHEN better THEN val_loss END) AS best_loss, max(epoch) AS last_epoch,
       bool_or(stop) AS stopped
FROM kept WHERE NOT over GROUP BY run""")
def early_stop(spark, sf_dir):
    """One run per user, one epoch per day: aggregated, so a run has at most 31 rows."""
    metrics = table(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("run"), F.dayofmonth("ts").cast("long").alias("epoch")).agg(
            r(F.avg("value"), 4).alias("val_loss"))
    return E.early_stop(metrics, patience=5)
