"""Channel layout, flow magnitude, stencils, channel mix, gate, batch scoring.

An embedding of 64 values is read as a 4 x 4 grid with 4 channels, channel last.
"""

import numpy as np
from pyspark.sql import functions as F

from driftgate.functions.expressions import standardize
from driftgate.operators import scoring as S
from driftgate.operators.frames import channels_first, flow_magnitude, frame_diff, prefilter_motion
from driftgate.operators.evaluation import eval_summary
from driftgate.settings import CHANNEL_MEAN, CHANNEL_STD
from queries.evaluation import DELTA, EM_WITH_PAIRS, HUBER, LOSSES, PAIRS
from queries.fixtures import (
    EM, EV_WITH_L1, W, em_tubelets, ev_tubelets, payload_rows, r, table,
)
from queries.registry import query, sql

GRID, CHANNELS = (4, 4), 4
TENSOR = (W, *GRID, CHANNELS)


@query("standardize", """
SELECT o_orderkey, round((r / 255.0 - 0.485) / 0.229, 6) AS red,
       round((g / 255.0 - 0.456) / 0.224, 6) AS green,
       round((b / 255.0 - 0.406) / 0.225, 6) AS blue
FROM (SELECT o_orderkey, o_orderkey % 256 AS r, o_custkey % 256 AS g,
             (o_orderkey * 7 + o_custkey) % 256 AS b FROM orders)""")
def standardize_query(spark, sf_dir):
    pixels = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", """array(o_orderkey % 256, o_custkey % 256,
                               (o_orderkey * 7 + o_custkey) % 256) AS rgb""")
    scaled = pixels.withColumn("v", standardize(F.col("rgb"), CHANNEL_MEAN, CHANNEL_STD))
    return scaled.select("o_orderkey", *[r(F.col("v")[i]).alias(c)
                                         for i, c in enumerate(("red", "green", "blue"))])


@query("channels_first", sql(*EM, select="""
SELECT seq_id, start, channel, round(sum((t + 1) * v), 6) AS weighted, count(*) AS n
FROM (SELECT seq_id, start, t, unnest(range(64)) AS channel,
             unnest(CAST(z AS DOUBLE[])) AS v FROM em_tub) GROUP BY seq_id, start, channel"""))
def channels_first_query(spark, sf_dir):
    series = channels_first(em_tubelets(spark, sf_dir), "z")
    weighted = F.aggregate(
        F.transform("series", lambda v, i: (i + 1) * v.cast("double")), F.lit(0.0),
        lambda acc, x: acc + x)
    return series.select("seq_id", "start", F.col("channel").cast("long").alias("channel"),
                         r(weighted).alias("weighted"), F.size("series").cast("long").alias("n"))


@query("flow_magnitude", """
SELECT l_returnflag, round(avg(least(sqrt(l_quantity * l_quantity
         + (l_extendedprice / 2000) * (l_extendedprice / 2000)), 50.0)), 6) AS m_flow
FROM lineitem GROUP BY l_returnflag""")
def flow_magnitude_query(spark, sf_dir):
    vectors = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_quantity", (F.col("l_extendedprice") / 2000).alias("v"))
    return flow_magnitude(vectors, "l_quantity", "v", by=["l_returnflag"]).withColumn(
        "m_flow", r("m_flow"))


@query("prefilter_motion", sql(*EV_WITH_L1, select="""
SELECT seq_id, start, round(avg(l1), 6) AS score FROM ev_l1 GROUP BY seq_id, start
HAVING avg(l1) <= 40"""))
def prefilter_motion_query(spark, sf_dir):
    diffs = frame_diff(ev_tubelets(spark, sf_dir), "x")
    return prefilter_motion(diffs, 40.0).withColumn("score", r("score"))


# --- predictor stages --------------------------------------------------------

KERNEL = np.array([[[[((c + 1) + 3 * k - 2 * dy + dx) / 50 for dx in (-1, 0, 1)]
                     for dy in (-1, 0, 1)] for k in range(3)] for c in range(CHANNELS)])
KERNEL_BIAS = np.array([0.01 * (c + 1) for c in range(CHANNELS)])
MIX = np.array([[(o - c) / 10 + 0.2 for c in range(CHANNELS)] for o in range(CHANNELS)])
MIX_BIAS = np.array([0.02 * o for o in range(CHANNELS)])
GATE = np.array([0.3 - 0.1 * i for i in range(2 * CHANNELS)])
GATE_BIAS = 0.05
WEIGHTS = S.Weights(KERNEL, KERNEL_BIAS, MIX, MIX_BIAS, GATE, GATE_BIAS)

CELLS = """cells AS (
  SELECT seq_id, start, t, cell // 16 AS y, cell // 4 % 4 AS x, cell % 4 AS c, v FROM (
    SELECT seq_id, start, t, unnest(range(64)) AS cell, unnest(CAST(z AS DOUBLE[])) AS v
    FROM em_tub))"""


def stencil_sql(reach):
    """`reach` is the time distance of tap k as a function of k."""
    return sql(*EM, CELLS, f"""
taps AS (SELECT k, dy, dx, {reach} AS dt
         FROM (SELECT unnest(range(3)) AS k), (SELECT unnest([-1, 0, 1]) AS dy),
              (SELECT unnest([-1, 0, 1]) AS dx))""", select="""
SELECT o.seq_id, o.start, o.t, o.y * 16 + o.x * 4 + o.c AS cell,
       round(0.01 * (o.c + 1) + sum(((o.c + 1) + 3 * k - 2 * dy + dx) / 50 * i.v), 6) AS conv
FROM cells i JOIN taps ON TRUE JOIN cells o
  ON o.seq_id = i.seq_id AND o.start = i.start AND o.c = i.c
 AND i.t = o.t + dt AND i.y = o.y + dy AND i.x = o.x + dx
GROUP BY o.seq_id, o.start, o.t, o.y, o.x, o.c""")


def cell_rows(df, col, name):
    """An array column as one row per cell."""
    return df.select("seq_id", "start", "t", F.posexplode(col).alias("cell", name)).select(
        "seq_id", "start", "t", F.col("cell").cast("long").alias("cell"), r(name).alias(name))


@query("causal_stencil", stencil_sql("k - 2"))
def causal_stencil(spark, sf_dir):
    out = S.stencil(em_tubelets(spark, sf_dir), "z", KERNEL, KERNEL_BIAS, GRID)
    return cell_rows(out, "conv", "conv")


@query("anticausal_stencil", stencil_sql("k"))
def anticausal_stencil(spark, sf_dir):
    out = S.stencil(em_tubelets(spark, sf_dir), "z", KERNEL, KERNEL_BIAS, GRID, causal=False)
    return cell_rows(out, "conv", "conv")


@query("neighbor_join", sql(*EM, CELLS, select="""
SELECT o.seq_id, o.start, o.t, o.c, o.y, o.x,
       round(sum(i.v * (1 + (i.y - o.y) * 3 + (i.x - o.x))), 6) AS total
FROM cells o JOIN cells i ON o.seq_id = i.seq_id AND o.start = i.start AND o.t = i.t
 AND o.c = i.c AND abs(o.y - i.y) <= 1 AND abs(o.x - i.x) <= 1
GROUP BY o.seq_id, o.start, o.t, o.c, o.y, o.x"""))
def neighbor_join(spark, sf_dir):
    kernel = [[1 + dy * 3 + dx for dx in (-1, 0, 1)] for dy in (-1, 0, 1)]
    summed = S.neighbor_sum(em_tubelets(spark, sf_dir), "z", kernel, GRID, CHANNELS)
    cells = summed.select("seq_id", "start", "t", F.posexplode("total").alias("i", "total"))
    return cells.select("seq_id", "start", "t", (F.col("i") % 4).cast("long").alias("c"),
                        F.floor(F.col("i") / 16).alias("y"),
                        (F.floor(F.col("i") / 4) % 4).alias("x"), r("total").alias("total"))


MIXED = """mixed AS (
  SELECT i.seq_id, i.start, i.t, i.y, i.x, o.c,
         0.02 * o.c + sum(((o.c - i.c) / 10 + 0.2) * i.v) AS m
  FROM cells i JOIN (SELECT unnest(range(4)) AS c) o ON TRUE
  GROUP BY i.seq_id, i.start, i.t, i.y, i.x, o.c)"""


@query("channel_mix", sql(*EM, CELLS, MIXED, select="""
SELECT seq_id, start, t, y * 16 + x * 4 + c AS cell, round(m, 6) AS mixed FROM mixed"""))
def channel_mix(spark, sf_dir):
    frames = em_tubelets(spark, sf_dir).withColumn("z", F.col("z").cast("array<double>"))
    return cell_rows(S.channel_mix(frames, "z", MIX, MIX_BIAS, GRID), "mixed", "mixed")


@query("gated_blend", sql(*EM, CELLS, MIXED, """
gates AS (SELECT seq_id, start, t, y, x,
            1 / (1 + exp(-(0.05 + sum((0.3 - 0.1 * c) * v
              + (0.3 - 0.1 * (4 + c)) * (v / (1 + exp(-v))))))) AS u
          FROM cells GROUP BY seq_id, start, t, y, x)""", select="""
SELECT seq_id, start, t, y * 16 + x * 4 + c AS cell, round((1 - u) * v + u * m, 6) AS pred
FROM cells JOIN mixed USING (seq_id, start, t, y, x, c) JOIN gates USING (seq_id, start, t, y, x)
"""))
def gated_blend(spark, sf_dir):
    frames = em_tubelets(spark, sf_dir).withColumn("z", F.col("z").cast("array<double>"))
    mixed = S.channel_mix(S.activate(frames, "z"), "z", MIX, MIX_BIAS, GRID)
    out = S.gated_blend(mixed, "z", "activated", "mixed", GATE, GATE_BIAS, GRID)
    return cell_rows(out, "pred", "pred")


# --- scoring -----------------------------------------------------------------

def predictor_sql(name, used, reach):
    """The whole predictor over the frames that `used` selects, as subquery `name`."""
    return f"""{name}_in AS (SELECT * FROM cells WHERE {used}),
{name}_conv AS (
  SELECT o.seq_id, o.start, o.t, o.y, o.x, o.c, any_value(o.v) AS z,
         0.01 * (o.c + 1) + sum(((o.c + 1) + 3 * k - 2 * dy + dx) / 50 * i.v) AS conv
  FROM {name}_in i
  JOIN (SELECT k, dy, dx, {reach} AS dt FROM (SELECT unnest(range(3)) AS k),
          (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)) ON TRUE
  JOIN {name}_in o ON o.seq_id = i.seq_id AND o.start = i.start AND o.c = i.c
   AND i.t = o.t + dt AND i.y = o.y + dy AND i.x = o.x + dx
  GROUP BY o.seq_id, o.start, o.t, o.y, o.x, o.c),
{name}_act AS (SELECT *, conv / (1 + exp(-conv)) AS a FROM {name}_conv),
{name}_gate AS (
  SELECT seq_id, start, t, y, x,
         1 / (1 + exp(-(0.05 + sum((0.3 - 0.1 * c) * z + (0.3 - 0.1 * (4 + c)) * a)))) AS u
  FROM {name}_act GROUP BY seq_id, start, t, y, x),
{name}_mix AS (
  SELECT i.seq_id, i.start, i.t, i.y, i.x, o.c,
         0.02 * o.c + sum(((o.c - i.c) / 10 + 0.2) * i.a) AS m
  FROM {name}_act i JOIN (SELECT unnest(range(4)) AS c) o ON TRUE
  GROUP BY i.seq_id, i.start, i.t, i.y, i.x, o.c),
{name} AS (
  SELECT seq_id, start, t, y, x, c, (1 - u) * z + u * m AS pred
  FROM {name}_act JOIN {name}_mix USING (seq_id, start, t, y, x, c)
  JOIN {name}_gate USING (seq_id, start, t, y, x))"""


FORWARD = predictor_sql("fwd", f"t < {PAIRS}", "k - 2")
BACKWARD = predictor_sql("rev", f"t > 0 AND t <= {PAIRS}", "k")
SUMMARY = """
SELECT round(sum(loss) / 10, 4) AS mean_requested, round(avg(loss), 4) AS mean_actual,
       count(*) AS n_steps
FROM (SELECT step, sum(loss) AS loss FROM losses WHERE step < 10 GROUP BY step)"""


@query("score_persistence", sql(*EM_WITH_PAIRS, LOSSES.replace(
    "count(DISTINCT (run, start, t))", "(16 * count(DISTINCT (run, start, t)))"),
    select=SUMMARY))
def score_persistence(spark, sf_dir):
    """Payload scoring without weights: the prediction is the input."""
    return scored_summary(spark, sf_dir)


@query("score_predictor", sql(*EM, CELLS, FORWARD, BACKWARD, f"""
errors AS (
  SELECT 'fwd' AS direction, p.start // 16 AS step, p.pred - c.v AS e
  FROM fwd p JOIN cells c ON p.seq_id = c.seq_id AND p.start = c.start AND c.t = p.t + 1
   AND p.y = c.y AND p.x = c.x AND p.c = c.c
  UNION ALL
  SELECT 'rev', p.start // 16, p.pred - c.v
  FROM rev p JOIN cells c ON p.seq_id = c.seq_id AND p.start = c.start AND c.t = p.t - 1
   AND p.y = c.y AND p.x = c.x AND p.c = c.c),
losses AS (SELECT step, direction, sum({HUBER}) / (count(*) / 4) AS loss
           FROM errors GROUP BY step, direction)""", select=SUMMARY))
def score_predictor(spark, sf_dir):
    """Payload scoring with the small test predictor in both directions."""
    return scored_summary(spark, sf_dir, WEIGHTS, WEIGHTS)


def scored_summary(spark, sf_dir, forward=None, backward=None):
    latents = payload_rows(spark, sf_dir).withColumn(
        "step", F.floor(F.col("tubelet_start") / 16)).where(F.col("step") < 10)
    losses = S.score(latents, ["step"], DELTA, forward, backward, TENSOR, PAIRS)
    per_step = losses.groupBy("step", "direction").agg(F.avg("loss").alias("loss"))
    return eval_summary(per_step, 10, "step").withColumns(
        {"mean_requested": r("mean_requested", 4), "mean_actual": r("mean_actual", 4)})


@query("predictor_columns", sql(*EM, CELLS, FORWARD, select="""
SELECT seq_id, start, t, y * 16 + x * 4 + c AS cell, round(pred, 6) AS pred FROM fwd"""))
def predictor_columns(spark, sf_dir):
    """The whole predictor in column form."""
    inputs = em_tubelets(spark, sf_dir).where(F.col("t") < PAIRS)
    return cell_rows(S.predict(inputs, "z", WEIGHTS, GRID), "pred", "pred")
