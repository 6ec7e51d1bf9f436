"""Noise floor, motion gate, and the convergence of the gate's estimate."""

from pyspark.sql import DataFrame, Window, functions as F

from driftgate.operators.ordering import index_rows
from driftgate.operators.percentiles import exact_percentiles, prefix_percentiles
from driftgate.schema import CALIBRATION, ROW_ADDRESS
from driftgate.session import broadcast_bounded, materialize
from driftgate.settings import (
    CHECKPOINT_STEP, CONVERGENCE_TOLERANCE, EPSILON_PERCENTILE, FILE_STOP_PATIENCE,
    MIN_TUBELETS_FOR_EPSILON, ROW_STOP_MIN_CHECKPOINTS, ROW_STOP_MIN_SAMPLES, SAMPLE_TAG,
    STATIC_TARGET, TAU_PERCENTILE,
)
from driftgate.functions.expressions import motion_measured


def valid_motion(df: DataFrame) -> DataFrame:
    return df.where(motion_measured("m_flow"))


def most_static(motion: DataFrame, n=STATIC_TARGET, tag=SAMPLE_TAG, ties=ROW_ADDRESS):
    """The n sampled rows with the least measured motion, ties in scan order."""
    return (valid_motion(motion.where(F.col("tag") == tag))
            .orderBy("m_flow", *ties).limit(n))


def winners_by_shard(top: DataFrame, shard="file_path", row="row_index") -> DataFrame:
    """Rows to fetch from each shard. `top` is a top-n, so the lists are bounded by n."""
    return top.groupBy(shard).agg(F.sort_array(F.collect_list(row)).alias("rows"),
                                  F.count("*").alias("n_rows"))


def fetch_rows(latents: DataFrame, winners: DataFrame, n=STATIC_TARGET,
               address=ROW_ADDRESS) -> DataFrame:
    """Full rows at the addresses of `winners`, a top-n. That bounds the broadcast; the wide
    side stays in the tasks that scan it."""
    return latents.join(broadcast_bounded(winners.select(*address), n), address, "left_semi")


def epsilon(l1: DataFrame, pct=EPSILON_PERCENTILE, row_bound=None) -> DataFrame:
    """Noise floor: a high percentile of the frame changes of static tubelets."""
    return exact_percentiles(l1, "l1", {"epsilon": pct}, row_bound)


def sufficiency(l1: DataFrame, keys, minimum=MIN_TUBELETS_FOR_EPSILON) -> DataFrame:
    """Differences and tubelets available, and whether they suffice for a stable floor."""
    per_tubelet = l1.groupBy(*keys).agg(F.count("l1").alias("n"))
    return per_tubelet.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_diffs"),
        F.count("*").alias("n_tubelets")).withColumn(
            "sufficient", (F.col("n_diffs") > 0) & (F.col("n_tubelets") >= minimum))


def tau(psi: DataFrame, pct=TAU_PERCENTILE, row_bound=None) -> DataFrame:
    """Motion gate: a low percentile of the motion scores."""
    return exact_percentiles(psi, "psi", {"tau": pct}, row_bound)


def psi_stats(psi: DataFrame, row_bound=None) -> DataFrame:
    """Mean, population deviation, p20, p50, p80 and count of the motion scores."""
    return exact_percentiles(
        psi, "psi", {"p20": 0.2, "p50": 0.5, "p80": 0.8}, row_bound,
        more=[F.avg("psi").alias("mean"), F.stddev_pop("psi").alias("std"),
              F.count("psi").alias("n")])


def calibration_record(eps: DataFrame, n_static: DataFrame, stats: DataFrame,
                       gate: DataFrame = None) -> DataFrame:
    """The one nested row that is stored. `gate` overrides the exact tau (early stop)."""
    tau_value = F.col("p20") if gate is None else gate.scalar()
    return stats.select(
        eps.scalar().alias("epsilon_noise_floor"),
        tau_value.alias("tau_kinetic_gate"),
        n_static.scalar().alias("samples_used_for_epsilon"),
        F.col("n").alias("samples_used_for_tau"),
        F.struct("mean", "std", "p20", "p50", "p80").alias("psi_stats"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in CALIBRATION.fields])


# --- convergence -------------------------------------------------------------

#: What a checkpoint states of the scores before it, apart from their number and the gate.
STATS = ("mean", "std", "p20", "p50", "p80")


def _prefix_stats(blocks: DataFrame, pct, stats) -> DataFrame:
    """The gate after each block, and with `stats` the moments and percentiles of the same scores.

    Moments come from one row per block, merged in order: deviations are taken from the mean of all
    scores, so a large mean does not cancel a small deviation.
    """
    probs = {"tau": pct} | ({"p20": 0.2, "p50": 0.5, "p80": 0.8} if stats else {})
    curve = prefix_percentiles(blocks, probs)
    if not stats:
        return curve
    value = F.col("value").cast("double")
    blocks = blocks.where(F.col("value").isNotNull())
    centre = blocks.agg(F.avg(value)).scalar()
    moments = blocks.withColumn("_off", value - centre).groupBy("block").agg(
        F.count("*").alias("_n"), F.sum("_off").alias("_s"),
        F.sum(F.col("_off") * F.col("_off")).alias("_q"))
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    n, s, q = (F.sum(c).over(upto) for c in ("_n", "_s", "_q"))
    off = F.col("_s_all") / F.col("_n_all")
    moments = moments.withColumns({"_n_all": n, "_s_all": s, "_q_all": q}).select(
        "block", (off + centre).alias("mean"),
        F.sqrt(F.greatest(F.col("_q_all") / F.col("_n_all") - off * off, F.lit(0.0))).alias("std"))
    return curve.join(moments, "block")


def tau_checkpoints(psi: DataFrame, order, step=CHECKPOINT_STEP, pct=TAU_PERCENTILE,
                    row_bound=None, stats=False) -> DataFrame:
    """The gate after every `step` samples in the given total order: (n_samples, tau), and with `stats`
    the mean, population deviation, p20, p50 and p80 of those samples.

    Choose a step that gives at most some thousands of checkpoints.
    """
    numbered = index_rows(psi, [], order, "_pos", row_bound=row_bound)
    blocks = numbered.select(F.floor(F.col("_pos") / step).cast("long").alias("block"),
                             F.col("psi").alias("value"))
    if stats:
        blocks = materialize(blocks, "checkpoint-blocks")
    curve = _prefix_stats(blocks, pct, stats)
    # A block that is not full is not a checkpoint.
    return (curve.withColumn("n_samples", (F.col("block") + 1) * step)
            .where(F.col("n") == F.col("n_samples"))
            .select("n_samples", "tau", *STATS[:len(STATS) * stats]))


def converge_by_row(checkpoints: DataFrame, final_tau: DataFrame,
                    tol=CONVERGENCE_TOLERANCE, min_samples=ROW_STOP_MIN_SAMPLES) -> DataFrame:
    """Stop at the first checkpoint whose last two changes are both below `tol`; otherwise
    the gate over everything. Checkpoints are few (see `tau_checkpoints`)."""
    in_order = Window.orderBy("n_samples")
    stops = (checkpoints
             .withColumn("_n", F.row_number().over(in_order))
             .withColumn("_d1", F.abs(F.col("tau") - F.lag("tau", 1).over(in_order)))
             .withColumn("_d2", F.abs(F.lag("tau", 1).over(in_order)
                                      - F.lag("tau", 2).over(in_order)))
             .where((F.col("_d1") < tol) & (F.col("_d2") < tol)
                    & (F.col("_n") >= ROW_STOP_MIN_CHECKPOINTS)
                    & (F.col("n_samples") >= min_samples)))
    return _stopped(_first(stops), final_tau)


def file_checks(psi: DataFrame, file, step=CHECKPOINT_STEP, pct=TAU_PERCENTILE,
                stats=False) -> DataFrame:
    """Gate checks at file ends: (pos, n_samples, tau), files in order of `file`, and with `stats` the
    same of the samples so far as `tau_checkpoints`.

    A file end is a check when the samples so far reach the moving mark; the mark then moves
    by one step, even if several were passed. With m = whole steps reached at file i, the
    checks done are c(i) = min(c(i-1) + 1, m(i)), that is i + min over j <= i of (m(j) - j),
    a running minimum instead of a loop. Files without samples do not appear.
    """
    per_file = psi.groupBy(F.col(file).alias("_file")).agg(F.count("*").alias("n"))
    files = index_rows(per_file, [], ["_file"], "_pos")
    upto = Window.orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    files = files.withColumn("n_samples", F.sum("n").over(upto))
    i = F.col("_pos") + 1
    slack = F.floor(F.col("n_samples") / step) - i
    files = files.withColumn("_checks", i + F.least(F.lit(0), F.min(slack).over(upto)))
    before = F.lag("_checks", 1, 0).over(Window.orderBy("_pos"))
    checks = files.withColumn("_is_check", F.col("_checks") > before)
    # Scores up to a check: number the files between checks as one block.
    block = F.coalesce(
        F.sum(F.col("_is_check").cast("long")).over(
            Window.orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    checks = checks.withColumn("block", block)
    values = psi.join(checks.select("_file", "block"), psi[file] == F.col("_file")).select(
        "block", F.col("psi").alias("value"))
    if stats:
        values = materialize(values, "check-blocks")
    names = ["tau", *STATS[:len(STATS) * stats]]
    curve = _prefix_stats(values, pct, stats)
    return (checks.where("_is_check").join(curve.select("block", *names), "block")
            .select(F.col("_pos").alias("pos"), "n_samples", *names))


def converge_by_file(checks: DataFrame, final_tau: DataFrame, tol=CONVERGENCE_TOLERANCE,
                     patience=FILE_STOP_PATIENCE) -> DataFrame:
    """Stop at the first check that ends `patience` successive changes below `tol`; the
    first check is compared with 0. Otherwise the gate over everything."""
    in_order = Window.orderBy("pos")
    small = checks.withColumn(
        "_small", F.abs(F.col("tau") - F.lag("tau", 1, 0.0).over(in_order)) < tol)
    recent = F.count_if("_small").over(in_order.rowsBetween(-(patience - 1), 0))
    stops = small.withColumn("_streak", recent).where(F.col("_streak") >= patience)
    return _stopped(_first(stops), final_tau)


def _first(stops):
    """The first stop as one row `s`, null if there is none."""
    names = ["n_samples", "tau", *[c for c in STATS if c in stops.columns]]
    return stops.agg(F.min(F.struct(*names)).alias("s"))


def _stopped(first_stop, final_tau):
    """Statistics of the scores at the stop are added where the checkpoints have them."""
    fields = first_stop.schema["s"].dataType.names
    return first_stop.select(
        F.col("s").isNotNull().alias("converged"),
        F.col("s.n_samples").alias("n_samples"),
        F.coalesce(F.col("s.tau"), final_tau.scalar()).alias("tau"),
        *[F.col(f"s.{c}").alias(c) for c in STATS if c in fields])


def stats_at_stop(stop: DataFrame, stats: DataFrame) -> DataFrame:
    """The row of `psi_stats` as of the stop, or over everything where there was none."""
    both = stop.select("converged", F.col("n_samples").alias("_n"),
                       *[F.col(c).alias(f"_{c}") for c in STATS]).withColumn(
        "_all", stats.select(F.struct(*STATS, "n")).scalar())
    return both.select(*[F.when(F.col("converged"), F.col(f"_{c}")).otherwise(F.col(f"_all.{c}"))
                         .alias(c) for c in [*STATS, "n"]])
