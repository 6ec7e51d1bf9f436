"""Full calibration: noise floor and gate from a latent table, with one payload pass."""

from pyspark.sql import DataFrame, functions as F

from driftgate.functions.expressions import excess_sum
from driftgate.functions.payload import frame_l1_from_payload
from driftgate.operators.calibration import (
    calibration_record, converge_by_file, converge_by_row, epsilon, fetch_rows, file_checks,
    most_static, psi_stats, stats_at_stop, tau, tau_checkpoints,
)
from driftgate.schema import LATENT_KEYS, ROW_ADDRESS
from driftgate.session import materialize
from driftgate.settings import (
    CHECKPOINT_STEP, CONVERGENCE_TOLERANCE, FILE_STOP_PATIENCE, LATENT_SHAPE,
    ROW_STOP_MIN_SAMPLES, SAMPLE_TAG, STATIC_TARGET,
)
from driftgate.sources.calibration import guard
from driftgate.sources.latents import only_tag, with_address


def frame_changes(latents: DataFrame, shape=LATENT_SHAPE, tag=SAMPLE_TAG) -> DataFrame:
    """Per-frame changes of every sampled tubelet, written once.

    The payload is read here and nowhere else: noise floor, scores, gate and every later
    recalibration need only these doubles. The tag filter reaches the scan; `tag=None` takes rows
    of every tag, as an epoch over the whole store needs. Read `latents` with `payload_bytes`, so that
    batches are bounded.
    """
    narrow = [*LATENT_KEYS, "tag", "m_flow", *ROW_ADDRESS]
    tagged = latents if tag is None else only_tag(latents, tag)
    return materialize(frame_l1_from_payload(with_address(tagged), narrow, shape), "frame-changes")


def scores(changes: DataFrame, eps) -> DataFrame:
    """Motion score of each tubelet from its stored frame changes above `eps`, a number or a column."""
    eps = F.lit(float(eps)) if isinstance(eps, (int, float)) else eps
    # The floor may be a scalar subquery, which a lambda cannot contain: name it first.
    named = changes.withColumn("_eps", eps)
    return named.withColumn("psi", excess_sum(F.col("l1"), F.col("_eps"))).drop("l1", "_eps")


def calibrate(changes: DataFrame, n_static=STATIC_TARGET, tag=SAMPLE_TAG, policy="exact",
              step=CHECKPOINT_STEP, tol=CONVERGENCE_TOLERANCE, min_samples=ROW_STOP_MIN_SAMPLES,
              patience=FILE_STOP_PATIENCE) -> DataFrame:
    """The calibration record from the rows of `tag` in a table of frame changes. Raises without any
    sample, and on NaN.

    `policy` tells which scores the gate and its statistics are taken from:

    - exact: all of them;
    - row: in order of file and row, those up to the first of the checkpoints every `step` scores, from
      `min_samples` on, where the last two changes are below `tol`;
    - file: those of the files up to the end at which `patience` checks in a row, one for
      each `step` scores, have changed by less than `tol`.

    Without a stop, all scores are used.
    """
    if policy not in ("exact", "row", "file"):
        raise ValueError(f"policy must be 'exact', 'row' or 'file', not {policy!r}")
    changes = only_tag(changes, tag)
    winners = most_static(changes.select(*ROW_ADDRESS, "tag", "m_flow"), n_static, tag)
    chosen = materialize(fetch_rows(changes, winners, n_static).select("l1"), "static-changes")
    static = chosen.select(F.explode("l1").alias("l1"))
    guard(static)
    eps = epsilon(static)
    address = [] if policy == "exact" else ROW_ADDRESS
    psi = materialize(scores(changes, eps.scalar()).select("psi", *address), "psi")
    guard(psi, "psi")
    n_static = chosen.agg(F.count("*").alias("n"))
    stats, gate = psi_stats(psi), None
    if policy != "exact":
        everything = tau(psi)
        if policy == "row":
            checks = tau_checkpoints(psi, ROW_ADDRESS, step, stats=True)
            stop = converge_by_row(checks, everything, tol, min_samples)
        else:
            checks = file_checks(psi, "file_path", step, stats=True)
            stop = converge_by_file(checks, everything, tol, patience)
        stop = materialize(stop, "stop")
        stats, gate = stats_at_stop(stop, stats), stop.select("tau")
    return calibration_record(eps, n_static, stats, gate)
