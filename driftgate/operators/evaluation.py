"""Model evaluation data: volatility, adaptive threshold, robust loss, early stopping."""

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from driftgate.functions.expressions import huber_over_channels, volatility
from driftgate.settings import (
    EARLY_STOP_PATIENCE, HUBER_ALPHA, HUBER_BETA_MAX, HUBER_BETA_MIN, HUBER_ETA,
    VALIDATION_VARIANCE_BATCHES,
)

# Order of the two updates inside one step: forward first.
STEP_ORDER = ["step", "direction"]


def batch_sigma(pairs: DataFrame, target="target", keys=("batch_id", "direction")) -> DataFrame:
    """Volatility of all target values of a batch (sample variance)."""
    values = pairs.select(*keys, F.explode(target).alias("v"))
    return values.groupBy(*keys).agg(
        volatility(F.var_samp(F.col("v").cast("double"))).alias("sigma"))


def validation_delta(frames: DataFrame, value, batch="batch_id",
                     n=VALIDATION_VARIANCE_BATCHES) -> DataFrame:
    """Fixed validation threshold from the mean variance of the first n batches."""
    values = frames.where(F.col(batch) < n).select(batch, F.explode(value).alias("v"))
    return (values.groupBy(batch).agg(F.var_samp(F.col("v").cast("double")).alias("var"))
            .agg(volatility(F.avg("var")).alias("delta"), F.count("*").alias("n_batches")))


def merge_moments(moments: DataFrame, keys) -> DataFrame:
    """Sample variance per group from (n, mean, m2) of its parts. Means enter as deviations from
    the group's mean, so a large mean does not cancel a small variance."""
    group = Window.partitionBy(*keys)
    mean = F.sum(F.col("n") * F.col("mean")).over(group) / F.sum("n").over(group)
    off = F.col("mean") - F.col("_mean")
    total = moments.withColumn("_mean", mean).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("m2") + F.col("n") * off * off).alias("squares"))
    return total.select(*keys, (F.col("squares") / (F.col("n") - 1)).alias("var"))


def next_delta(delta, sigma):
    """One update of the adaptive threshold; the first volatility initialises it. A missing one
    (a batch of a single value) is NaN, which the threshold keeps from then on."""
    sigma = math.nan if sigma is None else sigma
    if delta is None:
        delta = sigma
    shock = abs(sigma - delta) / (delta + HUBER_ETA)
    momentum = HUBER_BETA_MIN + (HUBER_BETA_MAX - HUBER_BETA_MIN) * math.exp(
        -HUBER_ALPHA * shock)
    return momentum * delta + (1 - momentum) * sigma


def adaptive_delta(sigmas: DataFrame, run="run") -> DataFrame:
    """Add `delta`, the threshold after each update of a run, in step order.

    The update is sequential and not associative, so a run is one ordered pass. Its rows
    (one double per batch and direction) stream through the task in Arrow batches; only the
    last threshold is held.
    """
    schema = T.StructType([*sigmas.schema.fields, T.StructField("delta", T.DoubleType())])
    columns = sigmas.columns
    ordered = sigmas.repartition(run).sortWithinPartitions(run, *STEP_ORDER)

    def fold(batches):
        current, delta, started = None, None, False
        for batch in batches:
            deltas = []
            for r, sigma in zip(batch.column(run).to_pylist(),
                                batch.column("sigma").to_pylist()):
                if not started or r != current:
                    current, delta, started = r, None, True
                delta = next_delta(delta, sigma)
                deltas.append(delta)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(deltas, pa.float64())],
                names=schema.names)

    return ordered.mapInArrow(fold, schema)


def delta_for(sigmas: DataFrame, mode, trained: DataFrame = None, fixed=None,
              run="run") -> DataFrame:
    """Threshold of each batch under a mode.

    adaptive: the updated threshold. frozen: the last threshold of the `trained` run, or,
    for a run without one, its first volatility. fixed: the given number.
    """
    if mode == "adaptive":
        return adaptive_delta(sigmas, run)
    if mode == "fixed":
        return sigmas.withColumn("delta", F.lit(float(fixed)))
    if mode != "frozen":
        raise ValueError(f"unknown mode {mode!r}")
    at = F.struct(*STEP_ORDER)
    last = trained.groupBy(run).agg(F.max_by("delta", at).alias("_last"))
    first = sigmas.groupBy(run).agg(F.min_by("sigma", at).alias("_first"))
    start = first.join(last, run, "left").select(
        run, F.coalesce("_last", "_first").alias("delta"))
    return sigmas.join(start, run)


def huber_loss(pairs: DataFrame, delta, pred="pred", target="target",
               keys=("batch_id", "direction"), positions=1) -> DataFrame:
    """Loss per batch and direction: summed over channels, averaged over positions.

    A row is one frame with `positions` spatial positions in its vector.
    """
    delta = delta if not isinstance(delta, (int, float)) else F.lit(float(delta))
    term = huber_over_channels(F.col(pred), F.col(target), delta) / positions
    return pairs.groupBy(*keys).agg(F.avg(term).alias("loss"))


def eval_summary(losses: DataFrame, steps, step="batch_id") -> DataFrame:
    """Loss over steps, forward plus reverse: divided by the requested and by the real
    number of steps."""
    per_step = (losses.where(F.col(step) < steps).groupBy(step)
                .agg(F.sum("loss").alias("loss")))
    return per_step.agg((F.sum("loss") / F.lit(steps)).alias("mean_requested"),
                        F.avg("loss").alias("mean_actual"), F.count("*").alias("n_steps"))


def early_stop(metrics: DataFrame, patience=EARLY_STOP_PATIENCE, run="run") -> DataFrame:
    """Best and last epoch of each run: only a strictly lower loss counts as better, and a
    run stops after `patience` epochs without one. One row per run and epoch comes in."""
    order = Window.partitionBy(run).orderBy("epoch")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    infinity = F.lit(float("inf"))
    best_so_far = F.coalesce(F.nanvl(F.min("val_loss").over(earlier), infinity), infinity)
    seen = (metrics.withColumn("_n", F.row_number().over(order))
            .withColumn("_better", F.coalesce(F.col("val_loss") < best_so_far, F.lit(False)))
            .withColumn("_best_n", F.coalesce(
                F.max(F.when(F.col("_better"), F.col("_n"))).over(upto), F.lit(0)))
            .withColumn("_stop", F.col("_n") - F.col("_best_n") >= patience)
            .withColumn("_stopped_before", F.coalesce(
                F.max("_stop").over(earlier), F.lit(False))))
    kept = seen.where(~F.col("_stopped_before"))
    improved = F.col("_better")
    return kept.groupBy(run).agg(
        F.max(F.when(improved, F.col("epoch"))).alias("best_epoch"),
        F.min(F.when(improved, F.col("val_loss"))).alias("best_loss"),
        F.max("epoch").alias("last_epoch"),
        F.max("_stop").alias("stopped"))
