"""Evaluation of a predictor over a latent table."""

from pyspark.sql import DataFrame, functions as F

from driftgate.functions.expressions import volatility
from driftgate.functions.payload import moments_from_payload, target_moments_from_payload
from driftgate.operators.evaluation import eval_summary, merge_moments
from driftgate.operators.scoring import score
from driftgate.settings import LATENT_SHAPE, SHIFT_PAIRS, VALIDATION_VARIANCE_BATCHES


def fixed_delta(batched: DataFrame, n=VALIDATION_VARIANCE_BATCHES) -> float:
    """Validation threshold from the payloads of the first n batches."""
    first = batched.where(F.col("batch_id") < n)
    variances = merge_moments(moments_from_payload(first, ["batch_id"]), ["batch_id"])
    return variances.agg(volatility(F.avg("var"))).first()[0]


def batch_volatility(batched: DataFrame, keys=("batch_id",), shape=LATENT_SHAPE,
                     pairs=SHIFT_PAIRS) -> DataFrame:
    """Volatility of the shifted targets of each batch and direction, from one pass over the payloads:
    `keys`, direction, sigma, which is what `adaptive_delta` takes."""
    keys = [*keys, "direction"]
    moments = target_moments_from_payload(batched, keys[:-1], shape, pairs)
    return merge_moments(moments, keys).select(*keys, volatility(F.col("var")).alias("sigma"))


def evaluate(batched: DataFrame, steps, forward=None, backward=None, shape=LATENT_SHAPE,
             pairs=SHIFT_PAIRS) -> DataFrame:
    """Mean loss per step. `batched` has batch_id and latent_bytes."""
    delta = fixed_delta(batched)
    used = batched.where(F.col("batch_id") < steps)
    losses = score(used, ["batch_id"], delta, forward, backward, shape, pairs)
    per_batch = losses.groupBy("batch_id", "direction").agg(F.avg("loss").alias("loss"))
    return eval_summary(per_batch, steps)
