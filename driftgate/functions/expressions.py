"""Column expressions: filters, hashes, vector arithmetic and loss terms. All JVM-side."""

from pyspark.sql import Column, functions as F

from driftgate.settings import (
    HUBER_ETA, SPLIT_BUCKETS, VALIDATION_BUCKET,
)


# --- keys, hashes, filters ---------------------------------------------------

def latent_id(*keys) -> Column:
    """Composite identity of a tubelet; null parts compare equal to null parts."""
    return F.struct(*keys)


def shuffle_key(key, seed) -> Column:
    """Sort key of a seeded shuffle. Depends on the seed and the key only, so the order is
    the same for any partitioning and after any retry."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def split_bucket(factory, video, buckets=SPLIT_BUCKETS) -> Column:
    """Bucket of a video: the first 8 hex digits of an md5, modulo `buckets`."""
    digest = F.md5(F.concat_ws("_", F.col(factory).cast("string"), F.col(video).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets


def split_name(factory, video) -> Column:
    bucket = split_bucket(factory, video)
    return F.when(bucket == VALIDATION_BUCKET, "val").otherwise("train")


def motion_measured(col="m_flow") -> Column:
    """True for a measured motion value: not the negative sentinel, NaN or null."""
    return (F.col(col) >= 0) & ~F.isnan(col)


# --- vectors -----------------------------------------------------------------

def abs_diff(current, previous, vector: bool) -> Column:
    """Absolute change between two frames, in double."""
    current, previous = F.col(current), F.col(previous)
    if vector:
        return F.zip_with(current, previous,
                          lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return F.abs(current.cast("double") - previous.cast("double"))


def vector_mean(col) -> Column:
    values = F.col(col)
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)


def excess(l1, eps) -> Column:
    """Motion above the noise floor."""
    return F.greatest(F.lit(0.0), l1 - eps)


def excess_sum(l1_array, eps) -> Column:
    """Motion score of one tubelet from its array of per-frame changes."""
    return F.aggregate(l1_array, F.lit(0.0), lambda acc, x: acc + excess(x, eps))


def standardize(values, mean, std) -> Column:
    """Byte values to [0, 1], minus the channel mean, over the channel deviation."""
    params = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s"))
                       for m, s in zip(mean, std)])
    return F.zip_with(values, params, lambda v, p: (v / 255.0 - p["m"]) / p["s"])


def flow_magnitude(u, v, cap) -> Column:
    return F.least(F.sqrt(u * u + v * v), F.lit(float(cap)))


# --- loss terms --------------------------------------------------------------

def huber(pred, target, delta) -> Column:
    error = F.abs(pred.cast("double") - target.cast("double"))
    return F.when(error <= delta, 0.5 * error * error).otherwise(delta * (error - 0.5 * delta))


def huber_over_channels(pred, target, delta) -> Column:
    """Huber terms of two vectors summed over their channels."""
    terms = F.zip_with(pred, target, lambda p, t: huber(p, t, delta))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def volatility(variance) -> Column:
    return F.sqrt(variance + F.lit(HUBER_ETA))


def silu(x) -> Column:
    return x / (1 + F.exp(-x))
