"""Binary tensor payloads: encode, decode, and the one-pass reductions over them.

A full payload is 54 MiB, so it is reduced to a few doubles inside the task that scanned it
and never crosses an exchange. Filter and prune columns before calling these: neither passes
through `mapInArrow`.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from driftgate.settings import LATENT_SHAPE, SHIFT_PAIRS

FLOAT_BYTES = 4
SLICE = 1 << 20


def payload_size(shape=LATENT_SHAPE) -> int:
    """Bytes of a payload: what scans of payloads are bounded by."""
    return math.prod(shape) * FLOAT_BYTES


@F.pandas_udf(T.BinaryType())
def encode_latent(vectors: pd.Series) -> pd.Series:
    """Numeric arrays to float32 bytes."""
    def pack(v):
        if v is None:
            return None
        array = np.asarray(v)
        if not np.issubdtype(array.dtype, np.number):
            raise TypeError(f"latent must be numeric, got {array.dtype}")
        return array.astype(np.float32).tobytes()
    return vectors.map(pack)


def decode_latent(length: int):
    """A UDF from float32 bytes to an array of `length` floats; other lengths raise."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def decode(payloads: pd.Series) -> pd.Series:
        def unpack(b):
            if b is None:
                return None
            if len(b) != length * FLOAT_BYTES:
                raise ValueError(f"payload has {len(b)} bytes, expected {length * FLOAT_BYTES}")
            return np.frombuffer(b, dtype=np.float32)
        return payloads.map(unpack)
    return decode


def permute_payload(shape=LATENT_SHAPE):
    """A UDF from time-major [t, y, x, c] bytes to channel-major [c, t, y, x] bytes."""
    @F.pandas_udf(T.BinaryType())
    def permute(payloads: pd.Series) -> pd.Series:
        def swap(b):
            z = np.frombuffer(b, dtype=np.float32).reshape(shape)
            return np.moveaxis(z, -1, 0).tobytes()
        return payloads.map(swap)
    return permute


def payload_problem(shape=LATENT_SHAPE, payload="latent_bytes", dims=None, item_bytes=FLOAT_BYTES):
    """What is wrong with a payload, null if nothing is: `missing`, `empty`, `rank`, `frames` (the first
    extent), `channels` (the last one), `shape` (another one), or `length`, if the bytes do not
    make up the shape exactly. An extent of None in `shape` may be any. `dims` names an array column with
    the shape that a row states; without it the row is taken to have `shape` itself."""
    if dims is None and None in shape:
        raise ValueError("a shape with open extents needs the rows' own")
    stated = F.col(dims) if dims else F.array(*[F.lit(n) for n in shape])
    names = ["frames", *["shape"] * (len(shape) - 2), "channels"] if len(shape) > 1 else ["frames"]
    size = F.aggregate(stated, F.lit(item_bytes).cast("long"), lambda n, extent: n * extent)
    found = F.when(F.col(payload).isNull() | stated.isNull(), "missing").when(
        F.size(stated) != len(shape), "rank").when(
        (F.octet_length(payload) == 0) | F.exists(stated, lambda n: n <= 0), "empty")
    for i in (0, len(shape) - 1, *range(1, len(shape) - 1)):  # the ends are named
        if shape[i] is not None:
            found = found.when(~F.get(stated, F.lit(i)).eqNullSafe(F.lit(shape[i])), names[i])
    return found.when(~F.octet_length(payload).cast("long").eqNullSafe(size), "length")


def check_payload(df: DataFrame, shape=LATENT_SHAPE, **options):
    """Split rows into (well formed, quarantined with the `problem`), see `payload_problem`."""
    checked = df.withColumn("problem", payload_problem(shape, **options))
    return (checked.where(F.col("problem").isNull()).drop("problem"),
            checked.where(F.col("problem").isNotNull()))


def frame_changes(buffer, shape):
    """Mean absolute change of each frame against the one before, accumulated in double."""
    z = np.frombuffer(buffer, dtype=np.float32).reshape(shape[0], -1)
    step = np.empty_like(z[0])
    changes = np.empty(shape[0] - 1)
    for t in range(1, shape[0]):
        np.subtract(z[t], z[t - 1], out=step)
        np.abs(step, out=step)
        changes[t - 1] = step.mean(dtype=np.float64)
    return changes


def excess(changes, eps) -> float:
    """The motion above `eps`, summed over a tubelet's frame changes."""
    return float(np.maximum(0.0, changes - eps).sum())


def huber_terms(pred, target, delta):
    """The robust loss of each value."""
    error = np.abs(pred - target)
    return np.where(error <= delta, 0.5 * error ** 2, delta * (error - 0.5 * delta))


def _reduce_payload(df, keep, fields, reducer):
    """Replace the payload by `reducer(buffer)`, one dict per row, keeping columns `keep`."""
    source = df.select(*keep, "latent_bytes")
    schema = T.StructType([source.schema[c] for c in keep] + fields)

    def reduce_batches(batches):
        for batch in batches:
            rows = [reducer(b.as_buffer()) for b in batch.column("latent_bytes")]
            kept = [batch.column(c) for c in keep]
            made = [pa.array([r[f.name] for r in rows],
                             pa.list_(pa.float64()) if isinstance(f.dataType, T.ArrayType)
                             else pa.float64())
                    for f in fields]
            yield pa.RecordBatch.from_arrays(kept + made, names=schema.names)

    return source.mapInArrow(reduce_batches, schema)


def frame_l1_from_payload(df: DataFrame, keep, shape=LATENT_SHAPE) -> DataFrame:
    """Columns `keep` plus `l1`, the array of per-frame changes (31 doubles per tubelet)."""
    fields = [T.StructField("l1", T.ArrayType(T.DoubleType()))]
    return _reduce_payload(df, keep, fields, lambda b: {"l1": frame_changes(b, shape)})


def psi_from_payload(df: DataFrame, eps: float, keep, shape=LATENT_SHAPE) -> DataFrame:
    """Columns `keep` plus `psi`, the motion above `eps` summed over the tubelet."""
    def psi(buffer):
        return {"psi": excess(frame_changes(buffer, shape), eps)}
    return _reduce_payload(df, keep, [T.StructField("psi", T.DoubleType())], psi)


def moments_from_payload(df: DataFrame, keep) -> DataFrame:
    """Columns `keep` plus `n`, `mean` and `m2` (sum of squared deviations) of all values."""
    fields = [T.StructField(c, T.DoubleType()) for c in ("n", "mean", "m2")]

    def moments(buffer):
        z = np.frombuffer(buffer, dtype=np.float32)
        mean, squares = _frame_moments(z)
        return {"n": float(z.size), "mean": mean, "m2": squares}
    return _reduce_payload(df, keep, fields, moments)


def _frame_moments(frame):
    """Mean and sum of squared deviations, in slices, so that no second copy is made in double."""
    mean = frame.mean(dtype=np.float64)
    slices = np.array_split(frame, max(1, frame.size // SLICE))
    return mean, float(sum(np.square(part - mean).sum() for part in slices))


def target_moments_from_payload(df: DataFrame, keep, shape=LATENT_SHAPE, pairs=SHIFT_PAIRS) -> DataFrame:
    """Columns `keep`, `direction`, and `n`, `mean` and `m2` of all target values of that direction: frames
    1 to `pairs` forward, 0 to `pairs` - 1 backward. Both share the moments of their common frames."""
    if not 0 < pairs < shape[0]:
        raise ValueError(f"{pairs} pairs need more than {shape[0]} frames")
    cells = math.prod(shape[1:])
    names = [f"{d}_{c}" for d in ("fwd", "rev") for c in ("mean", "m2")]

    def moments(buffer):
        z = np.frombuffer(buffer, dtype=np.float32).reshape(shape[0], -1)
        means, squares = np.array([_frame_moments(z[t]) for t in range(pairs + 1)]).T
        found = {}
        for direction, chosen in (("fwd", slice(1, pairs + 1)), ("rev", slice(0, pairs))):
            mean = means[chosen].mean()
            found[f"{direction}_mean"] = mean
            found[f"{direction}_m2"] = (squares[chosen].sum()
                                        + cells * np.square(means[chosen] - mean).sum())
        return found

    made = _reduce_payload(df, keep, [T.StructField(c, T.DoubleType()) for c in names], moments)
    sides = [F.struct(F.lit(d).alias("direction"), F.lit(float(cells * pairs)).alias("n"),
                      F.col(f"{d}_mean").alias("mean"), F.col(f"{d}_m2").alias("m2"))
             for d in ("fwd", "rev")]
    return made.select(*keep, F.inline(F.array(*sides)))
