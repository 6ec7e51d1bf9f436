"""Batch scoring with given predictor weights.

A predictor is a depthwise stencil over time and space, an activation, a channel mix, and a
gate that blends the result with its input. Two forms:

- columns of frames: windows in the JVM, each stage a kernel over Arrow batches that works on shifted
  slices of the grid, so it holds the weights and a bounded slice of a batch;
- a numpy reduction for full payloads, which leaves only losses per tubelet.

Frames are arrays in row-major [y, x, channel] order.
"""

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from driftgate.functions.expressions import silu
from driftgate.functions.payload import huber_terms
from driftgate.operators.frames import TUBELET
from driftgate.settings import LATENT_SHAPE, SHIFT_PAIRS

TIME_TAPS = 3


@dataclass
class Weights:
    """Predictor weights: depthwise [c, 3, 3, 3] (time, y, x), mix [c', c], gate [2c]."""

    depthwise: np.ndarray
    depthwise_bias: np.ndarray
    mix: np.ndarray
    mix_bias: np.ndarray
    gate: np.ndarray
    gate_bias: float


# --- column form -------------------------------------------------------------

#: Values of each input that a kernel works on at once.
KERNEL_VALUES = 1 << 21


def grid_kernel(fn, grid, channels, inputs=1):
    """An Arrow UDF that applies `fn` to `inputs` array columns as tensors [row, y, x, channel] and gives
    an array column. Rows with a null input are null; another number of values raises."""
    cells = grid[0] * grid[1] * channels
    step = max(1, KERNEL_VALUES // cells)

    def tensor(column, present):
        column = column.filter(present)
        if len(column) and pc.any(pc.not_equal(pc.list_value_length(column), cells)).as_py():
            raise ValueError(f"frames must have {cells} values for a grid of {grid}")
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, *grid, channels)

    def run(columns):
        present = reduce(pc.and_, [c.is_valid() for c in columns])
        tensors = [tensor(c, present) for c in columns]
        parts = [fn(*[t[i:i + step].astype(np.float64, copy=False) for t in tensors]).reshape(-1)
                 for i in range(0, len(tensors[0]), step)]
        values = np.concatenate(parts) if parts else np.zeros(0)
        offsets = np.zeros(len(columns[0]) + 1, np.int32)
        np.cumsum(present.to_numpy(zero_copy_only=False) * cells, out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values),
                                        mask=pc.invert(present))

    kind = T.ArrayType(T.DoubleType())
    if inputs == 1:
        @F.arrow_udf(kind)
        def apply(a: pa.Array) -> pa.Array:
            return run([a])
    else:
        @F.arrow_udf(kind)
        def apply(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return run([a, b, c])
    return apply


def shifted_sum(frames, weights):
    """Sum over the nine neighbours of each cell: frames [row, y, x, c], weights [3, 3] or [3, 3, c];
    outside the border is zero."""
    height, width = frames.shape[1:3]
    padded = np.pad(frames, ((0, 0), (1, 1), (1, 1), (0, 0)))
    out = np.zeros(frames.shape)
    for dy, dx in np.ndindex(3, 3):
        out += padded[:, dy:dy + height, dx:dx + width] * weights[dy][dx]
    return out


def stencil(frames: DataFrame, value, kernel, bias, grid, causal=True, keys=TUBELET,
            out="conv") -> DataFrame:
    """Depthwise stencil. Causal looks at t-2..t, anti-causal at t..t+2; frames outside the
    window are zero."""
    kernel, bias = np.asarray(kernel, dtype=float), np.asarray(bias, dtype=float)
    channels = len(kernel)
    order = Window.partitionBy(*keys).orderBy("t")
    shift = F.lag if causal else F.lead
    offsets = (2, 1, 0) if causal else (0, 1, 2)
    z = F.col(value).cast("array<double>")
    zero = F.array_repeat(F.lit(0.0), grid[0] * grid[1] * channels)
    taps = [F.when(shift(F.lit(1), n).over(order).isNull(), zero).otherwise(shift(z, n).over(order))
            if n else z for n in offsets]
    convolve = grid_kernel(
        lambda *taps: sum(shifted_sum(z, np.moveaxis(kernel[:, k], 0, -1))
                          for k, z in enumerate(taps)) + bias,
        grid, channels, TIME_TAPS)
    return frames.withColumns({f"_z{k}": tap for k, tap in enumerate(taps)}).withColumn(
        out, convolve(*[F.col(f"_z{k}") for k in range(TIME_TAPS)])).drop(
        *[f"_z{k}" for k in range(TIME_TAPS)])


def channel_mix(frames: DataFrame, value, matrix, bias, grid, out="mixed") -> DataFrame:
    """Linear mix of the channels at every position."""
    matrix, bias = np.asarray(matrix, dtype=float), np.asarray(bias, dtype=float)
    mix = grid_kernel(lambda z: z @ matrix.T + bias, grid, matrix.shape[1])
    return frames.withColumn(out, mix(F.col(value)))


def activate(frames: DataFrame, value, out="activated") -> DataFrame:
    return frames.withColumn(out, F.transform(value, silu))


def gated_blend(frames: DataFrame, value, activated, mixed, gate, bias, grid,
                out="pred") -> DataFrame:
    """(1 - u) * input + u * mixed, with one gate value u per position: a linear form of input and
    activation there."""
    gate = np.asarray(gate, dtype=float)
    channels = len(gate) // 2

    def blend(z, act, mix):
        linear = z @ gate[:channels] + act @ gate[channels:] + bias
        with np.errstate(over="ignore"):
            u = (1 / (1 + np.exp(-linear)))[..., None]
        return (1 - u) * z + u * mix

    return frames.withColumn(out, grid_kernel(blend, grid, channels, 3)(
        F.col(value).cast("array<double>"), F.col(activated), F.col(mixed)))


def predict(frames: DataFrame, value, weights: Weights, grid, causal=True,
            keys=TUBELET) -> DataFrame:
    """Prediction for every frame of a window, in the column form."""
    convolved = stencil(frames, value, weights.depthwise, weights.depthwise_bias, grid,
                        causal, keys)
    mixed = channel_mix(activate(convolved, "conv"), "activated", weights.mix,
                        weights.mix_bias, grid)
    return gated_blend(mixed, value, "activated", "mixed", weights.gate, weights.gate_bias,
                       grid).drop("conv", "activated", "mixed")


def neighbor_sum(frames: DataFrame, value, kernel, grid, channels=1, out="total") -> DataFrame:
    """Weighted sum over each cell's 3x3 neighbourhood, for frames as arrays in [y, x, channel]
    order. A frame has all its neighbours in its own row, so nothing is exchanged or joined."""
    weights = np.asarray(kernel, dtype=float)
    add = grid_kernel(lambda z: shifted_sum(z, weights), grid, channels)
    return frames.withColumn(out, add(F.col(value)))


# --- payload form ------------------------------------------------------------

def predict_array(z, weights: Weights, causal=True):
    """Prediction for one tensor [t, y, x, c]."""
    before, after = (TIME_TAPS - 1, 0) if causal else (0, TIME_TAPS - 1)
    padded = np.pad(z, ((before, after), (1, 1), (1, 1), (0, 0)))
    steps, height, width, _ = z.shape
    conv = np.broadcast_to(weights.depthwise_bias, z.shape).astype(z.dtype)
    for k, dy, dx in np.ndindex(TIME_TAPS, 3, 3):
        conv += (padded[k:k + steps, dy:dy + height, dx:dx + width]
                 * weights.depthwise[:, k, dy, dx])
    activated = conv / (1 + np.exp(-conv))
    mixed = activated @ weights.mix.T + weights.mix_bias
    linear = np.concatenate([z, activated], axis=-1) @ weights.gate + weights.gate_bias
    u = (1 / (1 + np.exp(-linear)))[..., None]
    return (1 - u) * z + u * mixed


def _huber_mean(pred, target, delta):
    return float(huber_terms(pred, target, delta).sum(axis=-1, dtype=np.float64).mean())


def score(latents: DataFrame, keep, delta: float, forward: Weights = None,
          backward: Weights = None, shape=LATENT_SHAPE, pairs=SHIFT_PAIRS,
          dtype=np.float32) -> DataFrame:
    """Loss of each tubelet in both directions: columns `keep`, `direction`, `loss`.

    Without weights the prediction is the input itself (persistence). Weights are a fixed
    size, set by the channel count, and travel in the task closure's broadcast.
    """
    source = latents.select(*keep, "latent_bytes")
    weights = latents.sparkSession.sparkContext.broadcast((forward, backward))
    schema = T.StructType([*[source.schema[c] for c in keep],
                           T.StructField("direction", T.StringType()),
                           T.StructField("loss", T.DoubleType())])

    def losses(buffer):
        z = np.frombuffer(buffer, dtype=np.float32).reshape(shape).astype(dtype, copy=False)
        early, late = z[:pairs], z[1:pairs + 1]
        p, q = weights.value
        return [_huber_mean(predict_array(early, p) if p else early, late, delta),
                _huber_mean(predict_array(late, q, causal=False) if q else late, early, delta)]

    def score_batches(batches):
        for batch in batches:
            made = [x for b in batch.column("latent_bytes") for x in losses(b.as_buffer())]
            twice = pa.array(np.repeat(np.arange(batch.num_rows), 2))
            kept = [batch.column(c).take(twice) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(["fwd", "rev"] * batch.num_rows),
                 pa.array(made, pa.float64())], names=schema.names)

    return source.mapInArrow(score_batches, schema)
