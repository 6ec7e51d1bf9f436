"""Ordered frame operators: count-based windows, differences, target pairs, layout.

Frames are rows (seq_id, idx, value) with idx the position in the sequence. Once frames
belong to a window, every group below is one window, so its size is fixed by the window
length however long the sequence is.
"""

from pyspark.sql import DataFrame, Window, functions as F

from driftgate.functions.expressions import abs_diff, excess, flow_magnitude as magnitude
from driftgate.functions.expressions import vector_mean
from driftgate.settings import (
    FLOW_CLIP, PREFILTER_THRESHOLD, SHIFT_PAIRS, TARGET_FPS, TUBELET_RAW_FRAMES,
)

TUBELET = ["seq_id", "start"]


def _in_order(*keys):
    return Window.partitionBy(*keys).orderBy("t")


def tubelets(frames: DataFrame, size=TUBELET_RAW_FRAMES, stride=None) -> DataFrame:
    """Assign frames to windows [start, start + size), start a multiple of `stride`.

    Windows overlap when stride < size; a tail shorter than `size` is dropped. Adds `start`
    and `t`, the position inside the window.
    """
    stride = size if stride is None else stride
    idx = F.col("idx")
    if stride == size:
        placed = frames.withColumn("start", idx - idx % size)
    else:
        first = F.greatest(F.lit(0), F.ceil((idx - (size - 1)) / stride) * stride)
        last = F.floor(idx / stride) * stride
        placed = frames.where(first <= last).withColumn(
            "start", F.explode(F.sequence(first.cast("long"), last.cast("long"),
                                          F.lit(stride).cast("long"))))
        placed = placed.where(idx < F.col("start") + size)
    # Ordered like the windows that follow, so the rows are sorted once for all of them.
    whole = F.count("*").over(_in_order(*TUBELET).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)) == size
    return (placed.withColumn("t", idx - F.col("start"))
            .withColumn("_whole", whole).where("_whole").drop("_whole"))


def frame_diff(windows: DataFrame, value, vector=False, keys=TUBELET) -> DataFrame:
    """Absolute change of each frame against the one before in its window (t >= 1)."""
    before = F.lag(value).over(_in_order(*keys))
    return (windows.withColumn("_before", before).where(F.col("t") > 0)
            .withColumn("diff", abs_diff(value, "_before", vector)).drop("_before"))


def frame_l1(diffs: DataFrame, vector=False) -> DataFrame:
    """Mean absolute change per frame, over all components of the frame."""
    return diffs.withColumn("l1", vector_mean("diff") if vector else F.col("diff"))


def psi(l1: DataFrame, eps, keys=TUBELET, keep=()) -> DataFrame:
    """Motion above the noise floor `eps` (a number or a column), summed per window."""
    eps = eps if not isinstance(eps, (int, float)) else F.lit(float(eps))
    return l1.groupBy(*keys, *keep).agg(F.sum(excess(F.col("l1"), eps)).alias("psi"))


def shift_pairs(windows: DataFrame, value, n=SHIFT_PAIRS, keys=TUBELET) -> DataFrame:
    """Input and target of each step t < n: forward (t to t+1) and reverse (t+1 to t)."""
    after = F.lead(value).over(_in_order(*keys))
    pairs = (windows.withColumn("_after", after)
             .where((F.col("t") < n) & F.col("_after").isNotNull()))
    both = F.array(
        F.struct(F.lit("fwd").alias("direction"), F.col(value).alias("input"),
                 F.col("_after").alias("target")),
        F.struct(F.lit("rev").alias("direction"), F.col("_after").alias("input"),
                 F.col(value).alias("target")))
    rest = [c for c in windows.columns if c != value]
    return pairs.select(*rest, F.inline(both))


def channels_first(windows: DataFrame, value, keys=TUBELET) -> DataFrame:
    """Reorder a window from time-major to channel-major: one row per channel, its values
    in time order. The group is one window, so the lists have the window's length."""
    frames = windows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("v")))).alias("frames"))
    channel = F.col("channel")
    return (frames.withColumn("channel", F.explode(
                F.sequence(F.lit(0), F.size(F.col("frames")[0]["v"]) - 1)))
            .withColumn("series", F.transform("frames", lambda f: f["v"][channel]))
            .drop("frames"))


def flow_magnitude(vectors: DataFrame, u, v, cap=FLOW_CLIP, by=()) -> DataFrame:
    """Mean flow length per group, each vector's length limited to `cap`."""
    return vectors.groupBy(*by).agg(
        F.avg(magnitude(F.col(u), F.col(v), cap)).alias("m_flow"))


def prefilter_motion(diffs: DataFrame, threshold=PREFILTER_THRESHOLD, keys=TUBELET) -> DataFrame:
    """Windows whose mean absolute frame change does not exceed the threshold."""
    return (diffs.groupBy(*keys).agg(F.avg("diff").alias("score"))
            .where(F.col("score") <= threshold))


def with_duration(df: DataFrame, n_bytes, frame_bytes) -> DataFrame:
    """Whole frames in a raw byte count (the remainder is dropped) and their seconds."""
    frames = F.floor(F.col(n_bytes) / F.lit(frame_bytes)).cast("long")
    return df.withColumn("n_frames", frames).withColumn("seconds", frames / float(TARGET_FPS))


def min_length(frames: DataFrame, n=TUBELET_RAW_FRAMES, seq="seq_id") -> DataFrame:
    """Sequences with at least one full window, with their frame counts."""
    return (frames.groupBy(seq).agg(F.count("*").alias("n_frames"))
            .where(F.col("n_frames") >= n))
