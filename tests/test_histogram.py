"""The counted histogram against numpy, and what a percentile reads."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.operators.histogram import CountedHistogram


class Reader:
    """Reads ranges of the values seen so far and counts the rows read."""

    def __init__(self, spark):
        self.spark, self.values, self.rows = spark, [], 0

    def frame(self, values):
        return self.spark.createDataFrame([(float(v),) for v in values], "v double").coalesce(2)

    def __call__(self, low, high):
        inside = [v for v in self.values if v >= low and (high is None or v < high)]
        self.rows += len(inside)
        return self.frame(inside).select(F.col("v").alias("value"))


def percentile(values, p):
    """Linear-interpolated, with NaN as the largest value."""
    at, ordered = p * (len(values) - 1), sorted(values, key=lambda v: (math.isnan(v), v))
    low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
    weight = at - math.floor(at)
    return low if low == high else (1 - weight) * low + weight * high


def batches(kind, rng):
    if kind == "smooth":
        return [rng.exponential(size=150) for _ in range(5)]
    if kind == "ties":
        return [rng.choice([0.0, 0.0, 0.0, 1.5, 2.0], size=150) for _ in range(4)]
    if kind == "one value":
        return [np.full(150, 3.0) for _ in range(3)]
    if kind == "drifting":
        return [rng.normal(loc=5 * i, size=120) for i in range(5)]
    return [np.array([np.nan, np.inf, -np.inf, -1.0, 0.0] * 20), np.full(40, np.nan)]


@pytest.mark.parametrize("kind", ["smooth", "ties", "one value", "drifting", "odd"])
def test_percentiles_of_growing_values(spark, kind):
    rng, reader, stored = np.random.default_rng(2), Reader(spark), None
    for batch in batches(kind, rng):
        histogram = CountedHistogram(limit=20) if stored is None else CountedHistogram.load(
            stored, limit=20)
        histogram.add(reader.frame(batch), "v")
        reader.values += batch.tolist()
        assert histogram.total == len(reader.values)
        got, want = histogram.percentile(0.2, reader), percentile(reader.values, 0.2)
        assert got == pytest.approx(want, nan_ok=True)
        stored = histogram.state(spark)


def test_a_check_does_not_read_what_was_counted_before(spark):
    rng, reader, histogram = np.random.default_rng(3), Reader(spark), CountedHistogram(limit=200)
    read = []
    for _ in range(12):
        batch = rng.exponential(size=1000)
        histogram.add(reader.frame(batch), "v")
        reader.values += batch.tolist()
        reader.rows = 0
        assert histogram.percentile(0.2, reader) == pytest.approx(np.percentile(reader.values, 20))
        read.append(reader.rows)
    # The first cuts read all there is; then buckets of at most 200, or a bucket that has just passed it.
    assert max(read[3:]) <= 1200 and sum(n <= 400 for n in read[3:]) >= 6


def test_no_values(spark):
    histogram = CountedHistogram()
    histogram.add(spark.createDataFrame([(None,)], "v double"), "v")
    assert histogram.percentile(0.5, None) is None
    assert CountedHistogram.load(histogram.state(spark)).total == 0
    assert CountedHistogram.load(histogram.state(spark).limit(0)).total == 0
