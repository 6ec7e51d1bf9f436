"""Exact percentiles of a growing set of values from a counted histogram that is refined on demand.

The histogram is a sorted list of bucket starts with counts. New values are counted into it, which
reads the new values only; two histograms of the same starts are merged by adding up. A percentile asks for one
or two order statistics: the running count names their bucket, and only its values are read. A bucket
of more than `limit` values is first cut into parts, once, and stays cut: later values are counted into the
parts. So a percentile reads at most some `limit` values, however many have been counted.
"""

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

#: Values of a bucket that a percentile may read; larger buckets are cut into this many parts.
BUCKET_LIMIT = 65_536
PARTS = 64

STATE = "low double, n long"


class CountedHistogram:
    """Counts of the values in [lows[i], lows[i + 1]); the last count is of NaN, the largest value."""

    def __init__(self, lows=(-math.inf,), counts=(0, 0), limit=BUCKET_LIMIT):
        self.lows, self.counts, self.limit = list(lows), list(counts), limit

    @classmethod
    def load(cls, state: DataFrame, limit=BUCKET_LIMIT):
        rows = sorted(((r["low"], r["n"]) for r in state.collect()),
                      key=lambda r: (math.isnan(r[0]), r[0]))
        if not rows:
            return cls(limit=limit)
        return cls([low for low, _ in rows[:-1]], [n for _, n in rows], limit)

    def state(self, spark) -> DataFrame:
        """The histogram as rows: one per bucket, and one for NaN."""
        return spark.createDataFrame(list(zip([*self.lows, math.nan], self.counts)), STATE)

    @property
    def total(self):
        return sum(self.counts)

    def add(self, values: DataFrame, value: str) -> None:
        """Count the values of a column; nulls are left out."""
        for bucket, n in self._counted(values, value, self.lows):
            self.counts[bucket] += n

    def _counted(self, values, value, lows):
        """Rows (bucket, count); values beyond the last start are in its bucket, NaN in the one after."""
        column = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
        if len(lows) == 1:  # a Bucketizer needs two buckets
            bucket = F.when(F.isnan("v"), 1).otherwise(0)
            rows = column.select(bucket.alias("b"))
        else:
            rows = Bucketizer(splits=[*lows, math.inf], inputCol="v", outputCol="b",
                              handleInvalid="keep").transform(column)
        return [(int(b), n) for b, n in rows.groupBy("b").count().collect()]

    def percentile(self, fraction, read):
        """The linear-interpolated percentile, NaN counted as largest; None without values. `read(low,
        high)` gives the counted values in [low, high) as a DataFrame with the column `value`."""
        if not self.total:
            return None
        at = fraction * (self.total - 1)
        low = self._value(math.floor(at), read)
        high = low if at == math.floor(at) else self._value(math.ceil(at), read)
        weight = at - math.floor(at)
        return low if low == high else (1 - weight) * low + weight * high

    def _value(self, rank, read):
        while True:
            bucket, below = 0, 0
            while below + self.counts[bucket] <= rank:
                below += self.counts[bucket]
                bucket += 1
            if bucket == len(self.lows):
                return math.nan
            low = self.lows[bucket]
            high = self.lows[bucket + 1] if bucket + 1 < len(self.lows) else None
            if high is not None and high == math.nextafter(low, math.inf):
                return low  # a bucket of one value, however often it was counted
            if self.counts[bucket] <= self.limit:
                return self._nth(read(low, high), rank - below)
            self._cut(bucket, read(low, high))

    def _nth(self, values, n):
        """The n-th of at most `limit` values."""
        upto = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        counted = values.groupBy("value").count().select("value", F.sum("count").over(upto).alias("u"))
        return counted.where(F.col("u") > n).agg(F.min("value")).first()[0]

    def _cut(self, bucket, values):
        """Put starts at approximate quantiles of the bucket's values. One that comes up several times
        is much of the bucket, and gets a bucket of its own."""
        found = values.approxQuantile("value", [i / PARTS for i in range(1, PARTS)], 0.5 / PARTS)
        new = {q for q in found if q > self.lows[bucket]}
        new |= {math.nextafter(q, math.inf) for q, after in zip(found, found[1:]) if q == after}
        starts = [self.lows[bucket], *sorted(x for x in new if x < math.inf and (
            bucket + 1 == len(self.lows) or x < self.lows[bucket + 1]))]
        counts = dict(self._counted(values, "value", starts))
        self.lows[bucket:bucket + 1] = starts
        self.counts[bucket:bucket + 1] = [counts.get(i, 0) for i in range(len(starts))]
