"""Exact linear-interpolated percentiles without gathering the values in one task."""

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from driftgate.session import materialize
from driftgate.settings import MAX_PERCENTILE_ROWS

#: Buckets of the first level, and parts that the values of one bucket are dealt into.
MIN_BUCKETS, MAX_BUCKETS = 64, 4096
SLICES = 16


def exact_percentiles(df: DataFrame, value, probs: dict, row_bound=None,
                      max_rows=MAX_PERCENTILE_ROWS, more=()) -> DataFrame:
    """One row with one column per entry of `probs` (column name to fraction), and the
    further aggregates `more`.

    Nulls are ignored. NaN counts as the largest value; check for it first where that
    matters. The built-in `percentile` keeps every distinct value in one buffer, so it only
    serves inputs of a known size.
    """
    total = df.count() if row_bound is None else row_bound
    if total <= max_rows:
        return df.agg(*[F.percentile(F.col(value), F.lit(p)).alias(name)
                        for name, p in probs.items()], *more)
    values = df.select(F.lit(0).cast("long").alias("block"), F.col(value).alias("value"))
    wide = prefix_percentiles(values, probs)
    # A scalar subquery is null without values, so there is one row for any input, and two one-row
    # results meet without a join.
    points = wide.select(F.struct(*probs)).scalar()
    one = df.agg(*more) if more else df.sparkSession.range(1).select()
    return one.withColumn("_p", points).select("_p.*", *[c for c in one.columns])


def prefix_percentiles(df: DataFrame, probs: dict, pieces=None) -> DataFrame:
    """Percentiles of all values seen up to and including each block.

    Input columns: `block` (long) and `value`. Output: `block`, `n` (values so far), and one
    column per entry of `probs`. Exact, in two levels:

    1. values fall into buckets between approximate quantiles; the running count of each
       bucket tells, for every block, which bucket holds the wanted order statistic;
    2. only that bucket's distinct values, with counts per block, are looked at.

    With B buckets, K blocks and P probabilities this handles K*B counts and about 2*P*K*N/B values,
    least at B = sqrt(2*P*N), which is the default. Bucket borders need not be accurate: they change the
    work, not the result. Most blocks want the same few buckets, so a bucket's values are dealt out in
    slices, and every wanted statistic goes to all slices of its bucket.
    """
    cells = (df.where(F.col("value").isNotNull())
             .groupBy("block", F.col("value").cast("double").alias("value"))
             .agg(F.count("*").alias("n")))
    # Read five times below, so written once: value, block and count only.
    cells = materialize(cells, "percentile-cells")
    pieces = pieces or math.isqrt(2 * len(probs) * cells.count())
    cells = _with_bucket(cells, _cuts(cells, pieces))

    # Totals per block and the order statistics wanted there.
    so_far = F.sum("n").over(
        Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    totals = (cells.groupBy("block").agg(F.sum("n").alias("n"))
              .select("block", so_far.alias("total")))
    ranks = F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("total") - 1)).alias("at"))
        for name, p in probs.items()])
    wanted = totals.select("block", "total", F.explode(ranks).alias("w")).select(
        "block", "total", "w.name", "w.at",
        F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at")))).alias("rank"))

    # Level 1: running count of each bucket, repeated for every block it stays valid.
    blocks = totals.agg(F.max("block").alias("last"))
    by_block = Window.partitionBy("bucket").orderBy("block")
    running = (cells.groupBy("bucket", "block").agg(F.sum("n").alias("n"))
               .withColumn("count", F.sum("n").over(
                   by_block.rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("until", F.coalesce(F.lead("block").over(by_block) - 1,
                                               blocks.scalar()))
               .select("bucket", "count",
                       F.explode(F.sequence("block", "until")).alias("block")))
    through = F.sum("count").over(
        Window.partitionBy("block").orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, 0))
    borders = running.withColumn("through", through).withColumn(
        "below", F.col("through") - F.col("count"))
    target = (wanted.join(borders, "block")
              .where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("through")))
              .select("block", "total", "name", "at", "rank", "bucket",
                      (F.col("rank") - F.col("below")).alias("local")))

    # A bucket of one value is that value, however many blocks have it.
    spans = cells.groupBy("bucket").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    target = target.join(spans, "bucket")
    known = target.where("low = high").select("block", "total", "name", "at", "rank",
                                              F.col("low").alias("value"))

    # Level 2: the wanted value among the bucket's values of earlier or equal blocks.
    sliced = cells.select("bucket", F.pmod(F.hash("value"), F.lit(SLICES)).alias("slice"),
                          F.col("block").alias("from_block"), "value", "n")
    target = target.where("low != high").drop("low", "high").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    seen = (target.join(sliced, ["bucket", "slice"])
        .where(F.col("from_block") <= F.col("block"))
        .groupBy("block", "total", "name", "at", "rank", "local", "value")
        .agg(F.sum("n").alias("n")))
    upto = F.sum("n").over(
        Window.partitionBy("block", "name", "rank").orderBy("value")
        .rowsBetween(Window.unboundedPreceding, 0))
    picked = (seen.withColumn("upto", upto).where(F.col("upto") > F.col("local"))
              .groupBy("block", "total", "name", "at", "rank")
              .agg(F.min("value").alias("value"))).unionByName(known)

    weight = F.col("at") - F.floor("at")
    points = picked.groupBy("block", F.col("total").alias("n"), "name").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.max(weight).alias("w"))
    points = points.withColumn(
        "point", F.when(F.col("low") == F.col("high"), F.col("low"))
        .otherwise((1 - F.col("w")) * F.col("low") + F.col("w") * F.col("high")))
    return points.groupBy("block", "n").agg(
        *[F.max(F.when(F.col("name") == name, F.col("point"))).alias(name) for name in probs])


def _cuts(df, pieces):
    """Approximate quantiles of the values: at most a few thousand numbers on the driver."""
    n = min(max(pieces, MIN_BUCKETS), MAX_BUCKETS)
    # NaN would be taken for a border, and only finite borders are needed.
    finite = df.where(~F.isnan("value"))
    found = finite.approxQuantile("value", [i / n for i in range(1, n)], 0.5 / n)
    # A value that comes up several times is that of many blocks, and gets a bucket of its own.
    alone = {math.nextafter(q, math.inf) for q, after in zip(found, found[1:]) if q == after < math.inf}
    return sorted(set(found) | alone)


def _with_bucket(cells, cuts):
    splits = [-math.inf, *(cuts or [0.0]), math.inf]
    bucketed = Bucketizer(splits=splits, inputCol="value", outputCol="bucket",
                          handleInvalid="keep").transform(cells)
    return bucketed.withColumn("bucket", F.col("bucket").cast("int"))
