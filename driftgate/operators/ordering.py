"""Row positions and first-n selections that hold when one group has most of the rows."""

import math

from pyspark.sql import DataFrame, Window, functions as F

from driftgate.session import materialize
from driftgate.settings import MAX_HOT_KEYS, MAX_TASK_ROWS, TOP_N_SALTS


def index_rows(df: DataFrame, group, order, name="idx", max_rows=MAX_TASK_ROWS,
               row_bound=None) -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by `order`.

    `order` must be total within a group. `row_bound` is any known upper bound on the row
    count; without it the rows are counted (a footer read for a plain scan).

    Groups of at most `max_rows` rows use an ordinary window. Larger groups are split into
    ordered pieces first, so no task sorts more than a piece of one.
    """
    group, order = list(group), list(order)
    total = df.count() if row_bound is None else row_bound
    if total <= max_rows:
        return _index_small(df, group, order, name)

    limit = max(max_rows, math.ceil(total / MAX_HOT_KEYS))
    if not group:
        return _index_large(df, group, order, name, math.ceil(total / limit))

    # A group above the limit holds more than 1/MAX_HOT_KEYS of the rows, so there are
    # fewer than MAX_HOT_KEYS of them: small enough to broadcast by construction.
    key = F.struct(*group)
    hot = materialize(
        df.groupBy(key.alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") > limit),
        "hot-groups")
    hot_rows = hot.agg(F.sum("_n")).first()[0]
    if hot_rows is None:
        return _index_small(df, group, order, name)
    keyed = df.withColumn("_g", key)
    hot_keys = F.broadcast(hot.select("_g"))
    cold = keyed.join(hot_keys, "_g", "left_anti").drop("_g")
    large = keyed.join(hot_keys, "_g", "left_semi").drop("_g")
    return _index_small(cold, group, order, name).unionByName(
        _index_large(large, group, order, name, math.ceil(hot_rows / limit)))


def _index_small(df, group, order, name):
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, rank.cast("long") - 1)


def _index_large(df, group, order, name, pieces):
    """Positions from ordered pieces: rows before the piece plus the position inside it."""
    ranged = df.repartitionByRange(max(2, 2 * pieces), *group, *order)
    # The piece number is only stable once written, so write it before using it twice.
    split = materialize(ranged.withColumn("_piece", F.spark_partition_id()), "ordered-pieces")
    split = split.withColumn("_k", F.struct(*group, "_piece"))
    counts = split.groupBy("_k").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy(*[F.col(f"_k.{g}") for g in group]).orderBy("_k._piece")
        .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_k", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_k").orderBy(*order)) - 1
    return (split.withColumn("_inside", inside).join(offsets, "_k")
            .withColumn(name, F.col("_before") + F.col("_inside"))
            .drop("_k", "_piece", "_before", "_inside"))


def first_n(df: DataFrame, group, order, n, name="pos", salts=TOP_N_SALTS) -> DataFrame:
    """Keep the first `n` rows of each group and add their 0-based position.

    A row among a group's first n is among the first n of any part of it, so each group is
    cut to n rows per salt before its rows meet. The salt follows the input partition: for
    small n, Spark then cuts each group to n rows inside every scan task already. `n` is an
    int or a column.
    """
    limit = n if not isinstance(n, int) else F.lit(n)
    salt = F.spark_partition_id() % salts
    per_salt = F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return (df.withColumn("_salt", salt)
            .withColumn("_rank", per_salt).where(F.col("_rank") <= limit).drop("_salt", "_rank")
            .withColumn(name, position.cast("long") - 1).where(F.col(name) < limit))
