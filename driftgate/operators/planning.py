"""Extraction planning: video selection, resume, quotas, and shard assignment by size."""

from bisect import bisect_left
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from driftgate.functions.expressions import latent_id, shuffle_key
from driftgate.operators.ordering import first_n, index_rows
from driftgate.schema import LATENT_KEYS
from driftgate.session import materialize
from driftgate.settings import (
    MAX_VIDEOS_PER_FACTORY, SEED, SHARD_BYTES, TARGET_TUBELETS,
)


def for_factories(df: DataFrame, ids, factory="factory_id") -> DataFrame:
    """Rows of the requested factories: a list of ids, or a DataFrame with a factory column."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(factory).distinct(), factory, "left_semi")
    return df.where(F.col(factory).isin(list(ids)))


def shuffle_videos(videos: DataFrame, key, seed=SEED, factory="factory_id") -> DataFrame:
    """Add `pos`, the position of each video in its factory's seeded shuffle."""
    ordered = videos.withColumn("_hash", shuffle_key(key, seed))
    return index_rows(ordered, [factory], ["_hash", key], "pos").drop("_hash")


def select_videos(videos: DataFrame, key, valid, max_n=MAX_VIDEOS_PER_FACTORY, seed=SEED,
                  factory="factory_id") -> DataFrame:
    """The first `max_n` valid videos of each factory in shuffled order. `video_index`
    counts accepted videos only, so invalid ones go before the numbering."""
    accepted = videos.where(valid).withColumn("_hash", shuffle_key(key, seed))
    return first_n(accepted, [factory], ["_hash", key], max_n, "video_index").drop("_hash")


def select_from_archives(archives: DataFrame, members, valid, most, max_n=MAX_VIDEOS_PER_FACTORY,
                         seed=SEED, path="path", at="at", factory="factory_id"):
    """The first `max_n` valid videos of each factory, its archives in seeded order and an archive's
    videos in the order of `at`, with their `video_index`; and the archives that were opened.

    `members` gives the videos of a DataFrame of archives (with their columns), which is the costly part:
    no archive beyond a factory's last video is opened. As an archive holds at most `most`
    videos, a factory that lacks r needs at least r / most further archives. Those are opened, what they
    held is counted, and so on; the videos lacking shrink by a factor each time.
    """
    ordered = materialize(index_rows(archives.withColumn("_hash", shuffle_key(path, seed)), [factory],
                                     ["_hash", path], "_place").drop("_hash"), "archive-order")
    found, opened = [], []
    lacking = ordered.groupBy(factory).agg(F.count("*").alias("_archives")).withColumns(
        {"_lacking": F.lit(max_n).cast("long"), "_next": F.lit(0).cast("long")})
    while True:
        # One row per factory.
        lacking = materialize(lacking.withColumn("_upto", F.least(
            F.col("_archives"), F.col("_next") + F.ceil(F.col("_lacking") / most))).where(
            (F.col("_lacking") > 0) & (F.col("_next") < F.col("_archives"))), "lacking")
        if lacking.isEmpty():
            break
        now = ordered.join(lacking.select(factory, "_next", "_upto"), factory).where(
            (F.col("_place") >= F.col("_next")) & (F.col("_place") < F.col("_upto"))).drop(
            "_next", "_upto")
        videos = materialize(members(now).where(valid), "archive-videos")
        found.append(videos)
        opened.append(now)
        counts = videos.groupBy(factory).agg(F.count("*").alias("_got"))
        lacking = lacking.join(counts, factory, "left").select(
            factory, "_archives", (F.col("_lacking") - F.coalesce("_got", F.lit(0))).alias("_lacking"),
            F.col("_upto").alias("_next"))
    if not found:
        empty = members(ordered.limit(0)).where(valid)
        return empty.withColumn("video_index", F.lit(0).cast("long")).drop("_place"), archives.limit(0)
    # Each factory has fewer than `max_n` + `most` rows.
    chosen = first_n(gather(found), [factory], ["_place", at], max_n, "video_index")
    return chosen.drop("_place"), gather(opened).drop("_place")


def dedup(df: DataFrame, order, keys=LATENT_KEYS) -> DataFrame:
    """One row per identity, the least in `order`. A minimum combines before the shuffle,
    so many copies of one identity do not meet in one task."""
    rest = [c for c in df.columns if c not in keys]
    first = [*order, *[c for c in rest if c not in order]]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*first)).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def todo(candidates: DataFrame, index: DataFrame, keys=LATENT_KEYS) -> DataFrame:
    """Candidates whose identity is not stored yet. Identities are compared as structs, so
    null parts match null parts."""
    stored = index.select(latent_id(*keys).alias("_id"))
    return candidates.withColumn("_id", latent_id(*keys)).join(
        stored, "_id", "left_anti").drop("_id")


def take_quota(df: DataFrame, quota, order, group=()) -> DataFrame:
    """The first rows in `order`, which must be total: `quota` of them, or of each `group` its own
    quota, from a DataFrame of the group's columns and `quota` (no quota, no rows).

    The rows' ranges are counted first: ranges that end before the quota does stay whole, and only the
    one range of a group in which it ends is ranked. So no task holds more than a range, whatever the
    quota, the number of groups or the size of one.
    """
    group = list(group)
    key = F.struct(F.lit(0).alias("_all"), *group)  # null parts match null parts
    quotas = quota if group else df.sparkSession.range(1).select(F.lit(int(quota)).alias("quota"))
    # A range's number is only stable once written.
    ranged = materialize(df.repartitionByRange(*group, *order).select(
        "*", F.spark_partition_id().alias("_range"), key.alias("_k")), "quota-ranges")
    counted = ranged.groupBy("_k", "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_k").orderBy("_range")) - F.col("_n")
    ranges = counted.withColumn("_before", before).join(
        quotas.select(key.alias("_k"), "quota"), "_k").where(F.col("_before") < F.col("quota"))
    ranges = ranges.select("_k", "_range", (F.col("quota") - F.col("_before")).alias("_left"),
                           (F.col("_before") + F.col("_n") <= F.col("quota")).alias("_whole"))
    kept = ranged.join(ranges, ["_k", "_range"])
    rank = F.row_number().over(Window.partitionBy("_k", "_range").orderBy(*order))
    cut = kept.where(~F.col("_whole")).withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left"))
    return kept.where("_whole").select(*df.columns).unionByName(cut.select(*df.columns))


def progress(index: DataFrame, target=TARGET_TUBELETS, keys=LATENT_KEYS) -> DataFrame:
    """Distinct identities stored against the target."""
    done = index.agg(F.count_distinct(latent_id(*keys)).alias("done"))
    return done.select("done", F.lit(target).cast("long").alias("target"),
                       F.greatest(F.lit(0), target - F.col("done")).alias("remaining"),
                       (F.col("done") >= target).alias("reached"))


def shard_quotas(spark: SparkSession, done, target, n_shards) -> DataFrame:
    """New rows each extraction shard must deliver; no rows once the target is reached.
    `done` is a one-value DataFrame."""
    remaining = F.lit(target) - done.scalar()
    return (spark.range(n_shards).withColumnRenamed("id", "shard")
            .withColumn("_left", remaining).where(F.col("_left") > 0)
            .select("shard", (F.expr(f"_left div {n_shards}")
                              + F.when(F.col("shard") < F.col("_left") % n_shards, 1)
                              .otherwise(0)).alias("quota")))


def shard_factories(factories: DataFrame, n_shards, factory="factory_id") -> DataFrame:
    """Contiguous chunks of the ordered factory list. The last shard also takes what is
    left over, which is everything when there are more shards than factories."""
    listed = index_rows(factories, [], [factory], "pos")
    size = F.floor(factories.agg(F.count("*")).scalar() / n_shards)
    last = F.lit(n_shards - 1).cast("long")
    chunk = F.when(F.col("_size") == 0, last).otherwise(
        F.least(F.floor(F.col("pos") / F.greatest(F.col("_size"), F.lit(1))), last))
    return listed.withColumn("_size", size).select(factory, chunk.alias("shard"))


def gather(parts) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge_index(old: DataFrame, new: DataFrame, keys=LATENT_KEYS) -> DataFrame:
    return old.select(*keys).union(new.select(*keys)).distinct()


# --- shard assignment --------------------------------------------------------

def assign_shards(df: DataFrame, writer, order, size, max_bytes=SHARD_BYTES,
                  block_rows=65_536, fan=256) -> DataFrame:
    """Add `shard`: each writer's rows fill a shard until the row that brings it to
    `max_bytes` or more; the next row opens a new one.

    Closing a shard resets the sum, so this is no running total. It is still parallel: each
    block of a writer's rows is summarised as what happens for every row that could close
    the shard it inherits (`_block_outcomes`). Summaries of neighbours compose to one of the same
    kind, so a tree of them, `fan` to a node, tells what every block inherits, and each block then
    numbers its own rows. Choose `block_rows` well above the rows of one shard.

    Only keys and sizes take part; attach payloads by address afterwards.
    """
    total = df.count()
    rows = index_rows(df, writer, order, "_row", row_bound=total).withColumn(
        "_block", F.floor(F.col("_row") / block_rows).cast("long"))
    sizes = rows.select(*writer, "_block", "_row", F.col(size).cast("long").alias("_size"))
    keyed = [df.schema[c] for c in writer] + [T.StructField("_block", T.LongType())]

    def with_longs(*names):
        return T.StructType(keyed + [T.StructField(n, T.LongType()) for n in names])

    outcomes = sizes.groupBy(*writer, "_block").applyInPandas(
        lambda pdf: _block_outcomes(pdf, writer, max_bytes), with_longs("need", "closed", "carry"))
    # No writer has more blocks than this.
    entries = _inherited(outcomes, writer, max_bytes, fan, -(-total // block_rows), with_longs)

    # Same key as the grouping that follows, compared as a struct so null writers match.
    key = F.struct(*writer, "_block")
    entries = entries.select(key.alias("_k"), "_carry", "_first")
    numbered = rows.withColumn("_size", F.col(size).cast("long")).withColumn("_k", key).join(
        entries, "_k").drop("_k")
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.LongType())])
    names = schema.names
    return numbered.groupBy(*writer, "_block").applyInPandas(
        lambda pdf: _number_block(pdf, max_bytes)[names], schema)


def _closing_rows(upto, limit, carry):
    """Rows that close a shard, given running sizes and the bytes already in the open one."""
    rows, base = [], -carry
    while True:
        row = int(np.searchsorted(upto, base + limit))
        if row >= len(upto):
            return rows, int(upto[-1] - base)
        rows.append(row)
        base = upto[row]


def _block_outcomes(pdf, writer, limit):
    """One row per possible first closing row: it closes the inherited shard when that one
    lacks at most `need` bytes, and leaves `closed` shards and `carry` bytes. The row with
    closed = 0 stands for a block that closes nothing; its carry adds to the inherited."""
    pdf = pdf.sort_values("_row")
    upto = pdf["_size"].to_numpy().cumsum()
    # An empty shard closes here at the latest, so no later row can be the first to close.
    latest = min(int(np.searchsorted(upto, limit)), len(upto) - 1)
    made = []
    for row in range(latest + 1):
        if row and upto[row] == upto[row - 1]:
            continue
        tail = upto[row + 1:] - upto[row]
        closings, carry = _closing_rows(tail, limit, 0) if len(tail) else ([], 0)
        made.append((int(upto[row]), 1 + len(closings), carry))
    made.append((None, 0, int(upto[-1])))
    out = pd.DataFrame(made, columns=["need", "closed", "carry"]).astype("Int64")
    return _with_keys(out, pdf, [*writer, "_block"])


def _inherited(outcomes, writer, limit, fan, blocks, with_longs):
    """Bytes in the open shard and its number at the start of each block. Nodes of `fan` blocks are
    composed, what the nodes inherit is found in the same way, and handed down inside each node. No
    task holds more than the outcomes of a node."""
    deep = blocks > fan
    outcomes = materialize(outcomes, "block-outcomes") if deep else outcomes
    above = outcomes.withColumn("_node", F.floor(F.col("_block") / fan).cast("long"))
    if not deep:
        start = above.withColumns({"_carry": F.lit(0).cast("long"), "_first": F.lit(0).cast("long")})
    else:
        composed = above.groupBy(*writer, "_node").applyInPandas(
            lambda pdf: _compose_blocks(pdf, writer, limit), with_longs("need", "closed", "carry"))
        nodes = _inherited(composed, writer, limit, fan, -(-blocks // fan), with_longs)
        node = F.struct(*writer, F.col("_block").alias("_node"))
        start = above.withColumn("_k", F.struct(*writer, "_node")).join(
            nodes.select(node.alias("_k"), "_carry", "_first"), "_k").drop("_k")
    return start.groupBy(*writer, "_node").applyInPandas(
        lambda pdf: _hand_down(pdf, writer, limit), with_longs("_carry", "_first"))


def _blocks_in_order(pdf):
    """(block, its outcome): the needs that close, what each leaves, and the bytes if none does."""
    for block, rows in pdf.groupby("_block", sort=True):
        closing = rows[rows["need"].notna()].sort_values("need")
        yield int(block), (closing["need"].astype("int64").tolist(),
                           list(zip(closing["closed"].tolist(), closing["carry"].tolist())),
                           int(rows.loc[rows["need"].isna(), "carry"].iloc[0]))


def _after(outcome, carry, limit):
    """(shards closed, bytes carried) of a block that inherits `carry` bytes."""
    needs, left, total = outcome
    i = bisect_left(needs, limit - carry)
    return left[i] if i < len(needs) else (0, carry + total)


def _compose_blocks(pdf, writer, limit):
    """The outcome of a node's blocks one after another."""
    needs, left, total = [], [], 0
    for _, outcome in _blocks_in_order(pdf):
        following = [_after(outcome, carry, limit) for _, carry in left]
        left = [(closed + more, carry) for (closed, _), (more, carry) in zip(left, following)]
        if not needs or needs[-1] < limit:  # an empty shard may still be open here
            fresh = [(n + total, x) for n, x in zip(*outcome[:2]) if not needs or n + total > needs[-1]]
            needs += [n for n, _ in fresh]
            left += [x for _, x in fresh]
        total += outcome[2]
    rows = [(n, closed, carry) for n, (closed, carry) in zip(needs, left)] + [(None, 0, total)]
    out = pd.DataFrame(rows, columns=["need", "closed", "carry"]).astype("Int64")
    out["_block"] = pdf["_node"].iloc[0]
    return _with_keys(out, pdf, writer)[[*writer, "_block", "need", "closed", "carry"]]


def _hand_down(pdf, writer, limit):
    carry, first, made = int(pdf["_carry"].iloc[0]), int(pdf["_first"].iloc[0]), []
    for block, outcome in _blocks_in_order(pdf):
        made.append((block, carry, first))
        closed, carry = _after(outcome, carry, limit)
        first += closed
    out = pd.DataFrame(made, columns=["_block", "_carry", "_first"])
    return _with_keys(out, pdf, writer)


def _number_block(pdf, limit):
    pdf = pdf.sort_values("_row")
    closings, _ = _closing_rows(pdf["_size"].to_numpy().cumsum(), limit, pdf["_carry"].iloc[0])
    closed_before = np.searchsorted(closings, np.arange(len(pdf)), side="left")
    return pdf.assign(shard=pdf["_first"].iloc[0] + closed_before)


def _with_keys(out, pdf, keys):
    for name in keys:
        out[name] = pdf[name].iloc[0]
    names = [*keys, *[c for c in out.columns if c not in keys]]
    return out[names]
