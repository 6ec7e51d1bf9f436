"""Training-set curation: split, gate, shuffled shards, workers, caps, batches.

Everything here runs on keys, row addresses and scalars; payloads are fetched afterwards by
address.
"""

from pyspark.sql import DataFrame, functions as F

from driftgate.functions.expressions import shuffle_key, split_bucket, split_name
from driftgate.operators.ordering import first_n, index_rows
from driftgate.operators.planning import take_quota
from driftgate.session import materialize
from driftgate.settings import BATCH_SIZE, SEED, TUBELETS_PER_EPOCH


def with_split(df: DataFrame, factory="factory_id", video="video_index") -> DataFrame:
    """Add the split bucket and 'train' or 'val'. Whole videos stay together."""
    return df.withColumns({"bucket": split_bucket(factory, video),
                           "split": split_name(factory, video)})


def kinetic_gate(df: DataFrame, tau) -> DataFrame:
    """Keep rows unless psi < tau: equality and NaN stay."""
    tau = tau if not isinstance(tau, (int, float)) else F.lit(float(tau))
    return df.where(~F.coalesce(F.col("psi") < tau, F.lit(False)))


def shuffle_shards(shards: DataFrame, seed=SEED, key="shard") -> DataFrame:
    """Add `pos`, the position of each shard in a seeded shuffle."""
    ordered = shards.withColumn("_hash", shuffle_key(key, seed))
    return index_rows(ordered, [], ["_hash", key], "pos").drop("_hash")


def assign_workers(shards: DataFrame, n_workers, seed=SEED, key="shard") -> DataFrame:
    """Deal shuffled shards to workers in turn."""
    return shuffle_shards(shards, seed, key).withColumn("worker", F.col("pos") % n_workers)


def cap_per_worker(df: DataFrame, order, n=TUBELETS_PER_EPOCH, scope="per_worker") -> DataFrame:
    """The first n rows of each worker, or the first n of all, with their position."""
    if scope == "per_worker":
        return first_n(df, ["worker"], order, n, "row")
    if scope == "global":
        # No task sees more than a range of the rows, and at most n of them are numbered.
        return index_rows(take_quota(df, n, order), [], order, "row", row_bound=n)
    raise ValueError(f"scope must be 'per_worker' or 'global', not {scope!r}")


def with_batches(df: DataFrame, size=BATCH_SIZE, order=None) -> DataFrame:
    """Add `batch_id` within each worker; the last batch may be short.

    Uses the positions of `cap_per_worker` when there, and numbers the rows otherwise: they are
    written first, so that they are built once and counted by their footers.
    """
    if "row" not in df.columns:
        df = index_rows(materialize(df, "dealt-rows"), ["worker"], order, "row")
    return df.withColumn("batch_id", F.floor(F.col("row") / size).cast("long"))


def check_split(train: DataFrame, val: DataFrame, keys) -> DataFrame:
    """One row: distinct keys in each side, in both, and in either."""
    sides = (train.select(*keys, F.lit(1).alias("_train"), F.lit(0).alias("_val"))
             .unionByName(val.select(*keys, F.lit(0).alias("_train"), F.lit(1).alias("_val"))))
    return (sides.groupBy(*keys)
            .agg(F.max("_train").alias("_train"), F.max("_val").alias("_val"))
            .agg(F.coalesce(F.sum("_train"), F.lit(0)).alias("n_train"),
                 F.coalesce(F.sum("_val"), F.lit(0)).alias("n_val"),
                 F.count_if(F.col("_train") + F.col("_val") == 2).alias("n_both"),
                 F.count("*").alias("n_all")))
