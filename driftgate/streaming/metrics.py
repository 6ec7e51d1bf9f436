"""Counters of a run, collected while it writes."""

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from driftgate.schema import LATENT
from driftgate.sources.latents import SHARDS, shard_rows


def write_with_metrics(df: DataFrame, path, counters: dict, mode="append") -> DataFrame:
    """Write `df` and return its counters as one row. They are gathered by the write itself,
    so nothing is read twice. `counters` maps names to aggregate expressions."""
    observed = Observation()
    named = [c.alias(n) for n, c in counters.items()]
    df.observe(observed, *named).write.mode(mode).parquet(path)
    found = observed.get
    return df.sparkSession.range(1).select(
        *[F.lit(found[f.name]).cast(f.dataType).alias(f.name)
          for f in df.agg(*named).schema])


def file_metrics(spark: SparkSession, root, glob=SHARDS, schema=LATENT) -> DataFrame:
    """The shards of a tolerant scan as one row: how many are listed, read whole, read in part and
    skipped, and the rows read and lost. Damage shows only where a payload is read, so each is read once."""
    rows = shard_rows(spark, root, glob, schema)
    whole = (F.col("rows_read") == F.col("rows_stored")) & (F.col("rows_stored") > 0)
    return rows.agg(
        F.count("*").alias("n_files"), F.count_if(whole).alias("n_read"),
        F.count_if(~whole & (F.col("rows_read") > 0)).alias("n_partly"),
        F.count_if(F.col("rows_read") == 0).alias("n_skipped"),
        F.coalesce(F.sum("rows_read"), F.lit(0)).alias("rows_read"),
        F.coalesce(F.sum(F.col("rows_stored") - F.col("rows_read")), F.lit(0)).alias("rows_lost"))
