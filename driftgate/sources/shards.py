"""Writing latent shards of bounded size."""

import math

from pyspark.sql import DataFrame, functions as F

from driftgate.schema import LATENT
from driftgate.session import payload_write_options
from driftgate.settings import SHARD_BYTES


def write_shards(df: DataFrame, root, payload_bytes, max_bytes=SHARD_BYTES, mode="append"):
    """Write payload rows of one known size so that a file closes with the row that brings
    it to `max_bytes`. Rows stay in the tasks that hold them: nothing is exchanged."""
    rows = math.ceil(max_bytes / payload_bytes)
    (df.select(*LATENT.names).write.options(**payload_write_options())
     .option("maxRecordsPerFile", rows).mode(mode).parquet(root))


def write_assigned_shards(df: DataFrame, root, writer, shard="shard", mode="append"):
    """Write rows with an assigned shard so that every shard is whole: one folder per writer
    and shard. This is the one place where payloads cross an exchange; use it only when the
    exact membership matters. A shard is bounded in size, so no task gets more than a few."""
    folders = {f"by_{c}": F.col(c) for c in [*writer, shard]}
    (df.repartition(*writer, shard).withColumns(folders).select(*LATENT.names, *folders)
     .write.options(**payload_write_options()).partitionBy(*folders).mode(mode).parquet(root))
