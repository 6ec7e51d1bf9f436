"""Streaming over newly landed shards."""

from pyspark.sql import DataFrame, SparkSession

from driftgate.schema import LATENT
from driftgate.session import payload_session
from driftgate.sources.latents import SHARDS


def stream_latents(spark: SparkSession, root, max_files=None, glob=SHARDS, schema=LATENT,
                   payload_bytes=None) -> DataFrame:
    """Shards below `root` as a stream: those present first, later ones as they land. With
    `payload_bytes` its batches are bounded, as in `read_latents`."""
    reader = (payload_session(spark, payload_bytes).readStream.schema(schema).option("recursiveFileLookup", True)
              .option("pathGlobFilter", glob))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(root)


def run_available(stream: DataFrame, path, checkpoint) -> None:
    """Append everything now available to a Parquet table; call again for what lands later."""
    (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start(path).awaitTermination())
