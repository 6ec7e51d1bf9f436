"""Streaming resume: an identity already stored is not written again."""

from pyspark.sql import DataFrame

from driftgate.operators.planning import todo
from driftgate.schema import LATENT_KEYS, ROW_ADDRESS
from driftgate.session import materialize
from driftgate.settings import STORE_BUCKETS
from driftgate.sources.latents import fetch_payloads, with_address
from driftgate.sources.store import (
    IDENTITY, identity, not_stored, open_store, pick_rows, write_batch,
)


def dedup_stream(stream: DataFrame, store, checkpoint, order, keys=LATENT_KEYS,
                 stored: DataFrame = None, buckets=STORE_BUCKETS, payload_bytes=None) -> None:
    """Append the new identities of a stream of shards to the store at `store`.

    `stream` is a file stream, or columns and rows chosen from one. Only keys, order and row addresses
    pass through the query. There is no event time to expire state by, so the store is the state: each
    micro-batch is reduced to one row per identity, those in earlier batches (or in `stored`, if
    given) go, and the rows that are left are fetched by address and written where they are read. No
    payload crosses an exchange and no stored payload is read. A replayed batch overwrites itself.
    """
    schema = stream.schema
    open_store(stream.sparkSession, store, schema, buckets)
    narrow = with_address(stream).select(*dict.fromkeys([*keys, *order, *ROW_ADDRESS]))

    def add(batch, batch_id):
        table = open_store(batch.sparkSession, store, schema, buckets)
        new = pick_rows(batch, order, keys)
        if stored is not None:
            new = todo(new, stored, keys)
        new = materialize(new.withColumn(IDENTITY, identity(*keys)), "new-identities")
        new = materialize(not_stored(new, table, batch_id), "new-rows")
        rows = fetch_payloads(new, schema=schema, keys=keys, payload_bytes=payload_bytes)
        write_batch(rows.withColumn(IDENTITY, identity(*keys)), table, batch_id)

    (narrow.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
