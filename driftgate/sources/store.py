"""A store laid out by identity: what is stored can be asked for without moving what is stored.

The table is bucketed by a text form of the identity and partitioned by batch. A bucketed scan comes
out partitioned, so new identities meet stored ones by an exchange of the new keys alone, and a batch of few
identities opens only their buckets. The layout is in the file names; the catalog entry can be made
again by any session from the path.
"""

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from driftgate.operators.planning import dedup
from driftgate.schema import LATENT, LATENT_KEYS, ROW_ADDRESS
from driftgate.session import materialize, payload_write_options
from driftgate.settings import MAX_PUSHED_KEYS, STORE_BUCKETS
from driftgate.sources.latents import fetch_payloads, with_address

IDENTITY = "identity"


def identity(*keys):
    """The identity as a text that is never null: null parts are told from all others."""
    return F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]),
                     {"ignoreNullFields": "false"})


def open_store(spark: SparkSession, path, schema=LATENT, buckets=STORE_BUCKETS) -> str:
    """The name of the table at `path`, which is made if there is none. A store keeps the number of
    buckets it was made with."""
    layout = f"{path}/_layout"
    try:
        buckets = spark.read.schema("buckets int").parquet(layout).first()["buckets"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(layout)
    name = f"driftgate_store_{hashlib.md5(path.encode()).hexdigest()[:16]}"
    columns = T.StructType([*schema.fields, T.StructField(IDENTITY, T.StringType()),
                            T.StructField("batch", T.LongType())])
    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    options = payload_write_options() | {
        f"parquet.bloom.filter.enabled#{IDENTITY}": "true",
        f"parquet.bloom.filter.expected.ndv#{IDENTITY}": "64"}
    given = ", ".join(f"'{k}' '{v}'" for k, v in options.items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({listed}) USING parquet OPTIONS ({given}) "
              f"PARTITIONED BY (batch) CLUSTERED BY ({IDENTITY}) INTO {buckets} BUCKETS "
              f"LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name


def not_stored(new: DataFrame, table: str, before=None) -> DataFrame:
    """The rows of `new` (with the identity column) whose identity is in no batch of the store, or in
    none below `before`. Store `new` first: a small one is looked at before the join.

    The stored side is scanned by bucket and not exchanged. Up to some hundred new identities are
    pushed into its scan, which then opens their buckets only.
    """
    stored = new.sparkSession.table(table)
    if before is not None:
        stored = stored.where(F.col("batch") < before)
    few = [row[0] for row in new.select(IDENTITY).distinct().limit(MAX_PUSHED_KEYS + 1).collect()]
    if len(few) <= MAX_PUSHED_KEYS:
        stored = stored.where(F.col(IDENTITY).isin(few))
    return new.join(stored.select(IDENTITY), IDENTITY, "left_anti")


def write_batch(rows: DataFrame, table: str, batch: int) -> None:
    """Store `rows` as batch `batch`, in place of what it held before. Each task writes its own rows to
    the buckets' files: nothing is exchanged."""
    spark = rows.sparkSession
    names = [c for c in spark.table(table).columns if c != "batch"]
    rows.select(*names).createOrReplaceTempView("driftgate_batch")
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (batch = {int(batch)}) "
              "SELECT * FROM driftgate_batch")
    spark.catalog.dropTempView("driftgate_batch")


def pick_rows(narrow: DataFrame, order, keys=LATENT_KEYS) -> DataFrame:
    """Of the rows of each identity the first in `order`, then by address; identities that share a null
    part are the same. `narrow` holds the keys, the order and the address: no payload."""
    return dedup(narrow.select(*dict.fromkeys([*keys, *order, *ROW_ADDRESS])),
                 [*order, *[c for c in ROW_ADDRESS if c not in order]], keys)


def dedup_rows(scan: DataFrame, order, keys=LATENT_KEYS, schema=LATENT,
               payload_bytes=None) -> DataFrame:
    """A scan of shards with one row per identity, the first in `order`. It is settled on keys and row
    addresses, which alone are exchanged; payloads stay in the tasks that read them."""
    columns = [c for c in dict.fromkeys([*keys, *order]) if c not in ROW_ADDRESS]
    picked = materialize(pick_rows(with_address(scan.select(*columns)), order, keys), "picked-rows")
    return fetch_payloads(picked, schema=schema, keys=keys, payload_bytes=payload_bytes).drop(*ROW_ADDRESS)
