"""Latent table: scans, shard listing, row addresses, identity index."""

from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftgate.schema import LATENT, LATENT_KEYS, ROW_ADDRESS
from driftgate.session import broadcast_bounded, payload_session
from driftgate.settings import (
    MAX_BROADCAST_ROWS, MAX_PUSHED_KEYS, MAX_PUSHED_SCANS, UNKNOWN, UNKNOWN_INDEX, UNMEASURED_FLOW,
)

SHARDS = "*.parquet"


def read_latents(spark: SparkSession, root, on_error="raise", glob=SHARDS, schema=LATENT,
                 payload_bytes=None) -> DataFrame:
    """All shards below `root` (a path or a list of files), with the fixed schema.

    Give `payload_bytes`, the size of a payload, where payloads are read: batches of the scan are then
    bounded (`payload_session`). Narrow scans are better off without.

    `on_error="skip"` passes over shards that cannot be read; `skipped_shards` names them.
    """
    reader = (payload_session(spark, payload_bytes).read.schema(schema)
              .option("recursiveFileLookup", True).option("pathGlobFilter", glob))
    if on_error == "skip":
        reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    elif on_error != "raise":
        raise ValueError(f"on_error must be 'raise' or 'skip', not {on_error!r}")
    return reader.parquet(*([root] if isinstance(root, str) else root))


def list_shards(spark: SparkSession, root, glob=SHARDS) -> DataFrame:
    """Path and length of every shard; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).load(root).select("path", "length"))


def shard_rows(spark: SparkSession, root, glob=SHARDS, schema=LATENT) -> DataFrame:
    """Every listed shard (path, length) with `rows_stored`, which its footer states, and
    `rows_read`, which a tolerant scan of all columns gets. Both are 0 for an unreadable or empty
    shard. This reads every payload once, since damage shows nowhere else."""
    rows = read_latents(spark, root, "skip", glob, schema)
    path = F.col("_metadata.file_path").alias("path")
    stored = rows.select(path).groupBy("path").agg(F.count("*").alias("rows_stored"))
    # A count alone would be answered from the footer: the hash makes the scan read all columns.
    whole = F.xxhash64(*schema.names).alias("_whole")
    read = rows.select(path, whole).groupBy("path").agg(
        (F.count_if(F.col("_whole") >= 0) + F.count_if(F.col("_whole") < 0)).alias("rows_read"))
    return list_shards(spark, root, glob).join(stored, "path", "left").join(
        read, "path", "left").fillna(0, ["rows_stored", "rows_read"])


def skipped_shards(spark: SparkSession, root, glob=SHARDS, schema=LATENT) -> DataFrame:
    """Listed shards of which a tolerant scan loses rows or gets none (unreadable, damaged or
    empty), with the counts of `shard_rows`."""
    return shard_rows(spark, root, glob, schema).where(
        (F.col("rows_read") < F.col("rows_stored")) | (F.col("rows_stored") == 0))


def with_address(df: DataFrame) -> DataFrame:
    """Add each row's file and position in it. Apply directly to a scan."""
    return df.select("*", *[F.col(f"_metadata.{c}").alias(c) for c in ROW_ADDRESS])


def scan_motion(latents: DataFrame, motion="m_flow", tag="tag", keep=()) -> DataFrame:
    """Motion and tag of every row with its address and the columns `keep`; the payload column is
    never read. With the identity kept, `fetch_payloads` skips row groups."""
    return latents.select(*[F.col(f"_metadata.{c}").alias(c) for c in ROW_ADDRESS], *keep,
                          F.col(tag).alias("tag"), F.col(motion).alias("m_flow"))


def fetch_payloads(winners: DataFrame, keep=(), schema=LATENT, keys=LATENT_KEYS,
                   max_rows=MAX_BROADCAST_ROWS, max_pushed=MAX_PUSHED_KEYS,
                   payload_bytes=None) -> DataFrame:
    """Full rows at the addresses of `winners`, opening only the shards that hold one, with
    the columns `keep` of `winners` added. Store `winners` first: it is read several times.

    The addresses go to the scan tasks, so payloads stay in the tasks that read them, however many
    winners there are: touched shards are taken in groups of at most `max_rows` addresses, each with
    its own broadcast. Where `winners` has the identity `keys` and is not too large, a group is cut to
    `max_pushed` rows and its identities are pushed into the scan, which then skips the row groups
    that hold none by their statistics and Bloom filters (see `payload_write_options`).
    `payload_bytes` as in `read_latents`.
    """
    spark = payload_session(winners.sparkSession, payload_bytes)
    per_file, hashes = {}, {}
    for file, value, n in winners.groupBy("file_path", F.xxhash64("file_path")).count().collect():
        per_file[file], hashes[file] = n, value
    if not per_file:
        return with_fields(spark.createDataFrame([], schema), winners, [*ROW_ADDRESS, *keep])
    pushed = ({*keys} <= {*winners.columns} and {*keys} <= {*schema.names}
              and sum(per_file.values()) <= max_pushed * MAX_PUSHED_SCANS)
    parts = []
    for files in _file_groups(per_file, max_pushed if pushed else max_rows):
        rows = with_address(spark.read.schema(schema).parquet(*files))
        chosen = winners.where(F.col("file_path").isin(files)) if len(per_file) > len(files) else winners
        held = sum(per_file[f] for f in files)
        if pushed and held <= max_pushed:
            rows = rows.where(any_identity(chosen.select(*keys).distinct().collect(), keys))
        # A path is sent as a hash, which tells the files of the group apart.
        distinct = len({hashes[f] for f in files}) == len(files)
        hashed = (F.xxhash64("file_path") if distinct else F.col("file_path")).alias("_file")
        chosen = broadcast_bounded(chosen.select(hashed, "row_index", *keep), held)
        parts.append(rows.withColumn("_file", hashed).join(chosen, ["_file", "row_index"]).select(
            *schema.names, *ROW_ADDRESS, *keep))
    return reduce(DataFrame.unionByName, parts)


def _file_groups(per_file: dict, limit):
    """Lists of files, in order, that hold at most `limit` rows in all or are one file."""
    group, held = [], 0
    for file in sorted(per_file):
        if group and held + per_file[file] > limit:
            yield group
            group, held = [], 0
        group.append(file)
        held += per_file[file]
    yield group


def any_identity(rows, keys):
    """The condition that a row's identity is one of `rows`, as comparisons that reach the scan."""
    def one(row):
        return reduce(and_, [F.col(k).isNull() if row[k] is None else F.col(k) == F.lit(row[k])
                             for k in keys])

    conditions = [one(row) for row in rows]
    while len(conditions) > 1:  # in pairs, so that the tree is not deep
        conditions = [reduce(or_, conditions[i:i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0]


def with_fields(df: DataFrame, other: DataFrame, names) -> DataFrame:
    """`df` with null columns typed like those of `other`."""
    return df.withColumns({c: F.lit(None).cast(other.schema[c].dataType) for c in names})


def latent_index(spark: SparkSession, root) -> DataFrame:
    """Distinct stored identities; empty while the store does not exist."""
    try:
        return index_of(read_latents(spark, root))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LATENT).select(*LATENT_KEYS)


def index_of(latents: DataFrame, keys=LATENT_KEYS) -> DataFrame:
    return latents.select(*keys).distinct()


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill missing metadata with the fixed defaults. NaN motion is a value and stays."""
    defaults = {"factory_id": UNKNOWN, "worker_id": UNKNOWN, "tag": UNKNOWN,
                "video_index": UNKNOWN_INDEX, "m_flow": UNMEASURED_FLOW}
    return df.withColumns({
        c: F.coalesce(c, F.lit(v).cast(df.schema[c].dataType))
        for c, v in defaults.items() if c in df.columns})


def only_tag(df: DataFrame, tag) -> DataFrame:
    return df.where(F.col("tag") == tag)
