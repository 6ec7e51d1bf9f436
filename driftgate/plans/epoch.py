"""One virtual training epoch over a table of scored tubelets."""

from pyspark.sql import DataFrame, functions as F

from driftgate.functions.payload import payload_size, permute_payload
from driftgate.operators.curation import (
    assign_workers, cap_per_worker, kinetic_gate, with_batches, with_split,
)
from driftgate.plans.calibrate import frame_changes, scores
from driftgate.schema import LATENT_KEYS, ROW_ADDRESS
from driftgate.session import materialize
from driftgate.settings import BATCH_SIZE, LATENT_SHAPE, SEED, TUBELETS_PER_EPOCH
from driftgate.sources.latents import fetch_payloads, list_shards, read_latents


def epoch_sample(scored: DataFrame, tau, split="train", seed=SEED, n_workers=4,
                 cap=TUBELETS_PER_EPOCH, batch_size=BATCH_SIZE, shard="file_path",
                 row="row_index", scope="per_worker", listing: DataFrame = None) -> DataFrame:
    """Rows of one epoch: worker, position and batch of each kept tubelet.

    Scores do not depend on the seed, so they are stored once and every epoch touches keys
    and scalars only. Split and gate run before the shard join; the payloads of the rows
    kept are fetched by address afterwards. Files count for the shuffle even if none of
    their rows is kept; with `listing` (one column `shard` per listed file) so do those without a
    scored row.
    """
    files = (scored if listing is None else listing).select(shard).distinct()
    files = assign_workers(files, n_workers, seed, shard)
    kept = kinetic_gate(with_split(scored).where(F.col("split") == split), tau)
    dealt = kept.join(files.select(shard, "pos", "worker"), shard)
    capped = cap_per_worker(dealt, ["pos", row], cap, scope)
    return with_batches(capped, batch_size)


def store_epoch(spark, root, eps, tau, changes: DataFrame = None, shape=LATENT_SHAPE,
                **options) -> DataFrame:
    """One epoch over a whole store: the rows of every tag, dealt by all shards listed below `root`,
    as `epoch_sample` does with `options`. `changes` are the stored frame changes of every tag
    (`frame_changes` with `tag=None`), which are made here if they are not given."""
    if changes is None:
        changes = frame_changes(
            read_latents(spark, root, payload_bytes=payload_size(shape)), shape, tag=None)
    listing = list_shards(spark, root).select(F.col("path").alias("file_path"))
    return epoch_sample(scores(changes, eps), tau, listing=listing, **options)


def epoch_payloads(sample: DataFrame, shape=LATENT_SHAPE) -> DataFrame:
    """The tensors of an epoch sample in channel-major order, with worker, row and batch.

    The sample is at most the cap times the workers, so its addresses are broadcast and the
    payloads never leave the tasks that scan them. A sample with the identities also skips the row
    groups of a shard that it has no row of.
    """
    place = ["worker", "row", "batch_id"]
    known = [c for c in LATENT_KEYS if c in sample.columns]
    stored = materialize(sample.select(*ROW_ADDRESS, *place, *known), "epoch-sample")
    rows = fetch_payloads(stored, place, payload_bytes=payload_size(shape))
    return rows.withColumn("latent_bytes", permute_payload(shape)("latent_bytes"))
