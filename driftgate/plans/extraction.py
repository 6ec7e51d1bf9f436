"""Work list of a resumable extraction: videos to windows to new identities to quotas."""

from pyspark.sql import DataFrame, functions as F

from driftgate.operators.planning import (
    select_videos, shard_factories, shard_quotas, take_quota, todo,
)
from driftgate.schema import LATENT_KEYS
from driftgate.settings import (
    MAX_VIDEOS_PER_FACTORY, SEED, TARGET_TUBELETS, TUBELET_RAW_FRAMES,
)


def window_starts(videos: DataFrame, size=TUBELET_RAW_FRAMES) -> DataFrame:
    """One row per whole window of each video, from its frame count alone."""
    last = F.col("n_frames") - size
    starts = F.sequence(F.lit(0), last.cast("int"), F.lit(size))
    return videos.where(last >= 0).withColumn("tubelet_start", F.explode(starts))


def work_list(videos: DataFrame, index: DataFrame, key="mp4_name", target=TARGET_TUBELETS,
              max_videos=MAX_VIDEOS_PER_FACTORY, size=TUBELET_RAW_FRAMES, seed=SEED, n_shards=1,
              factories: DataFrame = None) -> DataFrame:
    """Tubelets still to extract, with the extraction shard that is to do it. Stored ones do not use up
    the quota.

    What is left of the target is shared out evenly among the shards, and so are the factories, in
    chunks of their order. Each shard takes the first windows of its own factories; what these cannot
    fill is no other shard's. `videos` has factory_id, worker_id, n_frames and a unique `key`;
    `factories` lists the factories that are dealt out (default: those with videos).
    """
    chosen = select_videos(videos, key, F.col("n_frames") >= size, max_videos, seed)
    chosen = chosen.withColumn("video_index", F.col("video_index").cast("int"))
    new = todo(window_starts(chosen, size), index)
    listed = (videos if factories is None else factories).select("factory_id").distinct()
    new = new.join(shard_factories(listed, n_shards), "factory_id")
    done = index.select(*LATENT_KEYS).distinct().agg(F.count("*"))
    quotas = shard_quotas(videos.sparkSession, done, target, n_shards)
    return take_quota(new, quotas, ["factory_id", "video_index", "tubelet_start"], ["shard"])
