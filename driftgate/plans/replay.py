"""Epochs of training steps served from a store that grows: passes over it, one after another."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftgate.operators.ordering import index_rows
from driftgate.operators.planning import gather
from driftgate.plans.epoch import epoch_sample
from driftgate.settings import (
    BATCH_SIZE, FALLBACK_STEPS_PER_EPOCH, SEED, TUBELETS_PER_EPOCH,
)
from driftgate.streaming.shards import run_available

STATE = "epoch long, pass long, seed long, taken long, batches long"


def steps_per_epoch(tubelets=TUBELETS_PER_EPOCH, batch_size=BATCH_SIZE) -> int:
    """Steps of an epoch; a fixed number where an epoch is less than a batch."""
    return tubelets // batch_size or FALLBACK_STEPS_PER_EPOCH


class Replay:
    """Serves epochs from the scores of a store's shards, and goes on where the last one ended.

    An epoch is a number of steps, each one batch. Batches come from a pass: an `epoch_sample` over
    all shards there are, the workers' batches in turn. When a pass runs dry inside an epoch, the shards that
    have landed meanwhile are scored, and the next pass begins with the seed epoch + step. A pass outlives
    its epoch. Everything that decides is stored below `store`: scores, passes, the epochs' rows, and
    for every epoch where it ended, so another session continues, and an epoch that was cut short is
    made again as it was.

    `scored` is a stream of scored rows over the store (see `stream_latents`, `psi_from_payload`); each
    shard is read once. `options` go to `epoch_sample`; `prepare` may add columns to the scores for it.
    """

    def __init__(self, spark: SparkSession, scored, store, tau, steps, seed=SEED, prepare=None,
                 **options):
        self.spark, self.scored, self.store, self.tau = spark, scored, store, tau
        self.steps, self.seed, self.options = steps, seed, options
        self.prepare = prepare or (lambda scores: scores)
        if steps < 1:
            raise ValueError("an epoch has at least one step")

    def _state(self):
        """(epoch, pass, seed, batches taken of it, batches of it) after the last whole epoch."""
        try:
            rows = self.spark.read.schema(STATE).parquet(f"{self.store}/state")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, -1, self.seed, 0, 0
        return tuple(rows.orderBy(F.desc("epoch")).first())

    def _begin(self, number, seed):
        """Score what has landed, deal the pass and store it; its number of batches."""
        run_available(self.scored, f"{self.store}/scores", f"{self.store}/stream")
        scores = self.prepare(self.spark.read.schema(self.scored.schema).parquet(f"{self.store}/scores"))
        sample = epoch_sample(scores, self.tau, seed=seed, **self.options)
        batches = index_rows(sample.select("batch_id", "worker").distinct(), [],
                             ["batch_id", "worker"], "turn")
        path = f"{self.store}/passes/pass={number}"
        sample.join(batches, ["batch_id", "worker"]).write.mode("overwrite").parquet(path)
        last = self.spark.read.parquet(path).agg(F.max("turn")).first()[0]
        if last is None:
            raise RuntimeError("no batch in the whole store: nothing passes split and gate")
        return last + 1

    def next_epoch(self) -> DataFrame:
        """The rows of the next epoch: those of the passes with epoch, step, pass and seed."""
        epoch, number, seed, taken, batches = self._state()
        epoch, parts, step = epoch + 1, [], 0
        while step < self.steps:
            if taken == batches:
                number, taken = number + 1, 0
                # The first pass has the seed given; later ones are told by where they begin.
                seed = self.seed if number == 0 else epoch + step
                batches = self._begin(number, seed)
            more = min(self.steps - step, batches - taken)
            rows = self.spark.read.parquet(f"{self.store}/passes/pass={number}")
            parts.append(rows.where((F.col("turn") >= taken) & (F.col("turn") < taken + more)).withColumns({
                "epoch": F.lit(epoch).cast("long"), "pass": F.lit(number).cast("long"),
                "step": F.col("turn") - taken + step, "seed": F.lit(seed).cast("long")}).drop("turn"))
            step, taken = step + more, taken + more
        path = f"{self.store}/epochs/epoch={epoch}"
        gather(parts).drop("epoch").write.mode("overwrite").parquet(path)
        ended = self.spark.createDataFrame([(epoch, number, seed, taken, batches)], STATE)
        ended.coalesce(1).write.mode("append").parquet(f"{self.store}/state")
        return self.spark.read.parquet(path).withColumn("epoch", F.lit(epoch).cast("long"))
