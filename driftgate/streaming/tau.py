"""Online estimate of the motion gate that stops reading once it has converged."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from driftgate.operators.calibration import converge_by_file
from driftgate.operators.histogram import BUCKET_LIMIT, STATE, CountedHistogram
from driftgate.settings import (
    CHECKPOINT_STEP, CONVERGENCE_TOLERANCE, FILE_STOP_PATIENCE, TAU_PERCENTILE,
)

CHECK = "pos long, n_samples long, tau double"


class OnlineTau:
    """What is stored below `store`, one folder per micro-batch so that a replayed one overwrites its own
    rows: scores in order, the histogram of all scores up to the batch, and the checks."""

    def __init__(self, spark, store, step, tol, patience, pct, limit):
        self.spark, self.store = spark, store
        self.step, self.tol, self.patience, self.pct, self.limit = step, tol, patience, pct, limit

    def _stored(self, name, schema):
        try:
            return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.store}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, batch long")

    def _write(self, rows, name, batch):
        rows.write.mode("overwrite").parquet(f"{self.store}/{name}/batch={batch}")

    def histogram(self, before=None):
        """The histogram after the last batch, or after the last one below `before`."""
        found = self._stored("histogram", STATE)
        if before is not None:
            found = found.where(F.col("batch") < before)
        last = found.agg(F.max("batch")).first()[0]
        return CountedHistogram.load(found.where(F.col("batch") == last), self.limit)

    def checks(self):
        return self._stored("checks", CHECK)

    def percentile(self, histogram, upto=None):
        """The gate of all scores that `histogram` counts, and the rows that were read for it."""
        scores = self._stored("scores", "psi double")
        if upto is not None:
            scores = scores.where(F.col("batch") <= upto)

        def read(low, high):
            # Scores lie in order inside their files, so the range reaches few pages of each.
            inside = scores.where(F.col("psi") >= low)
            inside = inside.where(~F.isnan("psi")) if high is None else inside.where(F.col("psi") < high)
            return inside.select(F.col("psi").alias("value"))

        return histogram.percentile(self.pct, read)

    def add(self, batch: DataFrame, batch_id: int) -> bool:
        """Take a micro-batch in; whether the gate has converged with it."""
        self._write(batch.select("psi").where("psi is not null").sortWithinPartitions("psi"),
                    "scores", batch_id)
        own = self.spark.read.schema("psi double").parquet(f"{self.store}/scores/batch={batch_id}")
        histogram = self.histogram(batch_id)
        before = histogram.total
        histogram.add(own, "psi")
        # A file without scores is no occasion for a check, even if marks were passed before.
        earlier = self.checks().where(F.col("pos") < batch_id).count()
        checked = histogram.total > before and histogram.total >= (earlier + 1) * self.step
        if checked:
            current = self.percentile(histogram, batch_id)
            self._write(self.spark.createDataFrame(
                [(batch_id, histogram.total, current)], CHECK).coalesce(1), "checks", batch_id)
        self._write(histogram.state(self.spark).coalesce(1), "histogram", batch_id)
        return checked and self.converged()

    def decide(self, final) -> DataFrame:
        return converge_by_file(self.checks().select("pos", "n_samples", "tau"),
                                self.spark.createDataFrame([(final,)], "tau double"), self.tol,
                                self.patience)

    def converged(self) -> bool:
        return self.decide(None).first()["converged"]

    def result(self) -> DataFrame:
        if self.converged():
            return self.decide(None)
        return self.decide(self.percentile(self.histogram()))


def online_tau(psi: DataFrame, store, checkpoint, step=CHECKPOINT_STEP,
               tol=CONVERGENCE_TOLERANCE, patience=FILE_STOP_PATIENCE, pct=TAU_PERCENTILE,
               limit=BUCKET_LIMIT) -> DataFrame:
    """Consume a stream of scores (column `psi`) until the gate converges or it runs dry.

    A micro-batch plays the part of a file: with one file per trigger the result equals
    `file_checks` and `converge_by_file`. A check counts the new scores into a stored histogram and
    reads the scores of one bucket, at most some `limit`: its cost does not grow with the scores
    before it. The decision depends on the stored tables only. Returns the one-row result.
    """
    spark, stop = psi.sparkSession, []
    so_far = OnlineTau(spark, store, step, tol, patience, pct, limit)
    if so_far.converged():
        return so_far.result()

    def add(batch, batch_id):
        if stop:
            return
        state = OnlineTau(batch.sparkSession, store, step, tol, patience, pct, limit)
        if state.add(batch, batch_id):
            stop.append(batch_id)

    query = (psi.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    while not query.awaitTermination(1):
        if stop:
            query.stop()
    return so_far.result()
