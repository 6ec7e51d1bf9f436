"""The calibration record: one nested row, one schema, one place."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftgate.schema import CALIBRATION


def write_calibration(record: DataFrame, path: str) -> None:
    """Write the one-row record as JSON. A missing value is written as null, not dropped."""
    (record.select(*CALIBRATION.names).coalesce(1).write.mode("overwrite")
     .option("ignoreNullFields", False).json(path))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """The record at `path`. Raises when there is none: calibration must run first."""
    try:
        record = spark.read.schema(CALIBRATION).json(path)
        found = record.limit(2).count()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = 0
    if found != 1:
        raise FileNotFoundError(f"{found} calibration records at {path}; run calibration first")
    return record


def with_calibration(df: DataFrame, record: DataFrame) -> DataFrame:
    """Add the noise floor and the gate to every row, as scalar subqueries (no join)."""
    return df.withColumns({
        "epsilon": record.select("epsilon_noise_floor").scalar(),
        "tau": record.select("tau_kinetic_gate").scalar(),
    })


def thresholds(record: DataFrame):
    """(epsilon, tau) as floats, for jobs that need them as parameters."""
    row = record.select("epsilon_noise_floor", "tau_kinetic_gate").first()
    return row[0], row[1]


def guard(samples: DataFrame, value="l1") -> DataFrame:
    """Number of usable samples. Raises when there is none to calibrate from, and on NaN,
    which a percentile would silently rank as the largest value."""
    counted = samples.agg(F.count(value).alias("n"))
    n, n_nan = samples.agg(F.count(value), F.count_if(F.isnan(value))).first()
    if n == 0:
        raise RuntimeError(f"no value of {value} to calibrate from")
    if n_nan:
        raise ValueError(f"{n_nan} of {n} values of {value} are NaN")
    return counted
