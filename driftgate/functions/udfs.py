"""Functions registered for SQL: motion score, robust loss aggregate, archive members."""

import pandas as pd
from pyspark.sql import SparkSession, functions as F, types as T

from driftgate.functions.payload import excess, frame_changes, huber_terms
from driftgate.sources.archives import list_members


@F.pandas_udf(T.DoubleType())
def psi(payloads: pd.Series, frames: pd.Series, eps: pd.Series) -> pd.Series:
    """Motion score of a float32 payload of the given frame count, above `eps`."""
    def score(buffer, n, floor):
        if buffer is None:
            return None
        return excess(frame_changes(buffer, (int(n),)), floor)
    return pd.Series([score(*row) for row in zip(payloads, frames, eps)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def huber_mean(pred: pd.Series, target: pd.Series, delta: pd.Series) -> float:
    """Mean robust loss of a group of scalar predictions."""
    return float(huber_terms(pred.to_numpy(), target.to_numpy(), delta.to_numpy()).mean())


MEMBER = T.StructType([T.StructField("member", T.StringType()),
                       T.StructField("size", T.LongType())])


@F.udtf(returnType=MEMBER)
class ArchiveMembers:
    """SQL table function: the video members of one archive."""

    def eval(self, path: str):
        yield from list_members(path)


def register(spark: SparkSession) -> None:
    spark.udf.register("psi", psi)
    spark.udf.register("huber_mean", huber_mean)
    spark.udtf.register("archive_members", ArchiveMembers)
