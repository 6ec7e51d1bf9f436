"""Helpers the training-data operators share."""

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from driftgate.session import materialize

ASCII_SPACE = r"[\x09-\x0D\x20]"


def text_or_empty(column="text"):
    return F.coalesce(F.col(column), F.lit(""))


def utf8(column="text"):
    """The text's bytes; empty for null."""
    return text_or_empty(column).cast("binary")


def shielded(df: DataFrame, *own):
    """The frame with all columns but `own` under neutral names, and the way back, so that an
    operator's working columns cannot clash with the input's."""
    names = {c: c if c in own else f"_column_{i}" for i, c in enumerate(df.columns)}

    def back(out, *more):
        return out.select(*[F.col(n).alias(c) for c, n in names.items() if c not in more], *more)

    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), back


def without(df: DataFrame, *names) -> DataFrame:
    """Drop columns, whatever the case of their names."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def offsets(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blockwise_groups(df: DataFrame, key: str, limit: int, name: str) -> DataFrame:
    """Rows of each `key` that can meet another row, with a `part` per piece of work.

    Keys with one row go. A key of at most `limit` rows is one part. A larger one is cut into
    chunks of about `limit` rows by the hash of the row, and every pair of chunks is a part, so
    any two of its rows meet in at least one part and no part holds more than about 2 * `limit`.
    """
    stored = materialize(df, name)
    counts = (stored.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"))
    counts = materialize(counts, f"{name}-counts")
    joined = stored.join(counts, key)
    chunks = F.ceil(F.col("_n") / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.col("_c")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_c") - 1),
        lambda other: F.least(own, other) * F.col("_c") + F.greatest(own, other))
    return (joined.withColumn("_c", chunks)
            .withColumn("part", F.explode(pairs)).drop("_n", "_c"))


def runs(*keys: np.ndarray):
    """Start and end of each run of equal neighbours."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], n)


def whole_groups(batches, keys):
    """Arrow tables that each hold whole runs of equal `keys`, from batches sorted by them."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        last = [table.column(k)[table.num_rows - 1].as_py() for k in keys]
        first = [table.column(k)[0].as_py() for k in keys]
        if first == last:
            held = table
            continue
        starts, _ = runs(*[table.column(k).to_numpy() for k in keys])
        cut = int(starts[-1])
        yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def log2_ceil(n) -> int:
    return max(0, math.ceil(math.log2(max(1, n))))
