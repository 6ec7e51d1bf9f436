import random

import pytest
from pyspark.sql import functions as F

from driftgate.operators.ordering import first_n, index_rows


def skewed_rows(n=900, seed=1):
    """Rows (g, a, b): a third in one group, a null group, ties in `a`, unique `b`."""
    rng = random.Random(seed)
    keys = ["hot"] * (n // 3) + [None] * (n // 6)
    keys += [f"g{rng.randrange(20)}" for _ in range(n - len(keys))]
    rows = [(k, rng.randrange(30), b) for b, k in enumerate(keys)]
    rng.shuffle(rows)
    return rows


def expected(rows, grouped=True):
    seen, out = {}, {}
    for k, a, b in sorted(rows, key=lambda row: (row[1], row[2])):
        key = k if grouped else ""
        out[b] = seen.get(key, 0)
        seen[key] = out[b] + 1
    return out


@pytest.mark.parametrize("max_rows", [10_000, 200, 60, 7])
@pytest.mark.parametrize("grouped", [True, False])
def test_positions_do_not_depend_on_splitting(spark, max_rows, grouped):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "g string, a int, b int").repartition(5)
    out = index_rows(df, ["g"] if grouped else [], ["a", "b"], max_rows=max_rows)
    assert out.columns == ["g", "a", "b", "idx"]
    assert {x.b: x.idx for x in out.collect()} == expected(rows, grouped)


def test_row_bound_replaces_the_count(spark):
    df = spark.createDataFrame([("x", 1, 2), ("x", 0, 1)], "g string, a int, b int")
    out = index_rows(df, ["g"], ["a"], row_bound=2).collect()
    assert {x.b: x.idx for x in out} == {1: 0, 2: 1}


def test_split_pieces_keep_every_task_small(spark):
    rows = skewed_rows(1200)
    df = spark.createDataFrame(rows, "g string, a int, b int")
    out = index_rows(df, [], ["a", "b"], max_rows=100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(s["count"] for s in sizes) == 1200
    assert len(sizes) > 1


@pytest.mark.parametrize("n,salts", [(1, 4), (5, 64), (1000, 8)])
def test_first_n_with_a_hot_group(spark, n, salts):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "g string, a int, b int").repartition(6)
    out = first_n(df, ["g"], ["a", "b"], n, salts=salts)
    want = {b: p for b, p in expected(rows).items() if p < n}
    assert {x.b: x.pos for x in out.collect()} == want


def test_first_n_takes_n_from_a_column(spark):
    df = spark.createDataFrame([("x", i, 2) for i in range(5)]
                               + [("y", i, 3) for i in range(5)], "g string, a int, n int")
    out = first_n(df, ["g"], ["a"], F.col("n")).groupBy("g").count().collect()
    assert {x.g: x["count"] for x in out} == {"x": 2, "y": 3}
