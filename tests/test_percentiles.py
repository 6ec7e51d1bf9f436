import numpy as np
import pytest

from driftgate.operators.percentiles import exact_percentiles, prefix_percentiles

PROBS = {"p5": 0.05, "p20": 0.2, "p50": 0.5, "p100": 1.0}


def samples(kind, n=2000):
    rng = np.random.default_rng(7)
    if kind == "spread":
        return rng.normal(size=n)
    if kind == "ties":
        values = rng.integers(0, 5, size=n).astype(float)
        values[: n // 3] = 0.0
        return values
    if kind == "constant":
        return np.full(n, 3.25)
    return np.array([4.0])


@pytest.mark.parametrize("kind", ["spread", "ties", "constant", "single"])
@pytest.mark.parametrize("max_rows", [10_000, 50])
def test_both_ways_equal_the_linear_percentile(spark, kind, max_rows):
    values = samples(kind)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = exact_percentiles(df, "v", PROBS, max_rows=max_rows).first()
    for name, p in PROBS.items():
        assert row[name] == pytest.approx(np.percentile(values, 100 * p), abs=1e-12)


def test_further_aggregates_come_along_on_both_ways(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    for max_rows in (1000, 10):
        row = exact_percentiles(df, "v", {"p50": 0.5}, max_rows=max_rows,
                                more=[F.count("*").alias("n")]).first()
        assert (row.p50, row.n) == (50.0, 101)


def test_nulls_are_ignored_and_nan_is_largest(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    for max_rows in (100, 1):
        assert exact_percentiles(df, "v", {"p": 0.5}, max_rows=max_rows).first().p == 3.0


@pytest.mark.parametrize("pieces", [16, None])
@pytest.mark.parametrize("kind", ["spread", "ties"])
def test_prefixes(spark, kind, pieces):
    values = samples(kind, 730)
    step = 100
    rows = [(i // step, float(v)) for i, v in enumerate(values)]
    out = prefix_percentiles(spark.createDataFrame(rows, "block long, value double"),
                             {"tau": 0.2}, pieces=pieces).collect()
    assert sorted(x.block for x in out) == list(range(8))
    for x in out:
        prefix = values[: (x.block + 1) * step]
        assert x.n == len(prefix)
        assert x.tau == pytest.approx(np.percentile(prefix, 20), abs=1e-12)


@pytest.mark.parametrize("max_rows", [1, 100])
def test_no_values_give_one_row_on_both_ways(spark, max_rows):
    df = spark.createDataFrame([(None,)], "x double")
    got = exact_percentiles(df, "x", {"p": 0.5}, 2, max_rows).collect()
    assert [r.p for r in got] == [None]


def test_a_value_of_most_blocks_is_not_looked_up(spark):
    """With one value in every block, the look-up would be blocks times blocks."""
    rng = np.random.default_rng(7)
    rows = [(b, 0.0 if rng.random() < 0.6 else float(rng.exponential())) for b in range(120)
            for _ in range(12)]
    df = spark.createDataFrame(rows, "block long, value double")
    out = prefix_percentiles(df, {"p20": 0.2, "p90": 0.9})
    got = {x.block: (x.n, x.p20, x.p90) for x in out.collect()}
    for block in range(120):
        seen = [v for b, v in rows if b <= block]
        assert got[block] == pytest.approx((len(seen), *np.percentile(seen, [20, 90])))

    def joined(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return joined(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return joined(node.plan())
        children = node.children()
        own = node.metrics().apply("numOutputRows").value() if "from_block" in node.toString().split(
            "\n")[0] and "Join" in kind else 0
        return max([own, *(joined(children.apply(i)) for i in range(children.size()))])

    assert 0 < joined(out._jdf.queryExecution().executedPlan()) < 120 * 120
