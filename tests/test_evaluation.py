import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.functions.expressions import huber
from driftgate.functions.udfs import huber_mean
from driftgate.operators import evaluation as E

SIGMA = "run string, step long, direction string, sigma double"


def sequential(values):
    delta, out = None, []
    for sigma in values:
        if delta is None:
            delta = sigma
        v = abs(sigma - delta) / (delta + 1e-8)
        beta = 0.50 + 0.49 * math.exp(-2.0 * v)
        delta = beta * delta + (1 - beta) * sigma
        out.append(delta)
    return out


RUNS = {"constant": [0.3] * 8, "spike": [0.2, 0.2, 5.0, 0.2, 0.2, 0.2], "single": [0.7],
        "long": [0.1 + 0.01 * (i % 13) for i in range(300)], None: [1.0, 2.0]}


def sigma_rows(spark, runs=RUNS):
    rows = [(r, i // 2, ("fwd", "rev")[i % 2], s) for r, v in runs.items()
            for i, s in enumerate(v)]
    return spark.createDataFrame(rows[::-1], SIGMA).repartition(5)


def test_adaptive_delta(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = E.adaptive_delta(sigma_rows(spark)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for run, values in RUNS.items():
        got = [x.delta for x in sorted((x for x in out if x.run == run),
                                       key=lambda x: (x.step, x.direction))]
        assert got == pytest.approx(sequential(values), rel=1e-12)


def test_modes(spark):
    sigmas = sigma_rows(spark, {"a": [1.0, 2.0, 3.0], "new": [0.5, 0.9]})
    trained = E.adaptive_delta(sigma_rows(spark, {"a": [1.0, 4.0]}))
    frozen = E.delta_for(sigmas, "frozen", trained=trained).collect()
    assert {(x.run, round(x.delta, 9)) for x in frozen} == {
        ("a", round(sequential([1.0, 4.0])[-1], 9)), ("new", 0.5)}
    fixed = E.delta_for(sigmas, "fixed", fixed=0.2).collect()
    assert {x.delta for x in fixed} == {0.2} and len(fixed) == 5
    assert E.delta_for(sigmas, "adaptive").count() == 5
    with pytest.raises(ValueError):
        E.delta_for(sigmas, "other")


def test_huber_forms_agree(spark):
    rng = np.random.default_rng(2)
    pred, target = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame(list(zip(pred.tolist(), target.tolist())),
                               "pred double, target double")
    by_columns = df.agg(F.avg(huber(F.col("pred"), F.col("target"), F.lit(0.8)))).first()[0]
    by_python = df.agg(huber_mean("pred", "target", F.lit(0.8))).first()[0]
    error = np.abs(pred - target)
    want = np.where(error <= 0.8, 0.5 * error ** 2, 0.8 * (error - 0.4)).mean()
    assert by_columns == pytest.approx(want) and by_python == pytest.approx(want)


def test_loss_sums_channels_and_averages_positions(spark):
    rows = [(0, "fwd", [0.0, 0.0], [1.0, 3.0]), (0, "fwd", [0.0, 0.0], [0.0, 0.0]),
            (0, "rev", [1.0, 1.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "batch_id long, direction string, pred array<double>, "
                                     "target array<double>")
    got = {x.direction: x.loss for x in E.huber_loss(df, 1.0).collect()}
    assert got == {"fwd": (0.5 + 2.5) / 2, "rev": 0.0}
    halves = {x.direction: x.loss for x in E.huber_loss(df, 1.0, positions=2).collect()}
    assert halves["fwd"] == 0.75


def test_mean_over_requested_and_real_steps(spark):
    df = spark.createDataFrame([(b, d, 1.0) for b in range(3) for d in ("fwd", "rev")],
                               "batch_id long, direction string, loss double")
    assert tuple(E.eval_summary(df, 6).first()) == (1.0, 2.0, 3)
    assert tuple(E.eval_summary(df, 2).first()) == (2.0, 2.0, 2)


def test_volatility(spark):
    values = [[1.0, 2.0], [4.0, 8.0]]
    df = spark.createDataFrame([(0, "fwd", v) for v in values],
                               "batch_id long, direction string, target array<double>")
    want = math.sqrt(np.var(np.ravel(values), ddof=1) + 1e-8)
    assert E.batch_sigma(df).first().sigma == pytest.approx(want)
    batches = spark.createDataFrame([(0, values[0]), (1, values[1]), (10, [0.0, 100.0])],
                                    "batch_id long, z array<double>")
    got = E.validation_delta(batches, "z").first()
    assert got.n_batches == 2
    assert got.delta == pytest.approx(math.sqrt((0.5 + 8.0) / 2 + 1e-8))


def stop(losses, patience):
    best, best_at, counter, last = math.inf, None, 0, 0
    for epoch, loss in enumerate(losses, 1):
        last = epoch
        if loss < best:
            best, best_at, counter = loss, epoch, 0
        else:
            counter += 1
            if counter >= patience:
                return best_at, last, True
    return best_at, last, False


@pytest.mark.parametrize("losses,patience", [
    ([5, 4, 3, 3, 3, 3, 1], 3), ([5, 4, 3, 2, 1], 3), ([1.0], 1), ([2, 2, 2], 2),
    ([float("nan")] * 4 + [1.0], 3), ([float("nan"), 3.0, 4.0, 2.0, 9.0, 9.0], 2),
    ([3, float("nan"), 2, 5, 5, 5, 5], 4)])
def test_early_stop(spark, losses, patience):
    rows = [("r", i, float(x)) for i, x in enumerate(losses, 1)]
    df = spark.createDataFrame(rows[::-1], "run string, epoch long, val_loss double")
    got = E.early_stop(df, patience).first()
    assert (got.best_epoch, got.last_epoch, got.stopped) == stop(losses, patience)


def test_merged_variance_does_not_cancel(spark):
    values = [np.random.default_rng(i).normal(1e5, 0.014, 50) for i in range(40)]
    parts = spark.createDataFrame(
        [(0, len(v), float(v.mean()), float(((v - v.mean()) ** 2).sum())) for v in values],
        "batch_id int, n long, mean double, m2 double")
    got = E.merge_moments(parts, ["batch_id"]).first()["var"]
    assert got == pytest.approx(np.concatenate(values).var(ddof=1), rel=1e-6)


def test_a_missing_volatility_is_nan():
    assert math.isnan(E.next_delta(1.0, None)) and math.isnan(E.next_delta(None, None))
