import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.operators import calibration as C
from driftgate.plans.calibrate import calibrate
from driftgate.sources.calibration import (
    guard, read_calibration, thresholds, with_calibration, write_calibration,
)

NAN = float("nan")


def test_static_rows_skip_unmeasured_motion_and_break_ties_in_scan_order(spark):
    rows = [("b", 0, "iid_sample", 1.0), ("a", 5, "iid_sample", 1.0), ("a", 1, "iid_sample", NAN),
            ("a", 2, "iid_sample", None), ("a", 3, "iid_sample", -1.0), ("a", 4, "other", 0.0),
            ("c", 0, "iid_sample", 0.5), ("c", 1, "iid_sample", 0.0)]
    df = spark.createDataFrame(rows, "file_path string, row_index long, tag string, m_flow double")
    top = [(x.file_path, x.row_index) for x in C.most_static(df, 3).collect()]
    assert top == [("c", 1), ("c", 0), ("a", 5)]
    assert C.most_static(df, 100).count() == 4
    files = {x.file_path: (x.rows, x.n_rows) for x in C.winners_by_shard(
        C.most_static(df, 4)).collect()}
    assert files == {"a": ([5], 1), "b": ([0], 1), "c": ([0, 1], 2)}


def test_sufficiency_and_guard(spark):
    few = spark.createDataFrame([(i, 1.0) for i in range(99)], "id int, l1 double")
    assert not C.sufficiency(few, ["id"]).first().sufficient
    enough = few.union(spark.createDataFrame([(99, 1.0)], few.schema))
    assert C.sufficiency(enough, ["id"]).first().sufficient
    empty = few.limit(0)
    assert tuple(C.sufficiency(empty, ["id"]).first()) == (0, 0, False)
    assert guard(few).first().n == 99
    with pytest.raises(RuntimeError):
        guard(empty)
    with pytest.raises(ValueError):
        guard(few.withColumn("l1", F.lit(NAN)))


def record(spark):
    psi = spark.createDataFrame([(float(i),) for i in range(11)], "psi double")
    eps = spark.createDataFrame([(0.5,)], "epsilon double")
    return C.calibration_record(eps, eps.agg(F.count("*")), C.psi_stats(psi))


def test_record_roundtrip(spark, tmp_path):
    path = str(tmp_path / "calibration")
    with pytest.raises(FileNotFoundError):
        read_calibration(spark, path)
    write_calibration(record(spark), path)
    back = read_calibration(spark, path)
    assert thresholds(back) == (0.5, 2.0)
    stats = back.first().psi_stats
    assert stats.mean == 5.0 and stats["std"] == pytest.approx(np.std(np.arange(11)))
    assert (stats.p20, stats.p50, stats.p80) == (2.0, 5.0, 8.0)
    out = with_calibration(spark.range(3), back).collect()
    assert [(x.epsilon, x.tau) for x in out] == [(0.5, 2.0)] * 3


def test_early_stop_value_overrides_tau(spark):
    psi = spark.createDataFrame([(1.0,), (2.0,)], "psi double")
    one = spark.createDataFrame([(7.0,)], "v double")
    out = C.calibration_record(one, one.agg(F.count("*")), C.psi_stats(psi), gate=one).first()
    assert out.tau_kinetic_gate == 7.0 and out.psi_stats.p20 == pytest.approx(1.2)


def brute_by_row(values, step, tol, min_n):
    history = []
    for n in range(step, len(values) + 1, step):
        history.append(np.percentile(values[:n], 20))
        if n >= min_n and len(history) >= 3:
            if abs(history[-1] - history[-2]) < tol and abs(history[-2] - history[-3]) < tol:
                return True, n, history[-1]
    return False, None, np.percentile(values, 20)


@pytest.mark.parametrize("tol,min_n", [(0.05, 100), (0.05, 300), (1e-9, 100)])
def test_row_stop(spark, tol, min_n):
    values = np.random.default_rng(3).exponential(size=640)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, psi double")
    points = C.tau_checkpoints(df, ["i"], step=50)
    got = C.converge_by_row(points, C.tau(df), tol, min_n).first()
    want = brute_by_row(values, 50, tol, min_n)
    assert (got.converged, got.n_samples) == want[:2]
    assert got.tau == pytest.approx(want[2])
    assert points.count() == 12


def brute_by_file(files, step, tol, patience):
    seen, mark, previous, streak = [], step, 0.0, 0
    for values in files:
        if not values:
            continue
        seen += values
        if len(seen) >= mark:
            current = np.percentile(seen, 20)
            streak = streak + 1 if abs(current - previous) < tol else 0
            previous, mark = current, mark + step
            if streak >= patience:
                return True, len(seen), current
    return False, None, np.percentile(seen, 20)


@pytest.mark.parametrize("seed", range(4))
def test_file_stop_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    files = [[rng.expovariate(1.0) for _ in range(rng.choice([0, 3, 10, 60, 130]))]
             for _ in range(25)]
    rows = [(f, v) for f, values in enumerate(files) for v in values]
    df = spark.createDataFrame(rows, "file int, psi double")
    tol = [0.001, 0.05, 0.1, 0.5][seed]
    got = C.converge_by_file(C.file_checks(df, "file", 40), C.tau(df), tol).first()
    want = brute_by_file(files, 40, tol, 3)
    assert (got.converged, got.n_samples) == want[:2]
    assert got.tau == pytest.approx(want[2])


def test_first_check_is_compared_with_zero(spark):
    checks = spark.createDataFrame([(0, 10, 0.0), (1, 20, 0.0), (2, 30, 0.0)],
                                   "pos long, n_samples long, tau double")
    final = spark.createDataFrame([(9.0,)], "tau double")
    assert C.converge_by_file(checks, final, 1e-4).first().n_samples == 30
    moved = checks.withColumn("tau", F.col("tau") + 1)
    got = C.converge_by_file(moved, final, 1e-4).first()
    assert (got.converged, got.tau) == (False, 9.0)


def test_checkpoints_state_what_came_before(spark):
    values = np.random.default_rng(8).exponential(size=230) + 1e6
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, psi double")
    points = C.tau_checkpoints(df, ["i"], step=50, stats=True).collect()
    assert sorted(x.n_samples for x in points) == [50, 100, 150, 200]
    for x in points:
        seen = values[:x.n_samples]
        assert x.tau == x.p20 == pytest.approx(np.percentile(seen, 20))
        assert (x.p50, x.p80) == pytest.approx(tuple(np.percentile(seen, [50, 80])))
        assert x["mean"] == pytest.approx(seen.mean()) and x["std"] == pytest.approx(seen.std(), rel=1e-6)


@pytest.mark.parametrize("policy,tol", [("exact", 1.0), ("row", 0.2), ("row", 0.0), ("file", 0.2),
                                        ("file", 0.0)])
def test_calibration_at_a_stop(spark, policy, tol):
    rng = np.random.default_rng(6)
    rows, by_file = [], []
    for f in range(9):
        own = rng.exponential(size=(40 + 7 * f, 3))
        rows += [(f"shard_{f}", i, "iid_sample", float(i if f == 0 else -1), v.tolist())
                 for i, v in enumerate(own)]
        by_file.append(own)
    df = spark.createDataFrame(rows, "file_path string, row_index long, tag string, m_flow double, "
                                     "l1 array<double>").repartition(4)
    got = calibrate(df, n_static=10, policy=policy, step=30, tol=tol, min_samples=90).first()
    eps = np.percentile(by_file[0][:10], 95)
    psis = [np.maximum(0, own - eps).sum(axis=1) for own in by_file]
    everything = np.concatenate(psis)
    if policy == "row":
        stopped, n, gate = brute_by_row(everything, 30, tol, 90)
    elif policy == "file":
        stopped, n, gate = brute_by_file([p.tolist() for p in psis], 30, tol, 3)
    else:
        stopped, n, gate = False, None, np.percentile(everything, 20)
    assert stopped == (policy != "exact" and tol > 0)
    used = everything[:n] if stopped else everything
    assert n is None or n < len(everything)
    assert got.epsilon_noise_floor == pytest.approx(eps) and got.tau_kinetic_gate == pytest.approx(gate)
    assert (got.samples_used_for_epsilon, got.samples_used_for_tau) == (10, len(used))
    assert [got.psi_stats[c] for c in ("mean", "std", "p20", "p50", "p80")] == pytest.approx(
        [used.mean(), used.std(), *np.percentile(used, [20, 50, 80])])


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        calibrate(spark.range(1), policy="soon")
