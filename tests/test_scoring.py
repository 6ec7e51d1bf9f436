import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.operators import scoring as S
from driftgate.operators.evaluation import huber_loss
from driftgate.operators.frames import shift_pairs
from driftgate.plans.evaluate import evaluate, fixed_delta
from driftgate.schema import LATENT

SHAPE, GRID, C = (6, 3, 2, 2), (3, 2), 2
PAIRS = 4


def weights(seed=0):
    rng = np.random.default_rng(seed)
    return S.Weights(rng.normal(size=(C, 3, 3, 3)), rng.normal(size=C), rng.normal(size=(C, C)),
                     rng.normal(size=C), rng.normal(size=2 * C), 0.1)


def tensors(n=3):
    return np.random.default_rng(9).normal(size=(n, *SHAPE)).astype(np.float32)


def frames(spark, z):
    rows = [(i, 0, t, x[t].ravel().tolist()) for i, x in enumerate(z) for t in range(len(x))]
    return spark.createDataFrame(rows, "seq_id long, start long, t long, z array<float>")


def latents(spark, z):
    rows = [("f", "w", i, 0, "iid_sample", 0.0, bytearray(x.tobytes())) for i, x in enumerate(z)]
    return spark.createDataFrame(rows, LATENT).withColumn("batch_id", F.col("video_index") % 2)


@pytest.mark.parametrize("causal", [True, False])
def test_prediction_forms_agree(spark, causal):
    z, w = tensors(), weights()
    got = S.predict(frames(spark, z), "z", w, GRID, causal).collect()
    for x in got:
        want = S.predict_array(z[x.seq_id].astype(float), w, causal)[x.t].ravel()
        assert x.pred == pytest.approx(want.tolist(), rel=1e-9)


@pytest.mark.parametrize("causal", [True, False])
def test_stencil_by_hand(spark, causal):
    z = tensors(1)
    w = weights()
    got = {x.t: x.conv for x in S.stencil(frames(spark, z), "z", w.depthwise, w.depthwise_bias,
                                          GRID, causal).collect()}
    for t, y, x, c in np.ndindex(SHAPE):
        total = w.depthwise_bias[c]
        for k, dy, dx in np.ndindex(3, 3, 3):
            at, yy, xx = t + (k - 2 if causal else k), y + dy - 1, x + dx - 1
            if 0 <= at < SHAPE[0] and 0 <= yy < SHAPE[1] and 0 <= xx < SHAPE[2]:
                total += w.depthwise[c, k, dy, dx] * float(z[0, at, yy, xx, c])
        assert got[t][(y * GRID[1] + x) * C + c] == pytest.approx(total)


def test_closed_gate_returns_the_input(spark):
    z, w = tensors(1), weights()
    w.gate, w.gate_bias = np.zeros(2 * C), -800.0
    for x in S.predict(frames(spark, z), "z", w, GRID).collect():
        assert x.pred == pytest.approx(z[0][x.t].ravel().tolist())


def test_score_equals_pairs_and_loss(spark):
    z, delta = tensors(), 0.7
    scored = S.score(latents(spark, z), ["video_index"], delta, shape=SHAPE, pairs=PAIRS)
    got = {(x.video_index, x.direction): x.loss for x in scored.collect()}
    pairs = shift_pairs(frames(spark, z), "z", PAIRS).withColumnRenamed("seq_id", "batch_id")
    want = huber_loss(pairs, delta, "input", positions=GRID[0] * GRID[1])
    assert len(got) == 6
    for x in want.collect():
        assert got[(x.batch_id, x.direction)] == pytest.approx(x.loss, rel=1e-5)


def test_score_uses_each_direction_own_weights(spark):
    z, p, q = tensors(1), weights(1), weights(2)
    got = {x.direction: x.loss for x in S.score(
        latents(spark, z), [], 0.5, p, q, SHAPE, PAIRS, np.float64).collect()}
    x = z[0].astype(float)

    def loss(pred, target):
        e = np.abs(pred - target)
        return np.where(e <= 0.5, 0.5 * e * e, 0.5 * (e - 0.25)).sum(-1).mean()
    assert got["fwd"] == pytest.approx(loss(S.predict_array(x[:4], p), x[1:5]))
    assert got["rev"] == pytest.approx(loss(S.predict_array(x[1:5], q, False), x[:4]))


def test_constant_latents_cost_nothing(spark):
    z = np.full((2, *SHAPE), 0.25, dtype=np.float32)
    out = S.score(latents(spark, z), ["video_index"], 0.1, shape=SHAPE, pairs=PAIRS).collect()
    assert [x.loss for x in out] == [0.0] * 4


def test_evaluation_plan(spark):
    z = tensors(5)
    batched = latents(spark, z)
    delta = fixed_delta(batched)
    sides = [z[[0, 2, 4]], z[[1, 3]]]
    want = np.sqrt(np.mean([s.astype(float).var(ddof=1) for s in sides]) + 1e-8)
    assert delta == pytest.approx(want)
    row = evaluate(batched, 4, shape=SHAPE, pairs=PAIRS).first()
    assert row.n_steps == 2 and row.mean_requested == pytest.approx(row.mean_actual / 2)


def test_neighbours(spark):
    values = np.random.default_rng(2).normal(size=(3, 4, 2))
    kernel = [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    path_rows = [(i, (values * i).ravel().tolist()) for i in range(3)] + [(9, None)]
    df = spark.createDataFrame(path_rows, "i int, v array<double>")
    out = S.neighbor_sum(df, "v", kernel, (3, 4), 2)
    assert "Exchange" not in out._jdf.queryExecution().toString()
    padded = np.pad(values, ((1, 1), (1, 1), (0, 0)))
    for row in out.collect():
        if row.i == 9:
            assert row.total is None
            continue
        for y, x, c in np.ndindex(values.shape):
            window = row.i * padded[y:y + 3, x:x + 3, c]
            assert row.total[(y * 4 + x) * 2 + c] == pytest.approx((window * np.array(kernel)).sum())


def test_frames_of_another_size_are_refused(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    with pytest.raises(Exception, match="must have 12 values"):
        S.neighbor_sum(df, "v", np.ones((3, 3)), (3, 4)).collect()


def test_kernels_hold_weights_and_a_slice_only(monkeypatch):
    """A full-width grid: dense matrices over all cells would be 24 * 24 * 768 squared values."""
    import tracemalloc
    grid, channels = (24, 24), 32
    z = np.random.default_rng(1).normal(size=(40, *grid, channels))
    weights = np.random.default_rng(2).normal(size=(3, 3, channels))
    step = 4
    tracemalloc.start()
    parts = [S.shifted_sum(z[i:i + step], weights) for i in range(0, len(z), step)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(np.concatenate(parts), S.shifted_sum(z, weights))
    assert peak < 1.3 * z.nbytes  # the result and some slices
