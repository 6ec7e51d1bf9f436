import pytest
from pyspark.sql import functions as F

from driftgate.operators import frames as Fr


def sequence(spark, *lengths, value=None):
    rows = [(s, i, float(i * i) if value is None else value)
            for s, n in enumerate(lengths) for i in range(n)]
    return spark.createDataFrame(rows, "seq_id long, idx long, x double")


@pytest.mark.parametrize("size,stride", [(4, 4), (4, 2), (4, 3), (3, 5), (1, 1)])
def test_windows(spark, size, stride):
    lengths = (0, 3, 4, 11, 12)
    out = Fr.tubelets(sequence(spark, *lengths), size, stride).collect()
    want = {(s, start, t) for s, n in enumerate(lengths)
            for start in range(0, n - size + 1, stride) for t in range(size)}
    assert {(x.seq_id, x.start, x.t) for x in out} == want
    assert len(out) == len(want)
    assert all(x.idx == x.start + x.t for x in out)


def test_constant_sequence_does_not_move(spark):
    diffs = Fr.frame_diff(Fr.tubelets(sequence(spark, 8, value=2.5), 4), "x")
    scored = Fr.psi(Fr.frame_l1(diffs), 0.0).collect()
    assert [x.psi for x in scored] == [0.0, 0.0]


def test_difference_stays_inside_its_window(spark):
    diffs = Fr.frame_diff(Fr.tubelets(sequence(spark, 8), 4), "x").collect()
    assert {(x.start, x.t): x["diff"] for x in diffs} == {
        (0, 1): 1.0, (0, 2): 3.0, (0, 3): 5.0, (4, 1): 9.0, (4, 2): 11.0, (4, 3): 13.0}


def test_psi_counts_only_what_exceeds_the_floor(spark):
    diffs = Fr.frame_l1(Fr.frame_diff(Fr.tubelets(sequence(spark, 4), 4), "x"))
    assert Fr.psi(diffs, 3.0).first().psi == 2.0
    assert Fr.psi(diffs, F.lit(5.0)).first().psi == 0.0


def test_shift_leaves_the_last_frame_out(spark):
    windows = Fr.tubelets(sequence(spark, 32), 32)
    pairs = Fr.shift_pairs(windows, "x").collect()
    assert {x.t for x in pairs} == set(range(30)) and len(pairs) == 60
    for x in pairs:
        first, second = (x.input, x.target) if x.direction == "fwd" else (x.target, x.input)
        assert (first, second) == (float(x.t ** 2), float((x.t + 1) ** 2))


def test_channels_first(spark):
    rows = [(0, 0, t, [float(10 * t + c) for c in range(3)]) for t in (2, 0, 1)]
    df = spark.createDataFrame(rows, "seq_id long, start long, t long, z array<double>")
    out = {x.channel: x.series for x in Fr.channels_first(df, "z").collect()}
    assert out == {c: [float(c), 10.0 + c, 20.0 + c] for c in range(3)}


def test_duration_and_length(spark):
    df = spark.createDataFrame([(0,), (95,), (96,), (1000,)], "n long")
    out = [(x.n_frames, x.seconds) for x in Fr.with_duration(df, "n", 96).collect()]
    assert out == [(0, 0.0), (0, 0.0), (1, 0.25), (10, 2.5)]
    kept = Fr.min_length(sequence(spark, 3, 4, 5), 4).collect()
    assert {(x.seq_id, x.n_frames) for x in kept} == {(1, 4), (2, 5)}


def test_flow_and_prefilter(spark):
    df = spark.createDataFrame([(3.0, 4.0), (300.0, 400.0)], "u double, v double")
    assert Fr.flow_magnitude(df, "u", "v", 50.0).first().m_flow == 27.5
    diffs = Fr.frame_diff(Fr.tubelets(sequence(spark, 8), 4), "x")
    assert [x.start for x in Fr.prefilter_motion(diffs, 3.0).collect()] == [0]
