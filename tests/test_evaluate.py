import numpy as np
import pytest

from vecframe.operators import evaluate as ev
from vecframe.operators.spectrum import frame_spectrum


@pytest.fixture
def lists(spark):
    return lambda rows: spark.createDataFrame(list(rows.items()), "qid long, neighbors array<long>")


def test_recall_counts_short_and_missing_lists(lists):
    truth = lists({0: [1, 2, 3], 1: [4, 5, 6], 2: [7, 8, 9]})
    found = lists({0: [3, 1, 99], 1: [4]})
    row = ev.recall_at_k(found, truth, 2).first()
    assert (row.k, row.queries) == (2, 3)
    assert row.recall == pytest.approx((1 + 1 + 0) / 6)


def test_positional_match(lists):
    truth, found = lists({0: [1, 2, 3], 1: [4, 5, 6]}), lists({0: [1, 3, 3], 1: [5, 5]})
    assert ev.positional_match(found, truth, 3).first().match_rate == pytest.approx(3 / 6)
    assert ev.positional_match(found, truth, 2).first().match_rate == pytest.approx(2 / 4)


def test_recall_of_first_neighbour(lists):
    truth = lists({0: [1], 1: [2], 2: [3]})
    found = lists({0: [1, 9], 1: [8, 2], 2: [4, 5]})
    rows = {r["at"]: r.recall for r in ev.recall_first_nn(found, truth, 99).collect()}
    assert rows == {1: pytest.approx(1 / 3), 10: pytest.approx(2 / 3)}


def test_partition_coverage(spark, lists):
    parts = spark.createDataFrame([(10, 1), (11, 1), (12, 0)], "id long, part int")
    rows = {r["rank"]: r for r in ev.partition_coverage(lists({0: [10, 11]}), parts, 3, 2).collect()}
    assert [rows[i].neighbors for i in (1, 2, 3)] == [0, 0, 2]
    assert [rows[i].nonzero for i in (1, 2, 3)] == [0, 0, 1]
    assert rows[3].share == 1.0
    rows = {r["rank"]: r for r in ev.partition_coverage(
        lists({0: [10, 11, 12], 1: [12, 10, 5]}), parts, 3, 3).collect()}
    assert [rows[i].neighbors for i in (1, 2, 3)] == [0, 2, 3]


def reference_frame(x, n_fft, win, hop, frame, center=True):
    window = np.zeros(n_fft)
    left = (n_fft - win) // 2
    window[left:left + win] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / win)
    y = np.pad(x, n_fft // 2, mode="reflect") if center else x
    return np.abs(np.fft.rfft(y[frame * hop:frame * hop + n_fft] * window))


def test_spectrum(spark):
    rng = np.random.default_rng(0)
    signals = {0: rng.normal(size=2000), 1: rng.normal(size=900), 2: rng.normal(size=100), 3: None, 4: rng.normal(size=2000)}
    df = spark.createDataFrame(
        [(i, None if x is None else x.tolist()) for i, x in signals.items()], "id long, samples array<double>"
    )
    for options in ({}, {"frame": 2}, {"n_fft": 64, "win_length": 64, "hop_length": 16, "frame": 5, "center": False}):
        got = {r.id: r.spectrum for r in frame_spectrum(df, **options).collect()}
        full = {"n_fft": 256, "win_length": 80, "hop_length": 400, "frame": 0, **options}
        for i in (0, 1, 4):
            want = reference_frame(
                signals[i], full["n_fft"], full["win_length"], full["hop_length"], full["frame"],
                full.get("center", True),
            )
            assert len(got[i]) == full["n_fft"] // 2 + 1
            np.testing.assert_allclose(got[i], want, atol=1e-9)
        assert got[3] is None
    assert {r.id: r.spectrum for r in frame_spectrum(df).collect()}[2] is None


def test_spectrum_checks_the_window(spark):
    with pytest.raises(ValueError):
        frame_spectrum(spark.range(1), win_length=400, hop_length=80)
