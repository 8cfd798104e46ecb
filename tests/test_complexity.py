"""Fractal dimensions and entropies against plain definitions."""

import math

import numpy as np
import pytest
import signals as sg

from signalloom.operators import complexity as cx


def higuchi(x, kmax):
    n, points = len(x), []
    for k in range(1, kmax + 1):
        lengths = []
        for m in range(k):
            steps = (n - 1 - m) // k
            total = sum(abs(x[m + i * k] - x[m + (i - 1) * k]) for i in range(1, steps + 1))
            lengths.append(total * (n - 1) / (steps * k) / k)
        points.append((math.log(1 / k), math.log(sum(lengths) / k)))
    return np.polyfit(*zip(*points, strict=True), 1)[0]


def entropies(x, m, r):
    n = len(x)
    near = lambda i, j, w: max(abs(x[i + k] - x[j + k]) for k in range(w)) <= r
    phi = []
    for w in (m, m + 1):
        count = n - w + 1
        phi.append(np.mean([math.log(sum(near(i, j, w) for j in range(count)) / count) for i in range(count)]))
    pairs = [(i, j) for i in range(n - m) for j in range(n - m) if i != j]
    short, long = (sum(near(i, j, w) for i, j in pairs) for w in (m, m + 1))
    return (-math.log(long / short) if long else None), phi[0] - phi[1]


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(11)
    walk = np.cumsum(rng.normal(size=90))
    return {"noise": rng.normal(size=70), "walk": walk, "ties": np.round(walk), "short": rng.normal(size=21)}


@pytest.mark.parametrize("kmax", [3, 10])
def test_dimensions(spark, signals, kmax):
    df = sg.epochs_df(spark, {("s", name, "A"): x for name, x in signals.items()})
    for r in cx.fractal_dimensions(df, kmax=kmax).collect():
        x = signals[r.EpochID]
        assert r.HiguchiFD == pytest.approx(higuchi(x, kmax), rel=1e-9)
        steps, far, length = len(x) - 1, np.abs(x - x[0]).max(), np.abs(np.diff(x)).sum()
        assert r.KatzFD == pytest.approx(math.log10(steps) / (math.log10(steps) + math.log10(far / length)))


@pytest.mark.parametrize("pairs", [7, 1 << 20])
@pytest.mark.parametrize("m", [1, 2, 3])
def test_entropies(signals, m, pairs, monkeypatch):
    monkeypatch.setattr(cx, "PAIRS", pairs)
    for x in signals.values():
        want = entropies(x, m, 0.2 * x.std(ddof=1))
        assert cx.signal_entropies(x, m, 0.2) == pytest.approx(want)


def test_odd_signals(spark):
    rows = [("s", "flat", "A", [2.0] * 30), ("s", "one", "A", [1.0]), ("s", "none", "A", []), ("s", "null", "A", None),
            ("s", "hole", "A", [1.0, None, 2.0, 5.0, 1.0]), ("s", "nan", "A", [1.0, math.nan, 2.0, 3.0, 1.0])]
    df = spark.createDataFrame(rows, "SubjectID string, EpochID string, Electrode string, signal array<double>")
    got = {r.EpochID: (r.SampleEntropy, r.ApproximateEntropy) for r in cx.entropies(df).collect()}
    assert got.pop("flat") == (0.0, 0.0)
    assert set(got) == {"one", "none", "null", "hole", "nan"} and set(got.values()) == {(None, None)}
    dims = {r.EpochID: (r.HiguchiFD, r.KatzFD) for r in cx.fractal_dimensions(df).collect()}
    assert dims["flat"] == (None, None) and dims["one"] == (None, None)
