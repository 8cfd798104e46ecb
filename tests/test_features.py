"""Features against numpy, on recordings that span several blocks, have gaps, or are degenerate."""

import numpy as np
import pytest
import signals as sg
from pyspark.sql import functions as F

from signalloom.functions import spectral
from signalloom.operators import epoching, quality, sliding
from signalloom.operators.channel_stats import channel_stats
from signalloom.params import EXTENDED_BANDS, Band, JobParams
from signalloom.plans import features as ft
from signalloom.sources.recordings import describe_recordings

PARAMS = JobParams(sfreq=100.0, window_length=1.0, step_size=0.127, n_fft=32, block_samples=200)


def recording(n, seed, offset=0.0, trend=0.0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return offset + trend * t + rng.normal(size=n) + np.sin(t / 3)


RECORDINGS = {
    ("s1", "A"): recording(731, 1, offset=500.0),
    ("s1", "B"): recording(700, 2, trend=0.5),
    ("s2", "A"): recording(150, 3),
    ("s3", "A"): recording(90, 4),  # shorter than one window
}


def expected(params, detrend=True):
    lengths = {}
    for (s, _), x in RECORDINGS.items():
        lengths[s] = min(lengths.get(s, len(x)), len(x))
    out = {}
    for (s, c), x in RECORDINGS.items():
        for i, start in enumerate(sg.starts(lengths[s], params)):
            part = x[start : start + params.n_times]
            out[s, f"ep-{i}", c] = sg.line_removed(part) if detrend else part
    return out


@pytest.mark.parametrize("block_samples", [150, 200, 1000])
@pytest.mark.parametrize(
    "change",
    [
        {},
        {"n_overlap": 20},
        {"n_fft": 101},
        {"detrend": False},
        {"step_size": 1.31},
        {"step_size": 0.5},
        {"taper": "hamming", "n_fft": 25, "bands": EXTENDED_BANDS[:3]},
    ],
)
def test_recording_features_match_numpy(spark, block_samples, change):
    params = PARAMS.replace(block_samples=block_samples, **change)
    samples = sg.samples_df(spark, RECORDINGS)
    bins = spectral.welch_bins(params)
    stats = ft.recording_stats(samples, describe_recordings(samples, params), params, bins=bins)
    rows = {(r.SubjectID, r.EpochID, r.Electrode): r for r in stats.collect()}
    want = expected(params, params.detrend)
    assert rows.keys() == want.keys()
    for key, x in want.items():
        for name, value in sg.features(x).items():
            assert rows[key][name] == pytest.approx(value, rel=1e-7, abs=1e-9), (key, name)
        freqs, psd = sg.welch(
            x, params.sfreq, bins.n, bins.hop, params.fmin, params.fmax
        )
        assert bins.freqs == pytest.approx(freqs)
        assert rows[key].psd == pytest.approx(psd, rel=1e-6, abs=1e-10), key


def test_ready_made_epochs_agree_with_recordings(spark):
    """The two routes to features: from slices as arrays, and straight from recordings."""
    samples = sg.samples_df(spark, RECORDINGS)
    recordings = describe_recordings(samples, PARAMS)
    bins = spectral.welch_bins(PARAMS)
    direct = ft.recording_stats(samples, recordings, PARAMS, bins=bins)
    sliced = epoching.detrend(ft.sliced_epochs(samples, recordings, PARAMS))
    other = channel_stats(sliced, ft.SLICED_KEYS, bins)
    a = {(r.SubjectID, r.EpochID, r.Electrode): r for r in direct.collect()}
    b = {(r.SubjectID, r.EpochID, r.Electrode): r for r in other.collect()}
    assert a.keys() == b.keys() and a
    for key in a:
        assert a[key].psd == pytest.approx(b[key].psd, rel=1e-7, abs=1e-12)
        for name in ft.ELECTRODE_FEATURES:
            assert a[key][name] == pytest.approx(b[key][name], rel=1e-7, abs=1e-9)


def test_more_bins_than_fit_side_by_side(spark):
    x = recording(300, 7)
    params = JobParams(
        sfreq=300.0, window_length=299 / 300, n_fft=150, n_overlap=30,
        bands=(Band("all", 0.0, 150.0),), detrend=False,
    )
    bins = spectral.welch_bins(params, 300)
    assert len(bins.chunks) == 3
    epochs = sg.epochs_df(spark, {("s", "ep-0", "A"): x})
    row = channel_stats(epochs, bins=bins).first()
    _, psd = sg.welch(x, 300.0, 150, 120, 0, 150)
    assert row.psd == pytest.approx(psd, rel=1e-8, abs=1e-12)
    assert row.Std == pytest.approx(x.std())
    drifting = sg.epochs_df(spark, {("s", "ep-0", "A"): x + 0.1 * np.arange(300)})
    row = channel_stats(drifting, bins=bins, detrended=True).first()
    _, psd = sg.welch(sg.line_removed(x + 0.1 * np.arange(300)), 300.0, 150, 120, 0, 150)
    assert row.psd == pytest.approx(psd, rel=1e-6, abs=1e-10)


def test_gaps_cost_only_the_epochs_that_touch_them(spark):
    x = recording(400, 5)
    holes = {137, 138, 290}
    whole = {("s", "A"): {j: v for j, v in enumerate(x) if j not in holes}}
    samples = sg.samples_df(spark, whole)
    recordings = describe_recordings(samples, PARAMS)
    bins = spectral.welch_bins(PARAMS)
    stats = ft.recording_stats(samples, recordings, PARAMS, bins=bins)
    got = {r.EpochID: r for r in stats.collect()}
    want = {
        f"ep-{i}": sg.line_removed(x[s : s + PARAMS.n_times])
        for i, s in enumerate(sg.starts(400, PARAMS))
        if not holes & set(range(s, s + PARAMS.n_times))
    }
    assert got.keys() == want.keys() and want
    for key, part in want.items():
        for name, value in sg.features(part).items():
            assert got[key][name] == pytest.approx(value, rel=1e-7, abs=1e-9)
        _, psd = sg.welch(part, PARAMS.sfreq, bins.n, bins.hop, PARAMS.fmin, PARAMS.fmax)
        assert got[key].psd == pytest.approx(psd, rel=1e-6, abs=1e-10)
    kept = ft.kept_epochs(recordings, PARAMS)
    channels = samples.select("SubjectID", "Electrode").distinct()
    sliced = ft.sliced_epochs(samples, recordings, PARAMS)
    rejected = quality.rejected_epochs(sliced, kept, channels, PARAMS.n_times).collect()
    assert {r.EpochID for r in rejected} == {
        f"ep-{i}" for i in range(len(sg.starts(400, PARAMS)))
    } - want.keys()


DRIFTS = {
    ("ramp", "A"): lambda rng, n: 5.0 * np.arange(n) + 0.01 * rng.normal(size=n),
    ("fall", "A"): lambda rng, n: 1e6 - 3.0 * np.arange(n) + 0.01 * rng.normal(size=n),
    ("offset", "A"): lambda rng, n: 1e7 + rng.normal(size=n),
    ("walk", "A"): lambda rng, n: np.cumsum(rng.normal(size=n) * 20),
    ("growth", "A"): lambda rng, n: np.exp(np.arange(n) / n * 12) + rng.normal(size=n),
}


@pytest.mark.parametrize("detrend", [True, False])
@pytest.mark.parametrize("bins_wanted", [True, False])
def test_drifting_signals_agree_on_both_routes(spark, monkeypatch, detrend, bins_wanted):
    """Panes, slices and numpy give the same values however far a signal drifts."""
    params = PARAMS.replace(detrend=detrend, block_samples=1500)
    n = 5000
    recordings = {k: make(np.random.default_rng(9), n) for k, make in DRIFTS.items()}
    samples = sg.samples_df(spark, recordings)
    bins = spectral.welch_bins(params) if bins_wanted else None
    found = {}
    for route in (True, False):
        monkeypatch.setattr(sliding, "pays_off", lambda p, b, route=route: route)
        stats = ft.recording_stats(samples, describe_recordings(samples, params), params, bins=bins)
        found[route] = {(r.SubjectID, r.EpochID): r for r in stats.collect()}
    starts = sg.starts(n, params)
    assert found[True].keys() == found[False].keys()
    assert len(found[True]) == len(DRIFTS) * len(starts)
    for (subject, channel), x in recordings.items():
        for i, start in enumerate(starts):
            part = x[start : start + params.n_times]
            want = sg.features(sg.line_removed(part - part[0]) if detrend else part)
            a, b = (found[route][subject, f"ep-{i}"] for route in (True, False))
            for name in ft.ELECTRODE_FEATURES:
                assert a[name] == pytest.approx(b[name], rel=1e-6, abs=1e-9), (subject, i, name)
                assert a[name] == pytest.approx(want[name], rel=1e-4, abs=1e-7), (subject, i, name)
            if bins_wanted:
                assert a.psd == pytest.approx(b.psd, rel=1e-5, abs=1e-9)


def test_missing_value_rejects_and_nan_propagates(spark):
    x = list(recording(130, 6))
    with_null = dict(enumerate(x)) | {60: None}
    with_nan = dict(enumerate(x)) | {60: float("nan")}
    samples = sg.samples_df(spark, {("null", "A"): with_null, ("nan", "A"): with_nan})
    recordings = describe_recordings(samples, PARAMS)
    long = ft.features_long(samples, recordings, PARAMS)
    assert {r.SubjectID for r in long.select("SubjectID").distinct().collect()} == {"nan"}
    stds = long.where("FeatureName = 'Std'").collect()
    assert stds and all(np.isnan(r.FeatureValue) for r in stds)
    means = long.where("FeatureName = 'Mean'").collect()
    assert means and all(np.isnan(r.FeatureValue) for r in means)


def test_flat_and_ramp_signals_have_no_hjorth(spark):
    flat, ramp = [7.25] * 300, [3.0 * j - 50 for j in range(300)]
    samples = sg.samples_df(spark, {("flat", "A"): flat, ("ramp", "A"): ramp})
    stats = ft.recording_stats(samples, describe_recordings(samples, PARAMS), PARAMS)
    rows = stats.collect()
    assert rows
    for r in rows:
        assert r.Std == pytest.approx(0.0, abs=1e-9)
        assert r.HjorthMobility is None and r.HjorthComplexity is None


def test_long_table_invariants(spark):
    samples = sg.samples_df(spark, RECORDINGS)
    recordings = describe_recordings(samples, PARAMS)
    long = ft.features_long(samples, recordings, PARAMS, table_type="electrode").cache()
    n = len(expected(PARAMS))
    assert long.count() == n * (5 + 3 * len(PARAMS.bands))
    assert {r.table_type for r in long.where("WaveBand IS NULL").collect()} == {"electrode"}
    assert {r.table_type for r in long.where("WaveBand IS NOT NULL").collect()} == {"band"}
    hjorth = long.where("FeatureName LIKE 'Hjorth%'").groupBy(
        "SubjectID", "EpochID", "Electrode", "FeatureName"
    )
    assert hjorth.agg(F.count_distinct("FeatureValue").alias("n")).where("n != 1").count() == 0
    bins = spectral.welch_bins(PARAMS)
    stats = ft.recording_stats(samples, recordings, PARAMS, bins=bins)
    sums = ft.psd_long(stats, bins, normalise=True).groupBy(*ft.EPOCH_KEYS, "Electrode").agg(
        F.sum("psd").alias("total")
    )
    assert all(r.total == pytest.approx(1.0) for r in sums.collect())


def test_sine_falls_into_its_band(spark):
    t = np.arange(64) / 64
    epochs = sg.epochs_df(spark, {("s", "ep-0", "A"): np.sin(2 * np.pi * 10 * t)})
    params = JobParams(sfreq=64.0, window_length=63 / 64, n_fft=64, detrend=False)
    long = ft.epochs_features_long(epochs, params)
    power = {r.WaveBand: r.FeatureValue for r in long.where("FeatureName = 'Power'").collect()}
    assert power["Alpha"] == max(power.values())
    assert power["Delta"] < 1e-12


def test_empty_band_is_null(spark):
    params = PARAMS.replace(n_fft=16, bands=(Band("none", 1.0, 2.0), Band("some", 5.0, 30.0)))
    samples = sg.samples_df(spark, RECORDINGS)
    long = ft.features_long(samples, describe_recordings(samples, params), params)
    rows = long.where("FeatureName = 'Power'").collect()
    assert {r.FeatureValue is None for r in rows if r.WaveBand == "none"} == {True}
    assert {r.FeatureValue is None for r in rows if r.WaveBand == "some"} == {False}


def test_parameters_are_checked():
    for bad in ({"method": "multitaper"}, {"step_size": 0.0}, {"bands": ()}):
        with pytest.raises(ValueError):
            JobParams(**bad)
    with pytest.raises(ValueError):
        Band("x", 4.0, 4.0)
    with pytest.raises(ValueError):
        spectral.welch_bins(PARAMS.replace(n_overlap=32))
    with pytest.raises(ValueError):
        spectral.welch_bins(PARAMS.replace(taper="unknown"))


def test_start_samples_are_truncated_products(spark):
    params = JobParams()
    row = spark.range(1).select(epoching.start_sample(F.lit(3), params).alias("s")).first()
    assert row.s == 449
    assert params.n_times == 1501


def test_band_power_over_many_bins(spark):
    x = recording(300, 8)
    params = JobParams(
        sfreq=100.0, window_length=2.99, n_fft=200, bands=(Band("low", 1.0, 3.0), Band("wide", 3.0, 30.0)),
        detrend=False,
    )
    long = ft.epochs_features_long(sg.epochs_df(spark, {("s", "e", "A"): x}), params)
    power = {r.WaveBand: r.FeatureValue for r in long.where("FeatureName = 'Power'").collect()}
    freqs, psd = sg.welch(x, 100.0, 200, 200, 1.0, 30.0)
    for name, lo, hi in (("low", 1, 3), ("wide", 3, 30)):
        want = psd[(freqs >= lo) & (freqs < hi)].mean() / psd.sum()
        assert power[name] == pytest.approx(want, rel=1e-9)
