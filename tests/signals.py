"""Small recordings and their features by direct numpy definitions, for cross-checks."""

import numpy as np


def samples_df(spark, recordings):
    """``recordings``: {(subject, channel): {j: value} or sequence}."""
    rows = []
    for (subject, channel), values in recordings.items():
        items = values.items() if isinstance(values, dict) else enumerate(values)
        rows += [
            (subject, channel, int(j), None if v is None else float(v)) for j, v in items
        ]
    return spark.createDataFrame(rows, "SubjectID string, Electrode string, j long, value double")


def epochs_df(spark, signals):
    """``signals``: {(subject, epoch, channel): sequence}."""
    rows = [(*key, [float(v) for v in x]) for key, x in signals.items()]
    return spark.createDataFrame(
        rows, "SubjectID string, EpochID string, Electrode string, signal array<double>"
    )


def starts(n, params):
    times = np.arange(0, (n - 1) / params.sfreq - params.window_length, params.step_size)
    return [int(i * params.step_size * params.sfreq) for i in range(len(times))]


def line_removed(x):
    k = np.arange(len(x))
    return x - np.polyval(np.polyfit(k, x, 1), k)


def features(x):
    dx, ddx = np.diff(x), np.diff(x, n=2)
    mobility = np.sqrt(dx.var() / x.var())
    return {
        "Mean": x.mean(),
        "Std": x.std(),
        "Variance": x.var(),
        "RMS": np.sqrt(np.mean(x * x)),
        "HjorthMobility": mobility,
        "HjorthComplexity": np.sqrt(ddx.var() / dx.var()) / mobility,
    }


def welch(x, fs, n, hop, fmin, fmax):
    taper = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)
    spectra = []
    for s in range(0, len(x) - n + 1, hop):
        part = x[s : s + n]
        power = np.abs(np.fft.rfft((part - part.mean()) * taper)) ** 2 / (fs * np.sum(taper**2))
        power[1 : (n + 1) // 2] *= 2
        spectra.append(power)
    freqs = np.arange(n // 2 + 1) * fs / n
    keep = (freqs >= fmin) & (freqs <= fmax)
    return freqs[keep], np.mean(spectra, axis=0)[keep]
