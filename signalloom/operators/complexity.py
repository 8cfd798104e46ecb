"""Fractal dimensions and entropies of the signals of epochs.

The dimensions are sums over exploded samples, as the other time-domain features are.
The entropies count, for each stretch of samples, the stretches like it: those whose
first sample is near enough are a run in the order of first samples, so each row sorts
once and compares runs only; no pairs are made as rows and none is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPOCH_KEYS = ("SubjectID", "EpochID")
KMAX = 10
# Samples of a stretch, and how near is alike, in sample deviations of the signal.
STRETCH, TOLERANCE = 2, 0.2
# Pairs that are compared at once.
PAIRS = 1 << 20


def fractal_dimensions(
    epochs: DataFrame, keys: Sequence[str] = EPOCH_KEYS, kmax: int = KMAX
) -> DataFrame:
    """(keys, Electrode, HiguchiFD, KatzFD) of every signal.

    Higuchi: the mean length L(k) of the k curves through every k-th sample, for k up to
    ``kmax``, and the slope of log L(k) on log(1/k). Katz: log10(s) / (log10(s) +
    log10(d / L)) with s steps, the curve's length L and its farthest distance d from the
    first sample. Both are null for flat signals, and for those of ``kmax`` samples or
    fewer (Higuchi) or two (Katz). Null samples are left out of all sums.
    """
    keys = [*keys, "Electrode"]
    lengths = {}
    for k in range(1, kmax + 1):
        # The curve from _j % k on has so many steps; all k curves are averaged.
        steps = f"((size(signal) - 1 - _j % {k}) div {k})"
        weight = f"(size(signal) - 1D) / ({steps} * {k**3}D)"
        lengths[f"_l{k}"] = f"abs(get(signal, _j + {k}) - _x) * {weight}"
    rows = epochs.selectExpr(*keys, "signal", "posexplode(signal) AS (_j, _x)")
    sums = rows.groupBy(*keys).agg(
        F.expr("max(size(signal)) - 1").alias("_s"), F.expr("sum(abs(get(signal, _j + 1) - _x))").alias("_length"),
        F.expr("max(abs(_x - get(signal, 0)))").alias("_far"),
        *[F.expr(f"sum({sql})").alias(name) for name, sql in lengths.items()],
    )
    u = [-math.log(k) for k in range(1, kmax + 1)]
    mean = sum(u) / kmax
    squares = sum((v - mean) ** 2 for v in u)
    slope = " + ".join(f"{(v - mean) / squares!r}D * ln(nullif(_l{k}, 0D))" for k, v in enumerate(u, 1))
    katz = "try_divide(log10(_s), log10(_s) + log10(nullif(_far, 0D) / nullif(_length, 0D)))"
    return sums.selectExpr(*keys, f"{slope} AS HiguchiFD", f"{katz} AS KatzFD")


def neighbour_counts(x: np.ndarray, r: float, m: int) -> tuple[np.ndarray, np.ndarray, int]:
    """How many stretches of ``m``, and of ``m`` + 1, samples are like each one, itself included.

    The last number counts ordered pairs of different stretches of ``m`` samples that
    both have a sample behind them.
    """
    n = len(x) - m + 1
    order = np.argsort(x[:n], kind="stable")
    first = x[:n][order]
    low = np.searchsorted(first, first - r - abs(r) * 1e-9, "left")
    high = np.searchsorted(first, first + r + abs(r) * 1e-9, "right")
    short, long, both = np.zeros(n, np.int64), np.zeros(n - 1, np.int64), 0
    ends = np.cumsum(high - low)
    at = 0
    while at < n:
        # As many templates as hold about PAIRS candidates, one at least.
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        width = (high - low)[at:to]
        i = np.repeat(np.arange(at, to), width)
        j = np.arange(len(i)) - np.repeat(ends[at:to] - before - width, width) + np.repeat(low[at:to], width)
        i, j = order[i], order[j]
        alike = np.ones(len(i), dtype=bool)
        for k in range(m):
            alike &= np.abs(x[i + k] - x[j + k]) <= r
        i, j = i[alike], j[alike]
        short += np.bincount(i, minlength=n)
        inner = (i < n - 1) & (j < n - 1)
        i, j = i[inner], j[inner]
        both += int((i != j).sum())
        i = i[np.abs(x[i + m] - x[j + m]) <= r]
        long += np.bincount(i, minlength=n - 1)
        at = to
    return short, long, both


def signal_entropies(x: np.ndarray, m: int, tolerance: float) -> tuple[float | None, float | None]:
    """(sample entropy, approximate entropy); None where a logarithm has no argument."""
    if len(x) < m + 2 or not np.isfinite(x).all():
        return None, None
    short, long, both = neighbour_counts(x, tolerance * float(x.std(ddof=1)), m)
    alike = int(long.sum()) - len(long)
    sample = -math.log(alike / both) if alike else None
    approximate = float(np.mean(np.log(short / len(short))) - np.mean(np.log(long / len(long))))
    return sample, approximate


def entropies(
    epochs: DataFrame, keys: Sequence[str] = EPOCH_KEYS, m: int = STRETCH, tolerance: float = TOLERANCE
) -> DataFrame:
    """(keys, Electrode, SampleEntropy, ApproximateEntropy) of every signal, by the same counts.

    Stretches of ``m`` samples are alike if no sample differs by more than ``tolerance``
    sample deviations of the signal. Sample entropy is null where no longer stretches are
    alike; both are null for signals with missing or undefined samples, or fewer than
    ``m`` + 2 of them. A flat signal's entropies are 0.
    """
    keys = [*keys, "Electrode"]
    kinds = {f.name: f.dataType.simpleString() for f in epochs.schema if f.name in keys}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signals = batch.column("signal").to_pylist()
            found = [
                signal_entropies(np.array([math.nan if v is None else v for v in s or []]), m, tolerance) for s in signals
            ]
            columns = [batch.column(k) for k in keys]
            columns += [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "SampleEntropy", "ApproximateEntropy"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return epochs.select(*keys, "signal").mapInArrow(
        measure, f"{schema}, SampleEntropy double, ApproximateEntropy double"
    )
