"""Welch spectra as sums of products with a small table of tapered waves.

Removing a segment's mean and then projecting on ``taper * wave`` equals
projecting the untouched samples on the same wave minus its own mean. So the
table below holds mean-free tapered waves, and one ``sum(x * wave)`` per bin
gives the spectrum without any pass over the data to find means first. The
line removed by detrending enters the same way: as a multiple of the wave's
product with 0, 1, 2 ….
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.params import Band, JobParams

# Cosine-sum tapers: w(j) = a0 - a1 * cos(2*pi*j/n). Fixed values.
TAPERS = {"hamming": (0.54, 0.46), "hann": (0.5, 0.5), "boxcar": (1.0, 0.0)}

# Segment length of the spectrum unless a parameter says otherwise. Fixed value.
DEFAULT_N_FFT = 256

# Bins summed side by side in one aggregate; more bins go in further passes over the row.
BINS_PER_CHUNK = 32

# Up to this many bins of a spectrum are computed by one expression each.
MAX_WRITTEN_OUT = 16

# The wave table is broadcast; parameters that would make it larger than this are refused.
MAX_WAVE_TABLE_BYTES = 64 << 20


@dataclasses.dataclass(frozen=True)
class Bins:
    """The frequency bins and segments of one Welch estimate."""

    n: int
    hop: int
    segments: int
    sfreq: float
    ks: tuple[int, ...]
    taper: str

    @property
    def freqs(self) -> list[float]:
        return [k * self.sfreq / self.n for k in self.ks]

    @property
    def chunks(self) -> list[tuple[int, ...]]:
        return [
            self.ks[c : c + BINS_PER_CHUNK] for c in range(0, len(self.ks), BINS_PER_CHUNK)
        ]

    def within(self, band: Band) -> list[int]:
        """Positions of the band's bins; the upper edge is excluded."""
        return [p for p, f in enumerate(self.freqs) if band.fmin <= f < band.fmax]

    def waves(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean-free tapered cosines and sines, one row per bin."""
        a0, a1 = TAPERS[self.taper]
        j = np.arange(self.n)
        taper = a0 - a1 * np.cos(2 * np.pi * j / self.n)
        angle = 2 * np.pi * np.outer(np.array(self.ks), j) / self.n
        out = []
        for wave in (np.cos(angle), np.sin(angle)):
            tapered = wave * taper
            out.append(tapered - tapered.mean(axis=1, keepdims=True))
        return out[0], out[1]

    def scales(self) -> list[float]:
        """Per bin: one-sided density scale, averaged over segments."""
        a0, a1 = TAPERS[self.taper]
        j = np.arange(self.n)
        energy = float(np.sum((a0 - a1 * np.cos(2 * np.pi * j / self.n)) ** 2))
        return [
            (1.0 if k == 0 or 2 * k == self.n else 2.0) / (self.sfreq * energy * self.segments)
            for k in self.ks
        ]


def welch_bins(
    params: JobParams,
    n_times: int | None = None,
    fmin: float | None = None,
    fmax: float | None = None,
) -> Bins:
    """Bins in ``[fmin, fmax]``, both edges included, for epochs of ``n_times`` samples."""
    n_times = n_times or params.n_times
    n = min(params.n_fft or DEFAULT_N_FFT, n_times)
    hop = n - params.n_overlap
    if hop < 1:
        raise ValueError("n_overlap must be smaller than the segment length")
    if params.taper not in TAPERS:
        raise ValueError(f"unknown taper {params.taper!r}; choose one of {sorted(TAPERS)}")
    fmin = params.fmin if fmin is None else fmin
    fmax = params.fmax if fmax is None else fmax
    ks = tuple(k for k in range(n // 2 + 1) if fmin <= k * params.sfreq / n <= fmax)
    if not ks:
        raise ValueError(f"no frequency bin of length-{n} segments lies in [{fmin}, {fmax}] Hz")
    bins = Bins(n, hop, (n_times - n) // hop + 1, params.sfreq, ks, params.taper)
    if bins.n * len(ks) * 16 > MAX_WAVE_TABLE_BYTES:
        raise ValueError("n_fft and the band range ask for too large a wave table")
    return bins


def has_bins(params: JobParams, n_times: int) -> bool:
    """Whether a spectrum of ``n_times`` samples has a bin in the range of the bands."""
    n = min(params.n_fft or DEFAULT_N_FFT, n_times)
    return n > params.n_overlap and any(
        params.fmin <= k * params.sfreq / n <= params.fmax for k in range(n // 2 + 1)
    )


def wave_table(spark: SparkSession, bins: Bins) -> DataFrame:
    """``(_chunk, _jj, c0 …, s0 …)``: sized by the parameters alone, checked in ``welch_bins``."""
    a0, a1 = TAPERS[bins.taper]
    cos_mean, sin_mean = _wave_means(bins)
    turn = 2 * math.pi / bins.n
    taper = f"({a0}D - {a1}D * cos({turn!r}D * id))"
    width = len(bins.chunks[0])
    tables = []
    for c, ks in enumerate(bins.chunks):
        cols = []
        for p in range(width):
            if p < len(ks):
                at = c * BINS_PER_CHUNK + p
                # Reduce k*j modulo n first, so that the angle stays small and exact.
                angle = f"{turn!r}D * pmod(id * {ks[p]}L, {bins.n}L)"
                cols += [
                    f"{taper} * cos({angle}) - {cos_mean[at]!r}D AS c{p}",
                    f"{taper} * sin({angle}) - {sin_mean[at]!r}D AS s{p}",
                ]
            else:
                cols += [f"0D AS c{p}", f"0D AS s{p}"]
        tables.append(
            spark.range(0, bins.n, 1, 1).selectExpr(f"{c} AS _chunk", "id AS _jj", *cols)
        )
    table = tables[0]
    for more in tables[1:]:
        table = table.unionByName(more)
    return table


def _wave_means(bins: Bins) -> tuple[list[float], list[float]]:
    a0, a1 = TAPERS[bins.taper]
    j = np.arange(bins.n)
    taper = a0 - a1 * np.cos(2 * np.pi * j / bins.n)
    cos_mean, sin_mean = [], []
    for k in bins.ks:
        angle = 2 * np.pi * ((k * j) % bins.n) / bins.n
        cos_mean.append(float(np.mean(taper * np.cos(angle))))
        sin_mean.append(float(np.mean(taper * np.sin(angle))))
    return cos_mean, sin_mean


@dataclasses.dataclass(frozen=True)
class AnyLength:
    """Welch estimates of signals of any length, with one wave table for all of them.

    A signal shorter than ``segment`` is one segment of its own length. What depends on
    the length is SQL over a column of segment lengths.
    """

    segment: int
    overlap: int
    sfreq: float
    fmin: float
    fmax: float
    taper: str

    @classmethod
    def of(cls, params: JobParams) -> AnyLength:
        if params.taper not in TAPERS:
            raise ValueError(f"unknown taper {params.taper!r}; choose one of {sorted(TAPERS)}")
        segment = params.n_fft or DEFAULT_N_FFT
        if segment <= params.n_overlap:
            raise ValueError("n_overlap must be smaller than the segment length")
        return cls(segment, params.n_overlap, params.sfreq, params.fmin, params.fmax, params.taper)

    def freq(self, k: str, n: str) -> str:
        return f"({k} * {float(self.sfreq)!r}D / {n})"

    def ks(self, n: str) -> str:
        """The bins in the range of the bands, both edges included; empty if there is no segment."""
        kept = f"{self.freq('k', n)} BETWEEN {float(self.fmin)!r}D AND {float(self.fmax)!r}D AND {n} > {self.overlap}"
        return f"filter(sequence(0L, {n} div 2), k -> {kept})"

    def n_bins(self, n: int) -> int:
        if n <= self.overlap:
            return 0
        return sum(self.fmin <= k * self.sfreq / n <= self.fmax for k in range(n // 2 + 1))

    @property
    def width(self) -> int:
        """Bins summed side by side."""
        return max(1, min(BINS_PER_CHUNK, self.n_bins(self.segment)))

    @property
    def table_bytes(self) -> int:
        """Size of the wave table of all lengths (its bins counted to within one)."""
        per_sample = (min(self.fmax / self.sfreq, 0.5) - max(self.fmin, 0.0) / self.sfreq)
        chunks = (-(-int(n * per_sample + 1) // self.width) for n in range(1, self.segment + 1))
        return sum(n * c for n, c in enumerate(chunks, 1)) * self.width * 16

    def energy(self, n: str) -> str:
        """Sum of squares of the periodic taper."""
        a0, a1 = TAPERS[self.taper]
        return (
            f"({a0 * a0!r}D * {n} - {2 * a0 * a1!r}D * if({n} = 1, 1, 0)"
            f" + {a1 * a1!r}D * {n} * if({n} <= 2, 1D, 0.5D))"
        )

    def waves(self, lengths: DataFrame) -> DataFrame:
        """``(_n, _chunk, _jj, c0 …, s0 …)`` for the segment lengths ``_n`` of a table.

        Tapered waves less their means, which are 0 but for the cosines of bins 0 and 1.
        Bins beyond the last one are 0.
        """
        a0, a1 = TAPERS[self.taper]
        turn = f"({2 * math.pi!r}D / _n)"
        taper = f"({a0}D - {a1}D * cos({turn} * _jj))"
        rows = lengths.selectExpr("_n", f"{self.ks('_n')} AS _ks").where("size(_ks) > 0").selectExpr(
            "_n", f"posexplode(transform(sequence(0, (size(_ks) - 1) div {self.width}),"
            f" c -> slice(_ks, c * {self.width} + 1, {self.width}))) AS (_chunk, _own)"
        ).selectExpr("*", "explode(sequence(0L, _n - 1)) AS _jj")
        columns = []
        for p in range(self.width):
            k = f"get(_own, {p})"
            # Reduce k*j modulo n first, so that the angle stays small and exact.
            angle = f"{turn} * pmod(_jj * {k}, _n)"
            mean = (
                f"({a0}D * if(pmod({k}, _n) = 0, 1, 0) - {a1 / 2!r}D"
                f" * (if(pmod({k} - 1, _n) = 0, 1, 0) + if(pmod({k} + 1, _n) = 0, 1, 0)))"
            )
            columns.append(f"coalesce({taper} * cos({angle}) - {mean}, 0D) AS c{p}")
            columns.append(f"coalesce({taper} * sin({angle}), 0D) AS s{p}")
        return rows.selectExpr("_n", "_chunk", "_jj", *columns)

    def density(self, power: str, ks: str, n: str, segments: str) -> str:
        """The one-sided ``psd`` array from power summed over segments."""
        return (
            f"transform(slice({power}, 1, size({ks})), (v, p) -> v * if(get({ks}, p) = 0 OR 2 * get({ks}, p) = {n}, 1, 2)"
            f" / ({float(self.sfreq)!r}D * {self.energy(n)} * {segments}))"
        )

    def band_mean(self, band: Band) -> str:
        """SQL over ``psd``, ``ks`` and ``segment``: mean of the band's bins, null without any."""
        f = self.freq("get(ks, p)", "segment")
        part = f"filter(psd, (v, p) -> {f} >= {float(band.fmin)!r}D AND {f} < {float(band.fmax)!r}D)"
        return (
            f"aggregate({part}, named_struct('total', 0D, 'n', 0L),"
            " (a, v) -> named_struct('total', a.total + v, 'n', a.n + 1), a -> try_divide(a.total, a.n))"
        )


def ramp_products(bins: Bins) -> tuple[list[float], list[float]]:
    """Per bin: the waves' products with 0, 1, 2 …, which is what a unit slope adds."""
    cos_wave, sin_wave = bins.waves()
    j = np.arange(bins.n)
    return [float(v) for v in cos_wave @ j], [float(v) for v in sin_wave @ j]


def detrended_density(bins: Bins, power: list[str] | str, cross: list[str] | str | None) -> str:
    """SQL for the ``psd`` array from power summed over segments.

    ``cross`` holds the sums of products with the waves' ramp responses; with it
    the line of slope ``_m`` is taken out of the spectrum after the fact. Both are
    lists of columns or the name of an array. A few bins are written out; many
    are mapped, since their written-out code would be too long to be compiled.
    """
    ramp_cos, ramp_sin = ramp_products(bins)
    ramps = [(c * c + s * s) * bins.segments for c, s in zip(ramp_cos, ramp_sin, strict=True)]
    scales = bins.scales()

    def value(power: str, cross: str, ramp: str, scale: str) -> str:
        if not cross:
            return f"{power} * {scale}"
        return f"greatest({power} - 2 * _m * {cross} + _m * _m * {ramp}, 0D) * {scale}"

    if isinstance(power, list) and len(bins.ks) <= MAX_WRITTEN_OUT:
        out = [
            value(power[p], cross[p] if cross else "", f"{ramps[p]!r}D", f"{scales[p]!r}D")
            for p in range(len(bins.ks))
        ]
        return f"array({', '.join(out)})"

    def as_array(columns: list[str] | str) -> str:
        return columns if isinstance(columns, str) else f"array({', '.join(columns)})"

    def literal(values: list[float]) -> str:
        return f"array({', '.join(f'{v!r}D' for v in values)})"

    crossed = f"get({as_array(cross)}, p)" if cross else ""
    body = value("v", crossed, f"get({literal(ramps)}, p)", f"get({literal(scales)}, p)")
    return f"transform(slice({as_array(power)}, 1, {len(bins.ks)}), (v, p) -> {body})"


def array_total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def normalised(psd: Column) -> Column:
    """Each bin's share of the total over all retained bins; null where the total is 0."""
    total = F.nullif(array_total(psd), F.lit(0.0))
    return F.transform(psd, lambda p: p / total)


def bin_sum(positions: list[int]) -> str:
    """SQL over ``psd``: the sum of adjacent bins; null for a band without bins."""
    if not positions:
        return "cast(NULL AS double)"
    if len(positions) > MAX_WRITTEN_OUT:
        part = f"slice(psd, {positions[0] + 1}, {len(positions)})"
        return f"aggregate({part}, 0D, (total, p) -> total + p)"
    return "(" + " + ".join(f"get(psd, {p})" for p in positions) + ")"


def bin_mean(positions: list[int]) -> str:
    return f"({bin_sum(positions)} / {max(len(positions), 1)})"


def total_power(normal: Column) -> Column:
    return array_total(normal) / F.size(normal)


def total_energy(normal: Column) -> Column:
    return array_total(F.transform(normal, lambda p: p * p))


def spectral_entropy(psd: Column) -> Column:
    """``-sum(q * log2(q + 1e-12))`` with ``q`` the shares of the given bins."""
    return -array_total(F.transform(normalised(psd), lambda q: q * F.log2(q + F.lit(1e-12))))
