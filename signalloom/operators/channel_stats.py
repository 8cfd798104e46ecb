"""One pass over the samples of each (epoch, channel): all sums the features need.

The signal array is exploded inside whole-stage codegen (neighbouring samples
are read from the array, so differences need no window), joined with the small
wave table, and summed per Welch segment and then per channel-epoch. An epoch's
samples come from one input row, so the partial aggregate already reduces them
to one row per segment before anything is shuffled; for ``slice_epochs`` output
nothing is shuffled at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.functions import moments, spectral
from signalloom.functions.spectral import AnyLength, Bins


def channel_stats(
    epochs: DataFrame,
    keys: Sequence[str] = ("SubjectID", "EpochID"),
    bins: Bins | None = None,
    detrended: bool = False,
    shape: bool = False,
) -> DataFrame:
    """Features per (keys, Electrode), plus the absolute spectrum ``psd`` if ``bins`` are given.

    ``detrended`` gives the features of the signal minus its least-squares line
    without computing that signal. Shape features need the real samples, so
    apply ``epoching.detrend`` first if both are wanted.
    """
    if shape and detrended:
        raise ValueError("shape features need a signal that is already detrended")
    keys = [*keys, "Electrode"]
    terms = moments.SAMPLE_TERMS | (moments.SHAPE_TERMS if shape else {})
    rows = epochs.selectExpr(*keys, "signal", "posexplode(signal) AS (_j, _x)")
    if bins is None:
        sums = rows.groupBy(*keys).agg(*_sums(terms))
    else:
        sums = _spectral_sums(rows, keys, bins, terms, detrended)
    sums, names = _features(sums, detrended, shape)
    return sums.select(*keys, "n", *names, *(["psd"] if bins is not None else []))


def any_length_stats(
    epochs: DataFrame, spectrum: AnyLength, keys: Sequence[str] = ("SubjectID", "EpochID")
) -> DataFrame:
    """Features and spectra of signals of any length, in one pass and one plan.

    Each signal has the spectrum of its own length, or of segments of ``spectrum.segment``
    samples if it is longer: ``psd``, its bins ``ks`` and their ``segment`` length.
    Signals without a bin in range yield no row; samples must not be null. The wave table
    is keyed by length and joined to samples that carry theirs. It is sized by the
    parameters; where that is too much to broadcast, it is cut to the lengths that occur.
    """
    keys = [*keys, "Electrode"]
    signals = epochs.selectExpr(*keys, "signal", f"cast(least(size(signal), {spectrum.segment}) AS bigint) AS _n")
    signals = signals.where(f"_n > 0 AND size({spectrum.ks('_n')}) > 0")
    if spectrum.table_bytes <= spectral.MAX_WAVE_TABLE_BYTES:
        lengths = epochs.sparkSession.range(1, spectrum.segment + 1).withColumnRenamed("id", "_n")
        waves = F.broadcast(spectrum.waves(lengths))
    else:
        waves = spectrum.waves(signals.select("_n").distinct())
    chunks = f"explode(sequence(0, (size({spectrum.ks('_n')}) - 1) div {spectrum.width})) AS _chunk"
    rows = signals.selectExpr("*", chunks).selectExpr("*", "posexplode(signal) AS (_j, _x)")
    hop = f"(_n - {spectrum.overlap})"
    rows, own = _split_segments(rows, "_n", hop, f"((size(signal) - _n) div {hop})", spectrum.overlap > 0)
    own = "_chunk = 0" + (f" AND {own}" if own else "")
    products = {}
    for p in range(spectrum.width):
        products[f"re{p}"] = f"{moments.OFFSET_FREE} * c{p}"
        products[f"im{p}"] = f"{moments.OFFSET_FREE} * s{p}"
    terms = moments.SAMPLE_TERMS
    per_segment = rows.join(waves, ["_n", "_chunk", "_jj"], "left").groupBy(*keys, "_chunk", "_seg").agg(
        *_sums(terms, own), *_sums(products)
    )
    powers = {f"pow{p}": f"re{p} * re{p} + im{p} * im{p}" for p in range(spectrum.width)}
    per_chunk = per_segment.groupBy(*keys, "_chunk").agg(*_sums({c: c for c in terms}), *_sums(powers))
    # A signal has a handful of chunks.
    sums = per_chunk.groupBy(*keys).agg(
        *_sums({c: c for c in terms}),
        F.expr(f"sort_array(collect_list(struct(_chunk, array({', '.join(powers)}) AS pow)))").alias("_chunks"),
    ).selectExpr("*", f"cast(least(n, {spectrum.segment}) AS bigint) AS segment")
    sums = sums.selectExpr("*", "flatten(_chunks.pow) AS _pow", f"{spectrum.ks('segment')} AS ks")
    segments = f"((n - segment) div (segment - {spectrum.overlap}) + 1)"
    sums = sums.selectExpr(*keys, *terms, "ks", "segment", f"{spectrum.density('_pow', 'ks', 'segment', segments)} AS psd")
    sums, names = _features(sums, False, False)
    return sums.select(*keys, "n", *names, "psd", "ks", "segment")


def _features(sums: DataFrame, detrended: bool, shape: bool) -> tuple[DataFrame, list[str]]:
    stages = moments.feature_stages(detrended, shape)
    for stage in stages:
        sums = sums.selectExpr("*", *[f"{sql} AS {name}" for name, sql in stage.items()])
    return sums, [name for stage in stages for name in stage if not name.startswith("_")]


def _sums(terms: dict[str, str], when: str | None = None) -> list:
    return [
        F.expr(f"sum({sql if when is None else f'if({when}, {sql}, NULL)'})").alias(name)
        for name, sql in terms.items()
    ]


def _split_segments(
    rows: DataFrame, n: str, hop: str, last: str, overlapping: bool
) -> tuple[DataFrame, str | None]:
    """Add the segment ``_seg`` of each sample and its place ``_jj`` there (-1 outside all).

    ``n``, ``hop`` and ``last`` (the last segment's number) are SQL. Overlapping segments
    repeat a sample; the second result is then the condition that holds for exactly one
    of the copies.
    """
    latest = f"least(_j div {hop}, {last})"
    if not overlapping:
        rows = rows.selectExpr("*", f"{latest} AS _seg")
        return rows.selectExpr(
            "*", f"if(_j - _seg * {hop} < {n}, _j - _seg * {hop}, -1L) AS _jj"
        ), None
    earliest = f"greatest(ceil((_j - ({n} - 1)) / {hop}), 0)"
    covered = f"_j < {last} * {hop} + {n}"
    rows = rows.selectExpr(
        "*", f"explode(if({covered}, sequence({earliest}, {latest}), array(cast({last} AS bigint)))) AS _seg"
    )
    return rows.selectExpr(
        "*", f"if({covered}, _j - _seg * {hop}, -1L) AS _jj"
    ), f"_seg = {latest}"


def _spectral_sums(rows, keys, bins, terms, detrended):
    rows, own = _split_segments(rows, str(bins.n), str(bins.hop), str(bins.segments - 1), bins.hop < bins.n)
    n_chunks = len(bins.chunks)
    width = len(bins.chunks[0])
    waves = spectral.wave_table(rows.sparkSession, bins)
    if n_chunks == 1:
        waves, on, chunk = waves.drop("_chunk"), ["_jj"], []
    else:
        rows = rows.selectExpr("*", f"explode(sequence(0, {n_chunks - 1})) AS _chunk")
        own = "_chunk = 0" + (f" AND {own}" if own else "")
        on, chunk = ["_chunk", "_jj"], ["_chunk"]
    products = {}
    for p in range(width):
        products[f"re{p}"] = f"{moments.OFFSET_FREE} * c{p}"
        products[f"im{p}"] = f"{moments.OFFSET_FREE} * s{p}"
    per_segment = (
        rows.join(F.broadcast(waves), on, "left")
        .groupBy(*keys, *chunk, "_seg")
        .agg(*_sums(terms, own), *_sums(products))
    )

    ramp_cos, ramp_sin = spectral.ramp_products(bins)

    def constant(values: list[float], p: int) -> str:
        """The constant of side-by-side position ``p``: a literal, or one per chunk."""
        at = [c * spectral.BINS_PER_CHUNK + p for c in range(n_chunks)]
        picked = [f"{values[a]!r}D" if a < len(values) else "0D" for a in at]
        return picked[0] if n_chunks == 1 else f"get(array({', '.join(picked)}), _chunk)"

    squares = {f"pow{p}": f"re{p} * re{p} + im{p} * im{p}" for p in range(width)}
    cross = {
        f"cross{p}": f"re{p} * {constant(ramp_cos, p)} + im{p} * {constant(ramp_sin, p)}"
        for p in range(width if detrended else 0)
    }
    moment_sums = {c: c for c in terms}
    sums = per_segment.groupBy(*keys, *chunk).agg(
        *_sums(moment_sums), *_sums(squares), *_sums(cross)
    )
    power = [f"pow{p}" for p in range(width)]
    crossed = list(cross)
    if n_chunks > 1:
        # One row per chunk so far; a channel-epoch has a handful of them.
        sums = sums.groupBy(*keys).agg(
            *_sums(moment_sums),
            F.expr(
                f"sort_array(collect_list(struct(_chunk, array({', '.join(power)}) AS pow,"
                f" cast(array({', '.join(crossed)}) AS array<double>) AS cross)))"
            ).alias("_chunks"),
        ).selectExpr(
            *keys, *terms, "flatten(_chunks.pow) AS _pow", "flatten(_chunks.cross) AS _cross"
        )
        power, crossed = "_pow", "_cross"

    psd = spectral.detrended_density(bins, power, crossed if detrended else None)
    return sums.selectExpr("*", f"{moments.SLOPE} AS _m").selectExpr(
        *keys, *terms, f"{psd} AS psd"
    )
