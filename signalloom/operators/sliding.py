"""Features of overlapping epochs from sums over panes, without copying samples into epochs.

Consecutive epochs share most of their samples. The points where epochs and
their spectral segments begin and end cut a recording into panes; within a pane
no epoch boundary falls. Every sum an epoch needs is the sum over its panes, so
samples are reduced to one row per pane once, and only these rows are repeated
for the epochs that overlap. With a window of 3 s every 0.3 s that replaces
ten copies of each sample by ten copies of one row in about seventeen.

Spectra are additive as well if each pane is transformed with one common time
origin: moving the origin to a segment's start is a rotation per bin, the taper
is a weighted sum of three neighbouring bins (it is a raised cosine), and taking
out the segment's mean clears bin 0.

Samples are shuffled once, by ``(SubjectID, EpochBlock)``; every later step
groups by these columns and more, so nothing else moves.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.functions import moments, spectral
from signalloom.functions.spectral import TAPERS, Bins
from signalloom.operators import epoching
from signalloom.params import JobParams

BLOCK = ["SubjectID", "EpochBlock"]

# With fewer epochs than this over one sample, slicing costs no more than panes do.
MIN_OVERLAP = 3.0

# More bins or cuts than these make the code generated per row too long for the
# JVM to compile, and slicing is the faster way then.
MAX_BINS = spectral.MAX_WRITTEN_OUT
MAX_CUTS = 10


def pays_off(params: JobParams, bins: Bins | None) -> bool:
    """Panes need segments that do not overlap, and few enough columns for one row."""
    if params.n_times / params.stride < MIN_OVERLAP:
        return False
    few = bins is None or (bins.hop == bins.n and len(bins.ks) <= MAX_BINS)
    return few and len(_cuts(params, bins)) <= MAX_CUTS


def _start(i: str, params: JobParams) -> str:
    return f"cast((cast({i} AS double) * {params.step_size!r}D) * {params.sfreq!r}D AS bigint)"


def _guess(j: str, params: JobParams) -> str:
    return f"floor(({j} + 1) * {1 / params.stride!r}D)"


def _settle(j: str, guess: str, params: JobParams) -> str:
    """The last epoch that starts at or before ``j``, -1 if none, from a guess off by one at most."""
    return (
        f"if({j} < 0, -1L, {guess} + if({_start(f'({guess} + 1)', params)} <= {j}, 1L,"
        f" if({_start(guess, params)} <= {j}, 0L, -1L)))"
    )


def _latest(j: str, params: JobParams) -> str:
    return _settle(j, _guess(j, params), params)


def _cuts(params: JobParams, bins: Bins | None) -> list[int]:
    """Where panes end, counted from an epoch's start.

    The last two samples stand alone: no difference reaches past the epoch.
    """
    n = params.n_times
    cuts = {0, max(n - 2, 0), n - 1, n}
    if bins is not None:
        cuts |= {s * bins.n for s in range(1, bins.segments + 1)}
    return sorted(cuts)


def _waves(spark: SparkSession, bins: Bins) -> tuple[DataFrame, list[int]]:
    """Cosines and sines of the bins and their neighbours at every place of a segment."""
    ks = list(range(bins.ks[0] - 1, bins.ks[-1] + 2))
    turn = 2 * math.pi / bins.n
    cols = []
    for p, k in enumerate(ks):
        angle = f"{turn!r}D * pmod(id * {k}L, {bins.n}L)"
        # Never null, which Spark cannot see by itself; it keeps the generated code short.
        cols += [f"coalesce(cos({angle}), 0D) AS cos{p}", f"coalesce(sin({angle}), 0D) AS sin{p}"]
    return F.broadcast(spark.range(0, bins.n, 1, 1).selectExpr("id AS _place", *cols)), ks


def _with_pane(rows: DataFrame, params: JobParams, bins: Bins | None) -> DataFrame:
    """Label each sample with its pane: how many cuts lie at or before it.

    Worked out ahead of the sort, in two steps that stay apart: the code that is
    generated for the sums must remain small enough to be compiled.
    """
    cuts = _cuts(params, bins)
    guesses = [_guess(f"(j - {c})", params) + f" AS _g{c}" for c in cuts]
    label = " + ".join(_settle(f"(j - {c})", f"_g{c}", params) for c in cuts)
    # ``j`` is never null here; saying so keeps the code short.
    known = rows.withColumn("j", F.expr("coalesce(j, -1L)"))
    return known.selectExpr("*", *guesses).selectExpr(*rows.columns, f"{label} AS _pane")


def pane_sums(
    samples: DataFrame, params: JobParams, bins: Bins | None, n_samples: int | None = None
) -> DataFrame:
    """One row per pane of a channel: its first sample and the sums over its samples."""
    channel = [*BLOCK, "Electrode"]
    in_order = Window.partitionBy(*channel).orderBy("j")
    rows = _with_pane(epoching.deal_blocks(samples, params, n_samples), params, bins)
    rows = rows.select(
        *channel,
        "j",
        "value",
        "_pane",
        F.lag("_pane", 1).over(in_order).alias("_before"),
        F.when(F.lead("j", 1).over(in_order) == F.col("j") + 1, F.lead("value", 1).over(in_order))
        .alias("_x1"),
        F.when(F.lead("j", 2).over(in_order) == F.col("j") + 2, F.lead("value", 2).over(in_order))
        .alias("_x2"),
    )
    # Sums are taken relative to the pane's first sample, which keeps squares small
    # however far the signal drifts; the same order serves both windows.
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = "_before IS NULL OR _before <> _pane"
    rows = rows.selectExpr(
        "*",
        f"if({begins}, j, NULL) AS _begin",
        f"if(({begins}) AND NOT isnan(value), value, NULL) AS _begun",
    ).withColumns({
        "_begin": F.last("_begin", ignorenulls=True).over(so_far),
        "_level": F.last("_begun", ignorenulls=True).over(so_far),
    })
    rows = rows.selectExpr(
        *channel,
        "j",
        "coalesce(j - _begin, 0L) AS _k",
        "coalesce(_level, 0D) AS _level",
        "value - coalesce(_level, 0D) AS _d",
        "_x1 - value AS _dx",
        "_x2 - 2 * _x1 + value AS _ddx",
        "_pane",
    )
    sums = {
        "j0": "min(j)",
        "x0": "max(_level)",
        "n": "count(_d)",
        "s1": "sum(_d)",
        "s2": "sum(_d * _d)",
        "sj": "sum(_k * _d)",
        "dx1": "sum(_dx)",
        "dx2": "sum(_dx * _dx)",
        "ddx1": "sum(_ddx)",
        "ddx2": "sum(_ddx * _ddx)",
    }
    if bins is not None:
        waves, ks = _waves(rows.sparkSession, bins)
        rows = rows.withColumn("_place", F.expr(f"j % {bins.n}")).join(waves, "_place")
        for p in range(len(ks)):
            sums[f"re{p}"] = f"sum(_d * cos{p})"
            sums[f"im{p}"] = f"sum(_d * sin{p})"
    return rows.groupBy(*channel, "_pane").agg(
        *[F.expr(sql).alias(name) for name, sql in sums.items()]
    )


def _moved_waves(waves: list[str], bins: Bins | None) -> list[str]:
    """A pane's transforms after its level was raised by ``_up``.

    The transform of a constant over consecutive samples is a ratio of sines, turned to
    the middle of the pane.
    """
    out = []
    for name in waves:
        k = bins.ks[0] - 1 + int(name[2:])
        turn = math.pi * k / bins.n
        if k % bins.n == 0:
            moved = "n" if name[:2] == "re" else "0D"
        else:
            wave = "cos" if name[:2] == "re" else "sin"
            middle = f"{math.pi / bins.n!r}D * pmod((2 * j0 + n - 1) * {k}L, {2 * bins.n}L)"
            moved = f"sin({turn!r}D * n) / {math.sin(turn)!r}D * {wave}({middle})"
        out.append(f"{name} + _up * {moved} AS {name}")
    return out


def sliding_stats(
    samples: DataFrame,
    recordings: DataFrame,
    params: JobParams,
    bins: Bins | None = None,
    kept: DataFrame | None = None,
    n_samples: int | None = None,
) -> DataFrame:
    """Features (and spectrum) of every complete channel-epoch of the recordings."""
    n, size = params.n_times, params.epochs_per_block
    panes = pane_sums(samples, params, bins, n_samples)
    first = f"greatest({_latest(f'(j0 - {n})', params)} + 1, EpochBlock * {size})"
    last = f"least({_latest('j0', params)}, (EpochBlock + 1) * {size} - 1)"
    waves = [c for c in panes.columns if c[:2] in ("re", "im")]
    placed = (
        panes.selectExpr("*", f"{first} AS _first", f"{last} AS _last")
        .where("_first <= _last")
        .selectExpr("*", "explode(sequence(_first, _last)) AS i")
        .selectExpr("*", f"j0 - {_start('i', params)} AS _at")
    )
    epoch = [*BLOCK, "Electrode", "i"]
    # An epoch begins with a pane, whose level is the epoch's first sample: panes are
    # moved to that level, so what is squared never exceeds the epoch's own range.
    in_epoch = Window.partitionBy(*epoch).orderBy("j0")
    placed = placed.withColumn("_x0", F.first("x0").over(in_epoch)).selectExpr(
        *[c for c in placed.columns if c not in ("x0", *waves)],
        "_x0 AS x0",
        "x0 - _x0 AS _up",
        *_moved_waves(waves, bins),
    )
    terms = {
        "x0": "max(x0)",
        "n": "sum(n)",
        "s1": "sum(s1 + n * _up)",
        "s2": "sum(s2 + _up * (2 * s1 + n * _up))",
        # From the pane's start to the middle of the epoch.
        "sj": f"sum(sj + _up * n * (n - 1) / 2D + (_at - {(n - 1) / 2}D) * (s1 + n * _up))",
        "dx1": f"sum(if(_at < {n - 1}, dx1, NULL))",
        "dx2": f"sum(if(_at < {n - 1}, dx2, NULL))",
        "ddx1": f"sum(if(_at < {n - 2}, ddx1, NULL))",
        "ddx2": f"sum(if(_at < {n - 2}, ddx2, NULL))",
    }
    if bins is None:
        sums = placed.groupBy(*epoch).agg(*[F.expr(q).alias(c) for c, q in terms.items()])
    else:
        per_segment = placed.selectExpr(
            "*", f"least(_at div {bins.n}, {bins.segments}) AS _seg"
        ).groupBy(*epoch, "_seg").agg(
            *[F.expr(q).alias(c) for c, q in terms.items()],
            *[F.expr(f"coalesce(sum({c}), 0D)").alias(c) for c in waves],
        )
        sums = _combine_segments(per_segment, epoch, params, bins)
    complete = sums.where(F.col("n") == n)
    for stage in moments.feature_stages(params.detrend):
        complete = complete.selectExpr("*", *[f"{q} AS {c}" for c, q in stage.items()])
    if kept is None:
        grid = epoching.block_grid(recordings, params)
        named = complete.join(grid, BLOCK).where("i >= first AND i <= last").withColumn(
            "EpochID", epoching.epoch_id(F.col("i"))
        )
    else:
        # Joined by block, which the rows are already partitioned by, and looked up there.
        listed = epoching.block_epochs(kept, params).selectExpr(
            *BLOCK, "map_from_entries(transform(epochs, e -> (e.start, e.EpochID))) AS _ids"
        )
        named = complete.join(listed, BLOCK).withColumn(
            "EpochID", F.expr(f"_ids[{_start('i', params)}]")
        ).where("EpochID IS NOT NULL")
    names = [c for stage in moments.feature_stages(params.detrend) for c in stage]
    return named.select(
        *BLOCK,
        "EpochID",
        "Electrode",
        "n",
        *[c for c in names if not c.startswith("_")],
        *(["psd"] if bins is not None else []),
    )


def _combine_segments(
    per_segment: DataFrame, epoch: list[str], params: JobParams, bins: Bins
) -> DataFrame:
    """Turn pane transforms into tapered, mean-free segment spectra and add them up."""
    waves, ks = _waves(per_segment.sparkSession, bins)
    a0, a1 = TAPERS[bins.taper]
    turned = []
    for p, k in enumerate(ks):
        if k % bins.n == 0:
            # The segment's mean is removed.
            turned += [f"0D AS tr{p}", f"0D AS ti{p}"]
        else:
            turned += [
                f"re{p} * cos{p} + im{p} * sin{p} AS tr{p}",
                f"im{p} * cos{p} - re{p} * sin{p} AS ti{p}",
            ]
    tapered = []
    for q in range(len(bins.ks)):
        p = q + 1
        for part in ("tr", "ti"):
            tapered.append(
                f"{a0}D * {part}{p} - {a1 / 2}D * ({part}{p - 1} + {part}{p + 1}) AS {part[1]}{q}"
            )
    # The tail behind the last whole segment takes part in the moments only.
    whole = f"_seg < {bins.segments}"
    segments = (
        per_segment.withColumn(
            "_place", F.expr(f"({_start('i', params)} + _seg * {bins.n}) % {bins.n}")
        )
        .join(waves, "_place")
        .selectExpr(*epoch, "_seg", *moments.SAMPLE_TERMS, *turned)
        .selectExpr(*epoch, "_seg", *moments.SAMPLE_TERMS, *tapered)
    )
    ramp_cos, ramp_sin = spectral.ramp_products(bins)
    width = range(len(bins.ks))
    sums = {c: "max(x0)" if c == "x0" else f"sum({c})" for c in moments.SAMPLE_TERMS}
    for q in width:
        sums[f"pow{q}"] = f"sum(if({whole}, r{q} * r{q} + i{q} * i{q}, NULL))"
        if params.detrend:
            sums[f"cross{q}"] = (
                f"sum(if({whole}, r{q} * {ramp_cos[q]!r}D + i{q} * {ramp_sin[q]!r}D, NULL))"
            )
    added = segments.groupBy(*epoch).agg(*[F.expr(s).alias(c) for c, s in sums.items()])
    psd = spectral.detrended_density(
        bins, [f"pow{q}" for q in width], [f"cross{q}" for q in width] if params.detrend else None
    )
    return added.selectExpr("*", f"{moments.SLOPE} AS _m").selectExpr(
        *epoch, *moments.SAMPLE_TERMS, f"{psd} AS psd"
    )
