"""Signal quality figures, and what was left out and why."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions import spectral
from signalloom.operators import epoching
from signalloom.params import JobParams


def signal_quality(epochs: DataFrame, keys: Sequence[str] = ("SubjectID", "EpochID")) -> DataFrame:
    """Per channel of an epoch: sample count, missing and NaN samples, range, mean, deviation."""
    x = F.col("x")
    return (
        epochs.select(*keys, "Electrode", F.explode("signal").alias("x"))
        .groupBy(*keys, "Electrode")
        .agg(
            F.count(F.lit(1)).alias("n_times"),
            F.count_if(x.isNull()).alias("n_missing"),
            F.count_if(F.isnan(x)).alias("n_nan"),
            F.min("x").alias("min_value"),
            F.max("x").alias("max_value"),
            F.avg("x").alias("mean_value"),
            F.stddev_pop("x").alias("std_value"),
        )
    )


def rejected_epochs(
    epochs: DataFrame, kept: DataFrame, channels: DataFrame, n_times: int
) -> DataFrame:
    """Channel-epochs that yield no features, with the reason.

    Every channel of a subject is expected in each of its epochs; one that has no
    sample there at all is reported like one that has too few.
    """
    names = channels.groupBy("SubjectID").agg(F.collect_set("Electrode").alias("_names"))
    expected = kept.join(names, "SubjectID").select(
        "SubjectID", "EpochID", F.explode("_names").alias("Electrode")
    )
    state = epochs.select(
        "SubjectID",
        "EpochID",
        "Electrode",
        F.size("signal").alias("_n"),
        F.exists("signal", lambda x: x.isNull()).alias("_missing"),
    )
    reason = F.when(F.coalesce("_n", F.lit(0)) != n_times, F.lit("incomplete")).when(
        F.col("_missing"), F.lit("missing sample")
    )
    return (
        expected.join(state, ["SubjectID", "EpochID", "Electrode"], "left")
        .select("SubjectID", "EpochID", "Electrode", reason.alias("reason"))
        .where("reason IS NOT NULL")
    )


def rejected_signals(epochs: DataFrame, params: JobParams) -> DataFrame:
    """Channels of ready-made epochs that yield no features, with the reason."""
    segment = params.n_fft or spectral.DEFAULT_N_FFT
    short = [n for n in range(1, segment) if not spectral.has_bins(params, n)]
    n = F.size("signal")
    reason = (
        F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit("no sample"))
        .when(F.exists("signal", lambda x: x.isNull()), F.lit("missing sample"))
        .when(n <= max(short, default=0), F.lit("too short"))
    )
    return (
        epoching.trim_epochs(epochs)
        .select("SubjectID", "EpochID", "Electrode", reason.alias("reason"))
        .where("reason IS NOT NULL")
    )


def spectral_quality(stats: DataFrame, keys: Sequence[str] = ("SubjectID", "EpochID")) -> DataFrame:
    """Per channel of an epoch with a spectrum: bins, their range, total and the peak's place."""
    psd = F.col("psd")
    return stats.select(
        *keys,
        "Electrode",
        F.size(psd).cast("long").alias("n_bins"),
        F.size(F.filter(psd, lambda p: F.isnan(p) | p.isNull())).cast("long").alias("n_undefined"),
        F.array_min(psd).alias("min_psd"),
        F.array_max(psd).alias("max_psd"),
        spectral.array_total(psd).alias("total_psd"),
        F.array_position(psd, F.array_max(psd)).alias("peak_bin"),
    )


def rejected_subjects(recordings: DataFrame, kept: DataFrame) -> DataFrame:
    """Recordings from which no epoch was kept."""
    return recordings.join(kept.select("SubjectID").distinct(), "SubjectID", "left_anti").select(
        "SubjectID", F.lit("no epochs").alias("reason")
    )


def duplicate_subjects(subjects: DataFrame) -> DataFrame:
    """Subjects that occur more than once, and how often."""
    counts = subjects.groupBy("SubjectID").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where("n_rows > 1")


def compare_tables(
    left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-9,
    tasks: int | None = None, dealt: Sequence[str] = (),
) -> DataFrame:
    """(keys, left, right, class): two tables' values side by side, one row per key of either.

    Classes: ``equal`` (within ``tolerance`` of the larger magnitude, or both null, or both
    NaN), ``different``, ``null`` or ``nan`` (on one side only), ``only left`` and
    ``only right``. Null keys match each other. Keys should be unique on each side; rows
    that repeat one are matched with all of the other side's. ``tasks`` deals both sides to
    so many tasks, for tables too large for the session's; keys must then have the same
    types on both sides. ``dealt`` names columns, which the keys determine, that both sides
    are already dealt by: rows are then matched where they lie and nothing is shuffled, as
    far as Spark sees that both are dealt alike; otherwise it deals them.
    """
    if dealt:
        matched = _matched_in_place(left, right, keys, value, dealt)
        return _compared(matched, {k: F.col(f"_{k}") for k in keys}, tolerance)
    sides = [
        df.select(*[F.col(k).alias(f"_{k}_{i}") for k in keys], F.col(value).cast("double").alias(f"_v{i}"), F.lit(True).alias(f"_in{i}"))
        for i, df in enumerate((left, right))
    ]
    same = F.expr(" AND ".join(f"`_{k}_0` <=> `_{k}_1`" for k in keys))
    if tasks is not None:
        # Nulls within structs are equal, and the join keeps to how these are dealt.
        sides = [
            df.withColumn(f"_key{i}", F.struct(*[F.col(f"_{k}_{i}").alias(f"k{n}") for n, k in enumerate(keys)]))
            .repartition(tasks, f"_key{i}") for i, df in enumerate(sides)
        ]
        same = F.col("_key0") == F.col("_key1")
    matched = sides[0].join(sides[1], same, "full_outer")
    return _compared(matched, {k: F.coalesce(f"_{k}_0", f"_{k}_1") for k in keys}, tolerance)


def _matched_in_place(
    left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, dealt: Sequence[str]
) -> DataFrame:
    """The full outer join of two tables dealt alike, as a window over the rows of both.

    Their union is dealt like them, and a window may use fewer columns than its own for
    that, where a join asks for exactly its keys. A left row meets the right ones of its
    key; a right one stands by itself where its key has no left one.
    """
    by = [*keys, *[c for c in dealt if c not in keys]]
    sides = [
        df.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(value).cast("double").alias("v"), F.lit(bool(i)).alias("is_right"))
        for i, df in enumerate((left, right))
    ]
    of_key = Window.partitionBy(*[f"_{c}" for c in by])
    rows = sides[0].union(sides[1]).select(
        "*", F.count_if(~F.col("is_right")).over(of_key).alias("n_left"),
        F.collect_list(F.when(F.col("is_right"), F.struct("v"))).over(of_key).alias("rights"),
    )
    return rows.where("NOT is_right OR n_left = 0").selectExpr(*[f"`_{k}`" for k in keys], """inline(CASE
        WHEN is_right THEN array(named_struct('_v0', cast(NULL AS double), '_in0', cast(NULL AS boolean), '_v1', v, '_in1', true))
        WHEN size(rights) = 0 THEN array(named_struct('_v0', v, '_in0', true, '_v1', cast(NULL AS double), '_in1', cast(NULL AS boolean)))
        ELSE transform(rights, r -> named_struct('_v0', v, '_in0', true, '_v1', r.v, '_in1', true)) END)""")


def _compared(matched: DataFrame, keys: Mapping[str, Column], tolerance: float) -> DataFrame:
    """Matched rows with the class of ``_v0`` and ``_v1``; ``_in0`` and ``_in1`` are null on a side without the row."""
    a, b = F.col("_v0"), F.col("_v1")
    kind = (
        F.when(F.col("_in1").isNull(), "only left").when(F.col("_in0").isNull(), "only right")
        .when(a.isNull() & b.isNull(), "equal").when(a.isNull() | b.isNull(), "null")
        .when(F.isnan(a) & F.isnan(b), "equal").when(F.isnan(a) | F.isnan(b), "nan")
        .when(a == b, "equal")
        .when(F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)), "equal").otherwise("different")
    )
    return matched.select(*[c.alias(k) for k, c in keys.items()], a.alias("left"), b.alias("right"), kind.alias("class"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail early if nothing is left to work on. Looks for one row only."""
    if df.isEmpty():
        raise ValueError(f"no valid {what} found for any subject")
    return df
