"""Feature-table scalers. Statistics come from the training side only where there is one.

Whole-table statistics enter as a scalar subquery: one row by construction,
evaluated inside the plan, nothing collected by the driver. So do statistics per
column name and per channel and band: a map, whose number of keys is checked.
Per-subject statistics are ordinary joins without hints, so Spark broadcasts them
only when they are measured to be small and splits skewed keys otherwise.
Deviations are sample ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDS = ("SubjectID", "EpochID", "label")

# Column names, and pairs of channel and band: the most that statistics are kept for.
MAX_STATISTICS = 100_000


def quoted(name: str) -> Column:
    """Column reference for names holding dots or dashes, as pivoted ones may."""
    return F.col(f"`{name}`")


def safe_deviation(std: Column) -> Column:
    return F.when(std.isNotNull() & (std != 0), std).otherwise(F.lit(1.0))


def safe_range(lo: Column, hi: Column) -> Column:
    return F.when(hi.isNotNull() & (hi != lo), hi - lo).otherwise(F.lit(1.0))


def _replace(df: DataFrame, new: dict[str, Column], drop: Sequence[str] = ()) -> DataFrame:
    """All replacements in one projection, keeping the column order."""
    return df.select(
        *[new[c].alias(c) if c in new else quoted(c) for c in df.columns if c not in drop]
    )


def _stats_by_position(df: DataFrame, values: Column, stats: dict[str, Callable], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, _stats): for each place of the array ``values`` a struct of its statistics.

    Cells are aggregated by place before anything is shuffled, so the plan is the same
    for any number of columns.
    """
    cells = df.select(*[quoted(k) for k in keys], F.posexplode(values).alias("_at", "_x"))
    by_place = cells.groupBy(*keys, "_at").agg(F.struct(*[f("_x").alias(n) for n, f in stats.items()]).alias("_of"))
    gathered = by_place.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "_of"))).alias("_all"))
    return gathered.select(*[quoted(k) for k in keys], F.col("_all._of").alias("_stats"))


def _scale_by_position(
    df: DataFrame, cols: Sequence[str], values: Column, formula: Callable[[Column, Column], Column]
) -> DataFrame:
    """``cols`` replaced by ``formula(value, its statistics)``; ``df`` has ``_stats``."""
    scaled = df.withColumn("_scaled", F.zip_with(values, "_stats", formula))
    return _replace(
        scaled, {c: F.get("_scaled", F.lit(p)) for p, c in enumerate(cols)}, drop=["_stats", "_scaled"]
    )


def min_max_normalize(
    train: DataFrame,
    test: DataFrame,
    cols: Sequence[str],
    target_min: float = -1.0,
    target_max: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """Map the training range of each column to ``[target_min, target_max]``.

    Test values outside the training range are not clamped; a constant column
    becomes ``target_min``; a column without any training value is an error.
    """
    values = F.array(*[quoted(c).cast("double") for c in cols])
    stats = _stats_by_position(train, values, {"lo": F.min, "hi": F.max})

    def formula(x: Column, s: Column) -> Column:
        # Without training rows there are no statistics at all.
        lo = F.when(s["lo"].isNotNull(), s["lo"]).otherwise(
            F.raise_error(F.lit("a column has no training value")).cast("double")
        )
        return (x - lo) / safe_range(s["lo"], s["hi"]) * (target_max - target_min) + target_min

    train, test = (
        _scale_by_position(df.withColumn("_stats", stats.scalar()), cols, values, formula) for df in (train, test)
    )
    return train, test


def _as_float(c: str) -> Column:
    return quoted(c).cast("float")


def normalize_by_column(
    train: DataFrame, test: DataFrame, cols: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Z-score each column with the training mean and deviation; missing values become 0.

    Values are taken in single precision. Output: ids, label and the columns.
    One row per input row; ``melt``/``unmelt`` give the long-form equivalent.
    """
    values = F.array(*[_as_float(c) for c in cols])
    stats = _stats_by_position(train, values, {"mean": F.avg, "std": F.stddev_samp})

    def formula(x: Column, s: Column) -> Column:
        return F.coalesce((x - s["mean"]) / safe_deviation(s["std"]), F.lit(0.0))

    def scale(df: DataFrame) -> DataFrame:
        own = df.select(*IDS, *[quoted(c) for c in cols]).withColumn("_stats", stats.scalar())
        return _scale_by_position(own, cols, values, formula)

    return scale(train), scale(test)


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Wide to long: ``(ids, pivot, value)``; values in single precision."""
    narrow = df.select(*ids, *[_as_float(c).alias(c) for c in cols])
    return narrow.unpivot(list(ids), [quoted(c) for c in cols], "pivot", "value")


def unmelt(
    long: DataFrame, ids: Sequence[str], cols: Sequence[str], value: str = "value"
) -> DataFrame:
    """Long to wide over the listed columns; missing cells become 0 (ids are left alone)."""
    wide = long.groupBy(*ids).pivot("pivot", list(cols)).agg(F.first(value))
    return fill_cells(wide, cols)


def fill_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing values of the listed columns become 0; nothing else is touched."""
    return _replace(df, {c: F.coalesce(quoted(c), F.lit(0.0)) for c in cols})


def normalize_melted(train_long: DataFrame, long: DataFrame) -> DataFrame:
    """Z-score long rows with the training statistics of their column name."""
    scaled = _by_key(long, train_long, F.col("pivot"), F.col("value"))
    return scaled.withColumn("norm_value", F.col("_scaled")).drop("_scaled")


def _by_key(df: DataFrame, train: DataFrame, key: Column, value: Column) -> DataFrame:
    """``df`` with ``_scaled``, the z-score by the training statistics of the row's key.

    Rows whose key the training side lacks vanish. No row of ``df`` is shuffled.
    """
    per_key = train.where(key.isNotNull()).groupBy(key.alias("_key")).agg(
        F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).alias("_of")
    )
    found = per_key.agg(F.collect_list(F.struct("_key", "_of")).alias("_all")).select(
        F.when(F.size("_all") <= MAX_STATISTICS, F.map_from_entries("_all")).otherwise(
            F.raise_error(F.lit("too many columns, or channels and bands, to scale")).cast(
                f"map<{per_key.schema['_key'].dataType.simpleString()},"
                f"{per_key.schema['_of'].dataType.simpleString()}>"
            )
        ).alias("_stats")
    )
    scaled = (value - F.col("_own.mean")) / safe_deviation(F.col("_own.std"))
    return (
        df.withColumn("_stats", found.scalar())
        .withColumn("_own", F.try_element_at("_stats", key))
        .where("_own IS NOT NULL")
        .withColumn("_scaled", scaled)
        .drop("_stats", "_own")
    )


def _per_subject(
    df: DataFrame, cols: Sequence[str], stats: dict[str, Callable], formula: Callable[[Column, Column], Column]
) -> DataFrame:
    # A left join, not a window: rows without a subject keep null statistics, and a
    # subject that fills a third of the table is reduced before it is shuffled.
    values = F.array(*[quoted(c).cast("double") for c in cols])
    joined = df.join(_stats_by_position(df, values, stats, ["SubjectID"]), "SubjectID", "left")
    return _scale_by_position(joined, cols, values, formula).select(*[quoted(c) for c in df.columns])


def normalize_by_column_per_subject_wide(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _per_subject(
        df, cols, {"mean": F.avg, "std": F.stddev_samp}, lambda x, s: (x - s["mean"]) / safe_deviation(s["std"])
    )


def min_max_by_column_per_subject_wide(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _per_subject(
        df, cols, {"lo": F.min, "hi": F.max}, lambda x, s: (x - s["lo"]) / safe_range(s["lo"], s["hi"])
    )


def normalize_power(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Z-score ``Power`` per (Electrode, WaveBand) with training statistics.

    Keys the training side lacks vanish from the test side. ``Power`` is taken in
    single precision.
    """
    key = F.when(
        F.col("Electrode").isNotNull() & F.col("WaveBand").isNotNull(), F.struct("Electrode", "WaveBand")
    )

    def scale(df: DataFrame) -> DataFrame:
        scaled = _by_key(df, train, key, _as_float("Power"))
        return _replace(scaled, {"Power": F.col("_scaled")}, drop=["_scaled"])

    return scale(train), scale(test)
