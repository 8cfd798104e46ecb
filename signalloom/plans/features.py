"""From recordings or ready-made epochs to feature tables."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.functions import moments, spectral
from signalloom.functions.spectral import Bins
from signalloom.operators import annotations as ann
from signalloom.operators import epoching, quality, sliding
from signalloom.operators.channel_stats import any_length_stats, channel_stats
from signalloom.operators.pca import distinct_keys
from signalloom.params import JobParams
from signalloom.schemas import FEATURE_SCHEMA, METADATA_SCHEMA, OUTCOME_SCHEMA, conform
from signalloom.sources.participants import group_label
from signalloom.sources.scratch import scratch_path

# Columns that identify an epoch; sliced epochs also carry their block, which is
# what the data is partitioned by.
EPOCH_KEYS = ("SubjectID", "EpochID")
SLICED_KEYS = ("SubjectID", "EpochBlock", "EpochID")

# Features per electrode, and per electrode and band, in output order.
ELECTRODE_FEATURES = ("Mean", "Std", "RMS", "HjorthMobility", "HjorthComplexity")
BAND_FEATURES = ("Power", "HjorthMobility", "HjorthComplexity")
EPOCH_FEATURES = ("Mean", "Std", "Variance", "RMS", "HjorthMobility")


def kept_epochs(
    recordings: DataFrame, params: JobParams, annotations: DataFrame | None = None
) -> DataFrame:
    """The numbered epoch grid, without epochs that touch a bad interval."""
    grid = epoching.epoch_grid(recordings, params)
    if annotations is None:
        return grid.withColumn("EpochID", epoching.epoch_id(F.col("i")))
    bad = ann.bad_intervals(ann.relabel_boundaries(annotations))
    return epoching.number_epochs(ann.reject_epochs(grid, bad, params))


def sliced_epochs(
    samples: DataFrame,
    recordings: DataFrame,
    params: JobParams,
    annotations: DataFrame | None = None,
) -> DataFrame:
    """Epochs of recordings; without annotations the grid itself is never spelled out."""
    kept = None if annotations is None else kept_epochs(recordings, params, annotations)
    return epoching.slice_epochs(samples, recordings, params, kept)


def recording_stats(
    samples: DataFrame,
    recordings: DataFrame,
    params: JobParams,
    annotations: DataFrame | None = None,
    bins: Bins | None = None,
    panes: bool | None = None,
    n_samples: int | None = None,
) -> DataFrame:
    """Complete channel-epochs of recordings with their features and, given bins, spectrum.

    Strongly overlapping epochs go through panes, others are sliced; same result.
    ``panes`` asks for one of the two routes. Rows lie by ``(SubjectID, EpochBlock)``, alike
    on both routes. ``n_samples``, where it is known, saves counting the samples.
    """
    kept = None if annotations is None else kept_epochs(recordings, params, annotations)
    if sliding.pays_off(params, bins) if panes is None else panes:
        return sliding.sliding_stats(samples, recordings, params, bins, kept, n_samples)
    epochs = epoching.slice_epochs(samples, recordings, params, kept, n_samples)
    stats = channel_stats(epochs, SLICED_KEYS, bins, detrended=params.detrend)
    return stats.where(F.col("n") == params.n_times)


def band_power(
    bins: Bins, params: JobParams, relative: bool = True, agg: str = "mean"
) -> dict[str, str]:
    """Per band, as SQL over ``psd``: mean (or sum) of its bins.

    ``relative`` divides by ``_total``, the sum over all retained bins, which
    includes the bin at the highest band edge although no band owns it.
    """
    reduce = {"mean": spectral.bin_mean, "sum": spectral.bin_sum}[agg]
    out = {}
    for b in params.bands:
        value = reduce(bins.within(b))
        out[b.name] = f"try_divide({value}, _total)" if relative else value
    return out


def with_band_power(
    stats: DataFrame, bins: Bins, params: JobParams, relative: bool = True, agg: str = "mean"
) -> DataFrame:
    """Add a column ``Power_<band>`` per band."""
    power = band_power(bins, params, relative, agg)
    total = spectral.bin_sum(list(range(len(bins.ks))))
    return stats.selectExpr("*", f"{total} AS _total").selectExpr(
        *stats.columns, *[f"{sql} AS `Power_{name}`" for name, sql in power.items()]
    )


def _feature_row(band: str | None, name: str, value: str, kind: str) -> str:
    band_sql = "cast(NULL AS string)" if band is None else f"'{band}'"
    return (
        f"named_struct('WaveBand', {band_sql}, 'FeatureName', '{name}',"
        f" 'FeatureValue', cast({value} AS double), 'table_type', '{kind}')"
    )


def _feature_rows(params: JobParams, table_type: str) -> list[str]:
    rows = [_feature_row(None, f, f, table_type) for f in ELECTRODE_FEATURES]
    for b in params.bands:
        rows += [
            _feature_row(b.name, f, f"`Power_{b.name}`" if f == "Power" else f, "band")
            for f in BAND_FEATURES
        ]
    return rows


def assemble_long(
    stats: DataFrame, bins: Bins, params: JobParams, table_type: str = "band", carried: Sequence[str] = ()
) -> DataFrame:
    """Long feature rows of ``stats`` with a spectrum; see ``long_rows``."""
    return long_rows(with_band_power(stats, bins, params), params, table_type, carried)


def long_rows(
    powered: DataFrame, params: JobParams, table_type: str = "band", carried: Sequence[str] = ()
) -> DataFrame:
    """Long feature rows, all made from one wide row: no join, union or shuffle.

    Band rows repeat the broadband Hjorth features. ``table_type`` is what the
    electrode-level rows are marked with; band rows are always ``band``. Columns to be
    ``carried`` along come last.
    """
    rows = _feature_rows(params, table_type)
    long = powered.selectExpr(*EPOCH_KEYS, "Electrode", *carried, f"inline(array({', '.join(rows)}))")
    return conform(long, T.StructType([*FEATURE_SCHEMA, *[long.schema[c] for c in carried]]))


def features_long(
    samples: DataFrame,
    recordings: DataFrame,
    params: JobParams,
    annotations: DataFrame | None = None,
    table_type: str = "band",
) -> DataFrame:
    """The long feature table: 5 + 3 per band rows for each channel of each epoch."""
    bins = spectral.welch_bins(params)
    stats = recording_stats(samples, recordings, params, annotations, bins)
    return assemble_long(stats, bins, params, table_type)


# The values of ``outcome`` of a job's rows.
FEATURES, METADATA, REJECTED_EPOCHS, REJECTED_SUBJECTS = "features", "metadata", "rejected_epochs", "rejected_subjects"


def job_outcomes(
    samples: DataFrame,
    recordings: DataFrame,
    params: JobParams,
    annotations: DataFrame | None = None,
    table_type: str = "band",
) -> DataFrame:
    """All that a job yields as rows of one table, tagged by ``outcome`` (OUTCOME_SCHEMA).

    Features, metadata, channel-epochs without features and subjects without epochs, the
    last two with their reason. Samples are shuffled once: every channel is expected in
    each kept epoch of its subject, and what was computed joins that list, a row per
    channel-epoch. A channel-epoch without enough samples is ``incomplete``, also where
    strongly overlapping windows go through panes and a sample is only null.
    """
    bins = spectral.welch_bins(params)
    kept = kept_epochs(recordings, params, annotations)
    grid = None if annotations is None else kept
    if sliding.pays_off(params, bins):
        stats = sliding.sliding_stats(samples, recordings, params, bins, grid)
        stats = stats.withColumn("_size", F.lit(None).cast("int"))
    else:
        # The number of samples, null ones too, goes along as a key.
        epochs = epoching.slice_epochs(samples, recordings, params, grid).withColumn("_size", F.size("signal"))
        stats = channel_stats(epochs, (*SLICED_KEYS, "_size"), bins, detrended=params.detrend)
    channels = samples.groupBy("SubjectID", "Electrode").agg(F.count(F.lit(1)).alias("n"))
    names = channels.groupBy("SubjectID").agg(F.array_sort(F.collect_set("Electrode")).alias("_names"))
    expected = kept.join(names, "SubjectID").select("SubjectID", "EpochID", F.explode("_names").alias("Electrode"))
    found = expected.join(with_band_power(stats, bins, params), [*EPOCH_KEYS, "Electrode"], "left")
    found = found.selectExpr("*", f"""CASE WHEN n = {params.n_times} THEN NULL
        WHEN _size = {params.n_times} THEN 'missing sample' ELSE 'incomplete' END AS reason""")
    rejected = _feature_row(None, "", "NULL", "").replace("''", "cast(NULL AS string)")
    rows = f"inline(if(reason IS NULL, array({', '.join(_feature_rows(params, table_type))}), array({rejected})))"
    tagged = found.selectExpr(*EPOCH_KEYS, "Electrode", "reason", rows).selectExpr(
        f"if(reason IS NULL, '{FEATURES}', '{REJECTED_EPOCHS}') AS outcome", "*"
    )
    described = epoching.recording_metadata(channels, kept, params).select(F.lit(METADATA).alias("outcome"), "*")
    without = quality.rejected_subjects(recordings, kept).select(F.lit(REJECTED_SUBJECTS).alias("outcome"), "*")
    all_rows = tagged.unionByName(described, True).unionByName(without, True)
    return conform(all_rows, OUTCOME_SCHEMA)


@dataclasses.dataclass(frozen=True)
class FeatureJob:
    """What one run yielded: features, what was recorded, and what was left out and why.

    ``counts`` holds the rows of each outcome as they were written.
    """

    features: DataFrame
    metadata: DataFrame
    rejected_epochs: DataFrame
    rejected_subjects: DataFrame
    counts: dict[str, int]


def feature_job(
    samples: DataFrame,
    recordings: DataFrame,
    params: JobParams,
    annotations: DataFrame | None = None,
    table_type: str = "band",
    path: str | None = None,
) -> FeatureJob:
    """Run the whole job once: one table, partitioned by outcome, and its parts to read.

    It is written to ``path`` (a new folder in the shared one by default). Raises if no
    subject has an epoch.
    """
    spark = samples.sparkSession
    path = path or scratch_path(spark, "features")
    tags = (FEATURES, METADATA, REJECTED_EPOCHS, REJECTED_SUBJECTS)
    seen = Observation("outcomes")
    outcomes = job_outcomes(samples, recordings, params, annotations, table_type).observe(
        seen, *[F.count_if(F.col("outcome") == tag).alias(tag) for tag in tags]
    )
    outcomes.write.partitionBy("outcome").parquet(path)
    counts = {tag: seen.get[tag] for tag in tags}
    if not counts[FEATURES] + counts[REJECTED_EPOCHS]:
        raise ValueError("no valid epochs found for any subject")
    # The columns as written, with the partition's.
    written = spark.read.schema(OUTCOME_SCHEMA).parquet(path)

    def part(tag: str, *columns: str) -> DataFrame:
        return written.where(F.col("outcome") == tag).select(*columns)

    return FeatureJob(
        part(FEATURES, *FEATURE_SCHEMA.names),
        part(METADATA, *METADATA_SCHEMA.names),
        part(REJECTED_EPOCHS, *EPOCH_KEYS, "Electrode", "reason"),
        part(REJECTED_SUBJECTS, "SubjectID", "reason"),
        counts,
    )


def epochs_features_long(
    epochs: DataFrame, params: JobParams, table_type: str = "band"
) -> DataFrame:
    """The same for ready-made epochs (one row per channel with ``signal``), taken as they are.

    Epochs may differ in length; within one, channels are cut to the shortest. Each
    gets the spectrum of its own length, all lengths in one plan that reads the epochs
    once. What yields no features is listed by ``quality.rejected_signals``.
    """
    spectrum = spectral.AnyLength.of(params)
    trimmed = epoching.trim_epochs(epochs).where("NOT exists(signal, x -> x IS NULL)")
    stats = any_length_stats(trimmed, spectrum, EPOCH_KEYS)
    total = "aggregate(psd, 0D, (a, v) -> a + v)"
    powered = stats.selectExpr("*", f"{total} AS _total").selectExpr(
        "*", *[f"try_divide({spectrum.band_mean(b)}, _total) AS `Power_{b.name}`" for b in params.bands]
    )
    return long_rows(powered, params, table_type)


def features_wide(
    stats: DataFrame,
    bins: Bins,
    params: JobParams,
    channels: Sequence[str] | None = None,
    features: Sequence[str] = ELECTRODE_FEATURES,
    keys: Sequence[str] = SLICED_KEYS,
    agg: str = "sum",
) -> DataFrame:
    """One row per epoch: ``<Feature>_<channel>`` and ``Power_<channel>_<band>`` (absolute).

    A group holds the channels of one epoch. Columns need a known channel list;
    if none is given it is looked up first, and refused if it is not small.
    """
    channels = list(channels) if channels is not None else distinct_keys(stats, "Electrode")
    bands = [f"Power_{b.name}" for b in params.bands]
    values = ", ".join(f"`{c}`" for c in [*features, *bands])
    by_channel = with_band_power(stats, bins, params, relative=False, agg=agg).groupBy(*keys).agg(
        F.expr(
            f"map_from_entries(collect_list(struct(Electrode, struct({values}))))"
        ).alias("_m")
    )
    return by_channel.selectExpr(
        *EPOCH_KEYS,
        *[f"_m['{ch}'].`{f}` AS `{f}_{ch}`" for f in features for ch in channels],
        *[
            f"_m['{ch}'].`Power_{b.name}` AS `Power_{ch}_{b.name}`"
            for ch in channels
            for b in params.bands
        ],
    )


def epoch_level_features(stats: DataFrame, keys: Sequence[str] = SLICED_KEYS) -> DataFrame:
    """Averages over the channels of each epoch, as long rows without channel and band."""
    means = stats.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in EPOCH_FEATURES])
    null = F.lit(None).cast("string")
    return means.unpivot(
        list(EPOCH_KEYS), list(EPOCH_FEATURES), "FeatureName", "FeatureValue"
    ).select(
        *EPOCH_KEYS,
        null.alias("Electrode"),
        null.alias("WaveBand"),
        "FeatureName",
        "FeatureValue",
        F.lit("epoch").alias("table_type"),
    )


def psd_long(stats: DataFrame, bins: Bins, normalise: bool = False) -> DataFrame:
    """One row per frequency bin."""
    psd = spectral.normalised(F.col("psd")) if normalise else F.col("psd")
    freqs = F.array(*[F.lit(f) for f in bins.freqs])
    return stats.select(*EPOCH_KEYS, "Electrode", F.posexplode(psd).alias("_p", "psd")).select(
        *EPOCH_KEYS, "Electrode", F.get(freqs, F.col("_p")).alias("freq"), "psd"
    )


def spectral_summary(stats: DataFrame) -> DataFrame:
    """Total power, total energy and spectral entropy of the normalised spectrum."""
    normal = spectral.normalised(F.col("psd"))
    return stats.select(
        *EPOCH_KEYS,
        "Electrode",
        spectral.total_power(normal).alias("TotalPower"),
        spectral.total_energy(normal).alias("TotalEnergy"),
        spectral.spectral_entropy(F.col("psd")).alias("SpectralEntropy"),
    )


def with_hjorth_index(stats: DataFrame) -> DataFrame:
    return stats.selectExpr("*", f"{moments.HJORTH_INDEX} AS HjorthIndex")


def power_rows(stats: DataFrame, bins: Bins, params: JobParams) -> DataFrame:
    """Relative power per band as long rows, without the other features."""
    rows = ", ".join(
        f"named_struct('WaveBand', '{b.name}', 'Power', `Power_{b.name}`)" for b in params.bands
    )
    return with_band_power(stats, bins, params).selectExpr(
        *EPOCH_KEYS, "Electrode", f"inline(array({rows}))"
    )


def labelled_power(power: DataFrame, subjects: DataFrame) -> DataFrame:
    """Power rows of known subjects with their class label: the scalers' and PCA's input."""
    return power.join(subjects, "SubjectID").select(
        "SubjectID", "EpochID", group_label(F.col("Group")).alias("label"), "Electrode", "WaveBand", "Power"
    )


def band_entropy(stats: DataFrame, bins: Bins, params: JobParams) -> DataFrame:
    """Spectral entropy inside each band, over the shares of the band's own bins.

    Null for a band without bins or without power.
    """
    cells = []
    for b in params.bands:
        at = bins.within(b)
        part = F.slice("psd", at[0] + 1, len(at)) if at else F.array().cast("array<double>")
        entropy = F.when(F.size(part) > 0, spectral.spectral_entropy(part))
        cells.append(F.struct(F.lit(b.name).alias("WaveBand"), entropy.alias("SpectralEntropy")))
    return stats.select(*EPOCH_KEYS, "Electrode", F.inline(F.array(*cells)))
