"""The given test tables seen as recordings, epochs, annotations and feature tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators.numbering import number_rows
from signalloom.params import EXTENDED_BANDS, JobParams
from signalloom.sources.participants import select_subjects

# Nominal rates and windows under which the tables are read.
LINE_PARAMS = JobParams(sfreq=64.0, window_length=0.5, step_size=0.3, n_fft=32)
LINE_PARAMS_EXTENDED = LINE_PARAMS.replace(bands=EXTENDED_BANDS)
DENSE_PARAMS = LINE_PARAMS.replace(step_size=0.05)
VECTOR_PARAMS = JobParams(sfreq=64.0, window_length=63 / 64, n_fft=64, detrend=False)
EVENT_PARAMS = JobParams(sfreq=1.0, window_length=86_400.0, step_size=28_800.0)
VECTOR_LENGTH = 64
CHANNELS = ["AF", "AO", "NF", "NO", "RF", "RO"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _subject(key: str) -> Column:
    return F.concat(F.lit("sub-"), F.col(key).cast("string"))


def vector_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready-made epochs: one channel, 64 samples each."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("sub-"), F.lpad(F.col("label").cast("string"), 3, "0")).alias("SubjectID"),
        F.concat(F.lit("ep-"), F.col("vec_id").cast("string")).alias("EpochID"),
        F.lit("E0").alias("Electrode"),
        F.col("embedding").cast("array<double>").alias("signal"),
    )


# The default segment of 256 samples: every length is a spectrum of its own.
UNEVEN_PARAMS = VECTOR_PARAMS.replace(n_fft=None)


def uneven_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready-made epochs with a whole channel and one of 30 to 64 samples, by the epoch's id."""
    length = F.lit(30) + F.expr("cast(substr(EpochID, 4) AS int)") % 35
    other = F.slice(F.reverse("signal"), F.lit(1), length)
    channels = F.array(
        F.struct(F.lit("E0").alias("Electrode"), "signal"), F.struct(F.lit("E1").alias("Electrode"), other.alias("signal"))
    )
    return vector_epochs(spark, sf_dir).select("SubjectID", "EpochID", F.inline(channels))


LINE_KEYS = ["l_suppkey", "l_returnflag", "l_linestatus"]
# Rows that one task sorts to number them, about 70 MB.
SORTED_ROWS = 524_288
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]


def _electrode() -> Column:
    return F.concat("l_returnflag", "l_linestatus")


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous recordings: the prices of a supplier's lines in shipping order."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEYS, *LINE_ORDER, "l_extendedprice")
    # The file's count; a table that a round of tasks can hold is left to Spark.
    tasks = math.ceil(lines.count() / SORTED_ROWS)
    tasks = tasks if tasks > spark.sparkContext.defaultParallelism else None
    return number_rows(lines, LINE_KEYS, LINE_ORDER, "j", tasks=tasks).select(
        _subject("l_suppkey").alias("SubjectID"),
        _electrode().alias("Electrode"),
        "j",
        F.col("l_extendedprice").alias("value"),
    )


def line_sample_count(spark: SparkSession, sf_dir: str) -> int:
    """The number of ``line_samples``, one per line: the file's count, without numbering them."""
    return table(spark, sf_dir, "lineitem").count()


def line_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(*LINE_KEYS).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        _subject("l_suppkey").alias("SubjectID"), _electrode().alias("Electrode"), "n"
    )


def line_recordings(spark: SparkSession, sf_dir: str, usable=F.min) -> DataFrame:
    return (
        line_channels(spark, sf_dir).groupBy("SubjectID").agg(usable("n").alias("n_samples"))
    )


def line_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-second marks on line recordings, one per supplier and order priority class.

    The onset is the account balance folded into the first seconds of a recording.
    """
    return table(spark, sf_dir, "supplier").select(
        _subject("s_suppkey").alias("SubjectID"),
        (F.abs(F.col("s_acctbal")) / 10_000.0).alias("onset"),
        F.lit(0.25).alias("duration"),
        F.when(F.col("s_nationkey") < 12, F.lit("boundary"))
        .when(F.col("s_nationkey") < 18, F.lit("bad segment"))
        .otherwise(F.lit("eyes closed"))
        .alias("description"),
    )


def event_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hour from each event; error events are marked as boundaries."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(
        F.lit("2024-01-01 00:00:00").cast("timestamp")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("SubjectID"),
        (micros / F.lit(1_000_000.0)).alias("onset"),
        F.lit(3600.0).alias("duration"),
        F.concat(
            "event_type",
            F.when(F.col("event_type") == "error", F.lit(" boundary")).otherwise(F.lit("")),
        ).alias("description"),
    )


def event_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample a second, up to the end of the subject's last mark."""
    end = F.ceil(F.max(F.col("onset") + F.col("duration"))).cast("long") + 1
    return event_annotations(spark, sf_dir).groupBy("SubjectID").agg(end.alias("n_samples"))


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.get(
        F.array(F.lit("A"), F.lit("C"), F.lit("F"), F.lit("X")),
        (F.col("s_nationkey") % 4).cast("int"),
    )
    return table(spark, sf_dir, "supplier").select(
        _subject("s_suppkey").alias("participant_id"), group.alias("Group")
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_subjects(participants(spark, sf_dir))


def wide_split(
    spark: SparkSession, sf_dir: str, width: int = VECTOR_LENGTH
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Wide features in training and test rows, with one constant column."""
    vectors = table(spark, sf_dir, "embeddings")
    cols = [f"e{i}" for i in range(width)]
    wide = vectors.select(
        F.concat(F.lit("sub-"), F.lpad(F.col("label").cast("string"), 3, "0")).alias("SubjectID"),
        F.concat(F.lit("ep-"), F.col("vec_id").cast("string")).alias("EpochID"),
        "label",
        (F.col("vec_id") % 5 == 0).alias("is_test"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)],
        F.lit(1.0).alias("c0"),
    )
    train, test = wide.where(~F.col("is_test")), wide.where("is_test")
    return train.drop("is_test"), test.drop("is_test"), [*cols, "c0"]


def power_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long power rows: mean price per supplier, shipping year, return flag and line status.

    Prices are added up in whole cents, so the mean does not depend on their order.
    """
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    means = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            "l_suppkey", F.year("l_shipdate").alias("y"), "l_returnflag", "l_linestatus"
        )
        .agg(
            F.expr("sum(cast(round(l_extendedprice * 100) AS bigint)) / (count(1) * 100D)").alias(
                "Power"
            )
        )
    )
    return means.join(suppliers, means.l_suppkey == suppliers.s_suppkey).select(
        _subject("l_suppkey").alias("SubjectID"),
        F.concat(F.lit("ep-"), F.col("y").cast("string")).alias("EpochID"),
        (F.col("s_nationkey") % 3).cast("int").alias("label"),
        F.col("l_returnflag").alias("Electrode"),
        F.col("l_linestatus").alias("WaveBand"),
        "Power",
        (F.col("l_suppkey") % 5 == 0).alias("is_test"),
    )


def power_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = power_rows(spark, sf_dir)
    return rows.where(~F.col("is_test")).drop("is_test"), rows.where("is_test").drop("is_test")


def halves_split(
    spark: SparkSession, sf_dir: str
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Two columns, the sums over both halves of each vector, in training and test rows."""
    train, test, cols = wide_split(spark, sf_dir)
    half = VECTOR_LENGTH // 2

    def halves(df: DataFrame) -> DataFrame:
        return df.selectExpr(
            "SubjectID", "EpochID", "label",
            " + ".join(cols[:half]) + " AS h0", " + ".join(cols[half : 2 * half]) + " AS h1",
        )

    return halves(train), halves(test), ["h0", "h1"]
