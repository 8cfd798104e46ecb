"""Marked-bad intervals and the epochs they reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.operators.epoching import GRID_BUCKET, start_sample
from signalloom.operators.numbering import bucket_offsets
from signalloom.params import JobParams


def relabel_boundaries(annotations: DataFrame) -> DataFrame:
    """Any description containing ``boundary`` becomes ``BAD_boundary``."""
    description = F.col("description")
    return annotations.withColumn(
        "description",
        F.when(F.contains(description, F.lit("boundary")), F.lit("BAD_boundary")).otherwise(
            description
        ),
    )


def bad_intervals(annotations: DataFrame) -> DataFrame:
    """Annotations whose description starts with ``bad`` in any case."""
    return annotations.where(F.startswith(F.lower("description"), F.lit("bad")))


def epoch_bounds(i: Column, params: JobParams) -> tuple[Column, Column]:
    """Start and end of epoch ``i`` in seconds."""
    start = start_sample(i, params)
    fs = F.lit(params.sfreq)
    return start / fs, (start + (params.n_times - 1)) / fs


def touched_range(params: JobParams) -> tuple[Column, Column]:
    """First and last epoch index that strictly overlaps ``(onset, onset + duration)``.

    Epoch starts are truncated products, so a division only gives the index to
    within one; the exact predicate decides among the neighbours.
    """
    onset = F.col("onset")
    offset = onset + F.col("duration")
    fs, stride = F.lit(params.sfreq), F.lit(params.stride)

    def around(guess: Column) -> Column:
        at_least_zero = lambda c: F.greatest(c, F.lit(0))
        return F.sequence(at_least_zero(guess - 2), at_least_zero(guess + 2))

    first_guess = F.floor((onset * fs - (params.n_times - 1)) / stride)
    last_guess = F.floor(offset * fs / stride)
    ends_after = F.filter(around(first_guess), lambda i: epoch_bounds(i, params)[1] > onset)
    starts_before = F.filter(around(last_guess), lambda i: epoch_bounds(i, params)[0] < offset)
    return F.get(ends_after, F.lit(0)), F.try_element_at(starts_before, F.lit(-1))


def reject_epochs(grid: DataFrame, bad: DataFrame, params: JobParams) -> DataFrame:
    """Grid epochs that no bad interval overlaps.

    Each interval covers a run of epoch indices, so it adds +1 at the first and
    -1 after the last; an epoch is kept where the running total is 0. The cost
    is linear in epochs plus intervals, whatever their overlap, and the running
    total is split into index buckets, so no subject is handled by one task.
    """
    first, last = touched_range(params)
    runs = bad.select("SubjectID", first.alias("first"), last.alias("last")).where(
        "first <= last"
    )
    edges = (
        runs.select(
            "SubjectID",
            F.inline(
                F.array(
                    F.struct(F.col("first").alias("i"), F.lit(1).alias("delta")),
                    F.struct((F.col("last") + 1).alias("i"), F.lit(-1).alias("delta")),
                )
            ),
        )
        .groupBy("SubjectID", "i")
        .agg(F.sum("delta").alias("delta"))
    )
    line = grid.withColumn("delta", F.lit(0).cast("long")).unionByName(
        edges.withColumn("start", F.lit(None).cast("long"))
    ).withColumn("_bucket", F.floor(F.col("i") / GRID_BUCKET))
    offsets = bucket_offsets(line, ["SubjectID"], "_bucket", F.sum("delta"), "_offset")
    upto = Window.partitionBy("SubjectID", "_bucket").orderBy("i")
    return (
        line.withColumn("_depth", F.sum("delta").over(upto))
        .join(offsets, ["SubjectID", "_bucket"])
        .where("start IS NOT NULL AND _depth + _offset = 0")
        .select("SubjectID", "i", "start")
    )
