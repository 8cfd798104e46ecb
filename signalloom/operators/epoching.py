"""Cutting recordings into overlapping epochs.

The engine never replicates samples by the window overlap before a shuffle.
Samples are grouped by ``(SubjectID, EpochBlock)``, where a block is a fixed
number of consecutive epochs, so only the samples at a block edge are sent
twice; epochs are sliced out of the block's array afterwards, in the same
stage. Blocks bound the group size and split a dominant recording.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.operators.numbering import dense_number
from signalloom.params import JobParams
from signalloom.schemas import METADATA_SCHEMA, conform

# Samples that one task handles in memory, about; what a strongly overlapping job makes of
# one takes some KB there.
TASK_SAMPLES = 32_768

# Epoch indices per bucket when the epoch grid itself is spread over tasks.
GRID_BUCKET = 4_096


def start_sample(i: Column, params: JobParams) -> Column:
    """First sample of epoch ``i``: the double product, truncated."""
    return ((i.cast("double") * F.lit(params.step_size)) * F.lit(params.sfreq)).cast("long")


def start_index_range(j: Column, params: JobParams) -> tuple[Column, Column]:
    """Bounds, one too wide on either side, of the epochs that contain sample ``j``."""
    stride = F.lit(params.stride)
    hi = F.floor(j / stride) + 1
    lo = F.greatest(F.ceil((j - (params.n_times - 1)) / stride) - 1, F.lit(0))
    return lo, hi


def contains(i: Column, j: Column, params: JobParams) -> Column:
    start = start_sample(i, params)
    return (j >= start) & (j < start + params.n_times)


def epoch_count(n_samples: Column, params: JobParams) -> Column:
    """Number of grid points ``i*step`` strictly below ``duration - window``."""
    duration = (n_samples - 1) / F.lit(params.sfreq)
    n = F.ceil((duration - F.lit(params.window_length)) / F.lit(params.step_size))
    return F.greatest(n, F.lit(0)).cast("long")


def epoch_grid(recordings: DataFrame, params: JobParams) -> DataFrame:
    """``(SubjectID, i, start)`` for every epoch of every recording.

    A very long recording is first split into runs of ``GRID_BUCKET`` indices,
    and the runs are spread over the cluster before they are expanded.
    """
    n = epoch_count(F.col("n_samples"), params)
    runs = (
        recordings.select("SubjectID", n.alias("n"))
        .where("n > 0")
        .select(
            "SubjectID",
            "n",
            F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / GRID_BUCKET))).alias("run"),
        )
        .repartition("SubjectID", "run")
    )
    first = F.col("run") * GRID_BUCKET
    last = F.least(first + (GRID_BUCKET - 1), F.col("n") - 1)
    return runs.select("SubjectID", F.explode(F.sequence(first, last)).alias("i")).select(
        "SubjectID", "i", start_sample(F.col("i"), params).alias("start")
    )


def number_epochs(kept: DataFrame) -> DataFrame:
    """Dense ids ``ep-0, ep-1 …`` in time order over the epochs that were kept."""
    numbered = dense_number(
        kept, ["SubjectID"], F.floor(F.col("i") / GRID_BUCKET), ["i"], "epoch_no"
    )
    return numbered.select("SubjectID", "i", "start", epoch_id(F.col("epoch_no")).alias("EpochID"))


def epoch_id(n: Column) -> Column:
    return F.concat(F.lit("ep-"), n.cast("string"))


def epoch_samples(samples: DataFrame, recordings: DataFrame, params: JobParams) -> DataFrame:
    """Long form: one row per (epoch, channel, sample), position ``k`` from 0.

    This is the fully replicated table; jobs that only need features should use
    ``slice_epochs``, which does not spell it out.
    """
    lo, hi = start_index_range(F.col("j"), params)
    bounds = recordings.select("SubjectID", epoch_count(F.col("n_samples"), params).alias("n"))
    # Bounds come first: what is shuffled for them is the samples, not their copies.
    return (
        samples.join(bounds, "SubjectID")
        .select("*", F.explode(F.sequence(lo, F.least(hi, F.col("n") - 1))).alias("i"))
        .where("i >= 0 AND i < n")
        .where(contains(F.col("i"), F.col("j"), params))
        .select(
            "SubjectID",
            epoch_id(F.col("i")).alias("EpochID"),
            "Electrode",
            (F.col("j") - start_sample(F.col("i"), params)).alias("k"),
            "value",
        )
    )


def assign_blocks(samples: DataFrame, params: JobParams) -> DataFrame:
    """Give each sample the block(s) of epochs that need it; drop samples no epoch needs."""
    size = params.epochs_per_block
    j, b = F.col("j"), F.col("EpochBlock")
    lo, hi = start_index_range(j, params)
    if params.stride > params.n_times:
        guess = F.floor(j / F.lit(params.stride))
        samples = samples.where(
            contains(guess - 1, j, params)
            | contains(guess, j, params)
            | contains(guess + 1, j, params)
        )
    spread = samples.select(
        "*", F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))).alias("EpochBlock")
    )
    end = start_sample((b + 1) * size - 1, params) + params.n_times
    return spread.where((j >= start_sample(b * size, params)) & (j < end))


def block_grid(recordings: DataFrame, params: JobParams) -> DataFrame:
    """``(SubjectID, EpochBlock, first, last)``: the epoch indices of every block."""
    size = params.epochs_per_block
    return (
        recordings.select("SubjectID", epoch_count(F.col("n_samples"), params).alias("n"))
        .where("n > 0")
        .selectExpr("SubjectID", "n", f"explode(sequence(0L, (n - 1) div {size})) AS EpochBlock")
        .selectExpr(
            "SubjectID",
            "EpochBlock",
            f"EpochBlock * {size} AS first",
            f"least((EpochBlock + 1) * {size}, n) - 1 AS last",
        )
    )


def block_epochs(kept: DataFrame, params: JobParams) -> DataFrame:
    """``(SubjectID, EpochBlock, epochs)`` of a numbered grid; a group is one block's epochs."""
    return (
        kept.withColumn("EpochBlock", F.floor(F.col("i") / params.epochs_per_block))
        .groupBy("SubjectID", "EpochBlock")
        .agg(F.collect_list(F.struct("EpochID", "start")).alias("epochs"))
    )


def deal_blocks(samples: DataFrame, params: JobParams, n_samples: int | None = None) -> DataFrame:
    """Samples by the block(s) that need them; the one shuffle of the samples.

    The samples are counted first, unless the caller knows ``n_samples``: beyond a few
    tasks' worth there are as many tasks as hold about ``TASK_SAMPLES`` each, so a task's
    memory doesn't grow with the input.
    """
    rows = assign_blocks(samples.select("SubjectID", "Electrode", "j", "value"), params)
    n = samples.count() if n_samples is None else n_samples
    return deal(rows, tasks_for(n), "SubjectID", "EpochBlock")


def tasks_for(n: int, size: int = TASK_SAMPLES) -> int | None:
    """Tasks of about ``size`` rows each for ``n`` rows; None where one holds them all."""
    return math.ceil(n / size) if n > size else None


def deal(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` to so many tasks; how many is left to Spark for None."""
    return rows.repartition(*keys) if tasks is None else rows.repartition(tasks, *keys)


def collect_blocks(samples: DataFrame, params: JobParams, n_samples: int | None = None) -> DataFrame:
    """Samples of each (block, channel) as arrays, in order; the one shuffle of the samples."""
    return (
        deal_blocks(samples, params, n_samples)
        .groupBy("SubjectID", "EpochBlock", "Electrode")
        .agg(F.sort_array(F.collect_list(F.struct("j", "value"))).alias("buf"))
        .selectExpr(
            "SubjectID",
            "EpochBlock",
            "Electrode",
            "buf",
            # Taken out here, once per block, and not again for every epoch.
            "buf.value AS run",
            "buf[0].j AS j0",
            f"{_STRETCHES} AS stretches",
        )
    )


# Where a stretch of consecutive samples begins, as places in the block: one look at each
# sample, once per block. Then the stretches' first indices and lengths.
_BREAKS = """filter(sequence(0, size(buf) - 1),
    p -> p = 0 OR get(buf, p).j - get(buf, p - 1).j > 1)"""
_STRETCHES = f"""if(element_at(buf, -1).j - buf[0].j + 1 = size(buf),
    array(named_struct('j', buf[0].j, 'n', cast(size(buf) AS bigint))),
    flatten(transform(array({_BREAKS}), breaks -> transform(breaks, (p, q) -> named_struct(
        'j', get(buf, p).j, 'n', cast(coalesce(get(breaks, q + 1), size(buf)) - p AS bigint))))))"""


def _place(j: str) -> str:
    """SQL of how many of the block's samples lie before index ``j``."""
    return f"aggregate(stretches, 0L, (s, x) -> s + greatest(0L, least({j} - x.j, x.n)))"


def slice_epochs(
    samples: DataFrame,
    recordings: DataFrame,
    params: JobParams,
    kept: DataFrame | None = None,
    n_samples: int | None = None,
) -> DataFrame:
    """One row per (epoch, channel) with its ``signal`` array.

    All epochs of the recordings, or only those of the numbered grid ``kept``.
    Output is hash-partitioned by ``(SubjectID, EpochBlock)``: grouping by those
    columns plus any others needs no further shuffle. Epochs lacking samples
    come out with a shorter ``signal`` (see ``operators.quality``).
    """
    n = params.n_times
    blocks = collect_blocks(samples, params, n_samples)
    keys = ["SubjectID", "EpochBlock"]
    carried = [*keys, "Electrode", "run", "j0", "stretches"]
    if kept is None:
        placed = blocks.join(block_grid(recordings, params), keys).selectExpr(
            *carried, "explode(sequence(first, last)) AS i"
        ).select(
            *carried,
            epoch_id(F.col("i")).alias("EpochID"),
            start_sample(F.col("i"), params).alias("start"),
        )
    else:
        placed = blocks.join(block_epochs(kept, params), keys).selectExpr(
            *carried, "inline(epochs)"
        )
    # Without gaps a sample's place follows from its index; otherwise from the stretches
    # before it, of which there are as many as gaps in the block.
    by_place = f"slice(run, cast(start - j0 + 1 AS int), {n})"
    until = _place(f"start + {n}")
    by_stretch = f"""slice(run, cast({_place('start')} + 1 AS int),
        cast({until} - {_place('start')} AS int))"""
    whole = f"size(stretches) = 1 AND start >= j0 AND start + {n} <= j0 + size(run)"
    return placed.selectExpr(
        *keys, "EpochID", "Electrode", f"if({whole}, {by_place}, {by_stretch}) AS signal"
    )


def detrend(epochs: DataFrame) -> DataFrame:
    """Subtract each channel's least-squares line from its ``signal``, row by row.

    One fold collects count, sum and index-weighted sum; the line is worked out
    once, when the fold finishes.
    """
    zero = F.struct(
        F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t")
    )

    def add(acc, x):
        return F.struct(
            (acc["n"] + 1).alias("n"),
            (acc["s"] + x).alias("s"),
            (acc["t"] + acc["n"] * x).alias("t"),
        )

    def line(acc):
        """Intercept and slope against 0, 1, 2 …"""
        n, centre = acc["n"], (acc["n"] - 1) / 2
        slope = F.coalesce(
            F.try_divide(acc["t"] - centre * acc["s"], n * (n * n - 1) / 12), F.lit(0.0)
        )
        return F.struct(
            (F.try_divide(acc["s"], n) - slope * centre).alias("b"), slope.alias("m")
        )

    fitted = epochs.withColumn("_line", F.array(F.aggregate("signal", zero, add, line)))
    residual = F.transform(
        "_line", lambda f: F.transform("signal", lambda x, k: x - (f["b"] + f["m"] * k))
    )
    return fitted.withColumn("signal", F.get(residual, F.lit(0))).drop("_line")


def long_tasks(samples: DataFrame, params: JobParams) -> int | None:
    """Tasks for the rows of ``epoch_samples``, as many as a task's windows sort within some 50 MB."""
    copies = max(1.0, params.n_times / params.stride)
    return tasks_for(math.ceil(samples.count() * copies), 8 * TASK_SAMPLES)


def detrend_long(epoch_rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """The same for the long form; each window holds one channel of one epoch.

    A task sorts its rows, so there should be as many ``tasks`` as the rows ask for.
    """
    if tasks is not None:
        epoch_rows = deal(epoch_rows, tasks, "SubjectID", "EpochID", "Electrode")
    w = Window.partitionBy("SubjectID", "EpochID", "Electrode")
    k = F.col("k").cast("double")
    return epoch_rows.select(
        "*",
        F.regr_slope("value", k).over(w).alias("_m"),
        F.regr_intercept("value", k).over(w).alias("_b"),
    ).select(
        *epoch_rows.columns, (F.col("value") - (F.col("_b") + F.col("_m") * k)).alias("detrended")
    )


def pack(epochs: DataFrame, keys=("SubjectID", "EpochID")) -> DataFrame:
    """One row per epoch with ``EEG`` = channels (by name) x time. Groups hold one epoch."""
    rows = F.sort_array(F.collect_list(F.struct("Electrode", "signal")))
    return epochs.groupBy(*keys).agg(rows.alias("_rows")).select(
        *keys, F.col("_rows.Electrode").alias("ChannelNames"), F.col("_rows.signal").alias("EEG")
    )


def unpack(packed: DataFrame, keys=("SubjectID", "EpochID")) -> DataFrame:
    """Channels x time back to one row per channel; the name is taken by position."""
    return packed.select(*keys, "ChannelNames", F.posexplode("EEG").alias("_c", "signal")).select(
        *keys, F.get("ChannelNames", F.col("_c")).alias("Electrode"), "signal"
    )


def trim_packed(packed: DataFrame) -> DataFrame:
    """Cut every channel of an epoch to the epoch's shortest channel."""
    return packed.withColumn(
        "_n", F.array_min(F.transform("EEG", lambda c: F.size(c)))
    ).withColumn("EEG", F.transform("EEG", lambda c: F.slice(c, F.lit(1), F.col("_n")))).drop("_n")


def trim_epochs(epochs: DataFrame, keys=("SubjectID", "EpochID")) -> DataFrame:
    """Cut the channels of an epoch, one row each, to its shortest one that has samples.

    A window holds the channels of one epoch.
    """
    channels = Window.partitionBy(*keys)
    length = F.when(F.size("signal") > 0, F.size("signal"))
    return epochs.withColumn("_n", F.min(length).over(channels)).withColumn(
        "signal", F.when(F.col("_n").isNotNull(), F.slice("signal", F.lit(1), F.col("_n"))).otherwise(F.col("signal"))
    ).drop("_n")


def trim_recordings(samples: DataFrame, recordings: DataFrame) -> DataFrame:
    """Keep only samples that every channel of the subject has."""
    return (
        samples.join(recordings.select("SubjectID", "n_samples"), "SubjectID")
        .where("j < n_samples")
        .drop("n_samples")
    )


def recording_metadata(
    channel_lengths: DataFrame, kept: DataFrame, params: JobParams
) -> DataFrame:
    """Channel list, sampling rate and number of kept epochs per subject."""
    channels = channel_lengths.groupBy("SubjectID").agg(
        F.array_sort(F.collect_set("Electrode")).alias("ChannelNames")
    )
    counts = kept.groupBy("SubjectID").agg(F.count(F.lit(1)).alias("NumEpochs"))
    return channels.join(counts, "SubjectID", "left").select(
        "SubjectID",
        "ChannelNames",
        F.lit(params.sfreq).alias("SFreq"),
        F.coalesce("NumEpochs", F.lit(0)).cast("long").alias("NumEpochs"),
    ).transform(conform, METADATA_SCHEMA)


def join_epochs_with_metadata(epochs: DataFrame, metadata: DataFrame) -> DataFrame:
    return epochs.join(metadata.drop("NumEpochs"), "SubjectID", "left")
