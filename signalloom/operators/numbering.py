"""Prefix sums and dense numbering inside groups that may be too big for one task.

A plain ``row_number() OVER (PARTITION BY key ORDER BY …)`` sends every row of a
key to one task. Here the order axis is cut into buckets instead: rows are numbered
within ``(key, bucket)`` and shifted by the totals of the earlier buckets, so only
one summary row per ``(key, bucket)`` is ever ordered per key. ``dense_number`` takes
the buckets as given. ``number_rows`` and ``running`` find them: a sample of rows, of a
fixed expected size, gives the split points, so a key gets as many buckets as its
share of all rows asks for, along its whole order, and a small key gets none.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Split points looked for in a table: a bucket holds about one in so many of its rows.
# Twice as many are never found in practice (the sample is binomial), which bounds what
# is broadcast: a few hundred KB.
SPLITS = 2048


def bucket_offsets(
    df: DataFrame, keys: Sequence[str], bucket: str, amount: Column, name: str
) -> DataFrame:
    """Per ``(keys, bucket)``: the total of ``amount`` over all earlier buckets of the key."""
    totals = df.groupBy(*keys, bucket).agg(amount.alias(name))
    before = (
        Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(*keys, bucket, F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name))


def dense_number(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column | str],
    name: str,
) -> DataFrame:
    """Number the rows of each key 0, 1, 2 … along ``order``.

    ``bucket`` must be a non-decreasing function of ``order``; it does not change the
    result.
    """
    keys = list(keys)
    cut = df.withColumn("_bucket", bucket)
    offsets = bucket_offsets(cut, keys, "_bucket", F.count(F.lit(1)), "_offset")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.expr("_offset + _rn - 1"))
        .drop("_bucket", "_offset", "_rn")
    )


def split_points(
    df: DataFrame, keys: Sequence[str], cut: Sequence[str], splits: int = SPLITS
) -> DataFrame:
    """(keys, _blocks): ascending split points, in blocks, of keys that hold sampled rows.

    Rows are sampled by the hash of ``keys`` and ``cut``, with the chance that makes
    ``splits`` of them expected; equal rows count once. No action runs: the row count
    is a scalar subquery.
    """
    share = df.agg(F.lit(float(splits)) / F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    drawn = F.pmod(F.xxhash64(*keys, *cut), F.lit(1 << 53)) / F.lit(float(1 << 53))
    sampled = df.where(drawn < share).select(*keys, F.struct(*cut).alias("_at"))
    points = sampled.groupBy(*keys).agg(F.array_sort(F.collect_set("_at")).alias("_splits"))
    size = _block_size(splits)
    blocks = f"transform(sequence(0, (size(_splits) - 1) div {size}), b -> slice(_splits, cast(b AS int) * {size} + 1, {size}))"
    return points.select(*keys, F.expr(blocks).alias("_blocks"))


def _block_size(splits: int) -> int:
    """A key's split points are searched in two steps, which carry about this many each."""
    return max(1, math.isqrt(splits))


def with_bucket(
    df: DataFrame, keys: Sequence[str], cut: Sequence[str], points: DataFrame, splits: int = SPLITS,
    name: str = "_bucket",
) -> DataFrame:
    """``df`` with the number of its key's split points at or before the row."""
    named = [F.col(k).alias(f"_key_{k}") for k in keys]
    same = " AND ".join(["true", *[f"`{k}` <=> `_key_{k}`" for k in keys]])
    own = [f"`{c}`" for c in df.columns]
    upto = f"p -> p <= struct({', '.join(f'`{c}`' for c in cut)})"
    firsts = points.select(*named, F.expr("transform(_blocks, b -> b[0])").alias("_firsts"))
    placed = df.join(F.broadcast(firsts), F.expr(same), "left").selectExpr(
        *own, f"coalesce(size(filter(_firsts, {upto})), 0) AS _in"
    )
    blocks = points.select(*named, F.posexplode("_blocks").alias("_nth", "_splits"))
    placed = placed.join(F.broadcast(blocks), F.expr(f"{same} AND _in = _nth + 1"), "left")
    found = f"if(_splits IS NULL, 0, _nth * {_block_size(splits)} + size(filter(_splits, {upto})))"
    return placed.selectExpr(*own, f"{found} AS `{name}`")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    amounts: Mapping[str, tuple[str, str]],
    cut: Sequence[str] | None = None,
    splits: int = SPLITS,
    tasks: int | None = None,
) -> DataFrame:
    """``df`` with running totals of each key along ``order``, the row itself included.

    ``amounts`` names (``sum`` or ``bit_xor``, SQL of the amount, not null) per new
    column. ``cut`` are leading columns of ``order`` that tell buckets apart (all of
    them by default): rows of one key equal in these stay in one task. Rows equal in
    ``order`` follow each other in any order. Null keys are a key, null values come
    first. Names starting with ``_`` are kept free by the caller. ``tasks`` deals the rows to
    so many tasks, each of which sorts its own, where the session's would hold too many.
    """
    keys, cut = list(keys), list(cut or order)
    points = split_points(df, keys, cut, splits)
    placed = with_bucket(df, keys, cut, points, splits)
    # Only split keys have later buckets: fewer than there are split points.
    same = F.expr(" AND ".join(f"`{k}` <=> `_key_{k}`" for k in keys))
    named = [F.col(k).alias(f"_key_{k}") for k in keys]
    totals = (
        placed.join(F.broadcast(points.select(*named)), same, "left_semi")
        .groupBy(*keys, "_bucket")
        .agg(*[F.expr(f"{agg}({sql})").alias(name) for name, (agg, sql) in amounts.items()])
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *named, F.col("_bucket").alias("_key_bucket"),
        *[F.expr(f"{agg}({name})").over(before).alias(f"_before_{name}") for name, (agg, _) in amounts.items()],
    ).where("_key_bucket > 0")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    dealt = placed if tasks is None else placed.repartition(tasks, *keys, "_bucket")
    own = dealt.select("*", *[
        F.expr(f"{agg}({sql})").over(inside).alias(f"_own_{name}") for name, (agg, sql) in amounts.items()
    ])
    shifted = own.join(F.broadcast(offsets), same & F.expr("_bucket = _key_bucket"), "left")
    plus = {"sum": "+", "bit_xor": "^"}
    return shifted.selectExpr(*[f"`{c}`" for c in df.columns if c not in amounts], *[
        f"_own_{name} {plus[agg]} coalesce(_before_{name}, 0L) AS `{name}`" for name, (agg, _) in amounts.items()
    ])


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    cut: Sequence[str] | None = None,
    splits: int = SPLITS,
    tasks: int | None = None,
) -> DataFrame:
    """Number the rows of each key 0, 1, 2 … along ``order``; see ``running``."""
    counted = running(df, keys, order, {name: ("sum", "1L")}, cut, splits, tasks)
    return counted.withColumn(name, F.col(name) - 1)
