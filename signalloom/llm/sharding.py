"""A reproducible shuffle: global row numbers through a keyed Feistel permutation.

Rows are numbered without gaps in the order of their id's hash: hash ranges are
counted, running totals over the bounded list of ranges give each its offset, and
rows are numbered inside their range. The number is then permuted in a rectangle
``a x b`` just larger than the number of rows (a Feistel network over its two
coordinates); results beyond the last row walk on along their cycle. Shard and slot
are remainder and quotient of the permuted number, so both can be computed for any
row number without looking at other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.tables import free_prefix

# Hash ranges that are numbered on their own: a bounded list, whatever the rows.
RANGES = 4096
ROUNDS = 8
# The rectangle has fewer than ``a`` cells too many. Up to 4,096 rows that is less
# than 64, and beyond it a step stays outside with a chance below 1/64; a walk that
# did not end would raise an error, not return a wrong place.
WALK = 64


def number_rows(
    docs: DataFrame, ranges: int = RANGES, number: str = "row_number", total: str = "n_rows"
) -> DataFrame:
    """``docs`` with ``row_number`` (from 0, no gaps) and ``n_rows``, or as they are to be called.

    The order is that of (hash of doc_id, doc_id, the other columns): it does not
    depend on files or partitions. Rows equal in all columns are interchangeable.
    A column of these names in ``docs`` is replaced.
    """
    docs = docs.drop(number, total)
    p = free_prefix(docs.columns)
    keyed = docs.withColumn(f"{p}range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int"))
    whole = Window.orderBy(f"{p}range")
    # At most ``ranges`` rows, which bounds both the single window and the broadcast.
    offsets = keyed.groupBy(f"{p}range").agg(F.count("*").alias(f"{p}rows"))
    offsets = offsets.select(
        F.col(f"{p}range"),
        (F.sum(f"{p}rows").over(whole.rowsBetween(Window.unboundedPreceding, -1))).alias(f"{p}before"),
        F.sum(f"{p}rows").over(
            whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ).alias(f"{p}total"),
    )
    inside = Window.partitionBy(f"{p}range").orderBy(
        F.xxhash64("doc_id"), "doc_id", *[F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]
    )
    return (
        keyed.withColumn(f"{p}in", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), f"{p}range")
        .select(
            *[F.col(f"`{c}`") for c in docs.columns],
            (F.coalesce(f"{p}before", F.lit(0)) + F.col(f"{p}in")).cast("long").alias(number),
            F.col(f"{p}total").alias(total),
        )
    )


def permuted(number: str, total: str, key: str, rounds: int = ROUNDS, walk: int = WALK) -> Column:
    """SQL of the permutation of 0..total-1 chosen by ``key``, applied to ``number``.

    One step is ``rounds`` Feistel rounds on (x, y), x below a and y below b: in turn
    x and y get a keyed hash of the other one added, modulo their side. That is a
    bijection of the rectangle; repeating it until the result is below the total is
    a bijection of the rows.
    """
    a = f"cast(ceil(sqrt({total})) AS bigint)"
    b = f"cast(ceil({total} / {a}) AS bigint)"
    half = "pmod(xxhash64('{key}', k, {by}), {side})".replace("{key}", key.replace("'", ""))
    one_round = f"""CASE WHEN k % 2 = 0
        THEN named_struct('x', (s.x + {half.format(by='s.y', side=a)}) % {a}, 'y', s.y)
        ELSE named_struct('x', s.x, 'y', (s.y + {half.format(by='s.x', side=b)}) % {b}) END"""
    step = f"""aggregate(sequence(1, {rounds}),
        named_struct('x', cast(floor(n / {b}) AS bigint), 'y', n % {b}),
        (s, k) -> {one_round},
        s -> s.x * {b} + s.y)"""
    # n starts as -1 - number: a negative n has not been permuted yet.
    first = step.replace("(n / ", "((-1 - n) / ").replace("n % ", "(-1 - n) % ")
    walked = f"""aggregate(sequence(1, {walk}), -1 - {number},
        (n, i) -> CASE WHEN n < 0 THEN {first} WHEN n >= {total} THEN {step} ELSE n END,
        n -> CASE WHEN n < {total} THEN n ELSE raise_error('the cycle walk did not end') END)"""
    return F.expr(walked)


def assign_shards(
    docs: DataFrame, shards: int = 16, key: str = "shuffle-1", ranges: int = RANGES
) -> DataFrame:
    """``docs`` with ``shard`` (0..shards-1) and ``slot`` (gapless from 0 in each shard).

    The shuffle depends on the key and the rows' ids only. Shard sizes differ by one
    row at most. Null ids take part like others; an empty table stays empty.
    """
    docs = docs.drop("shard", "slot")
    p = free_prefix(docs.columns)
    numbered = number_rows(docs, ranges, f"{p}number", f"{p}n")
    placed = numbered.withColumn(f"{p}place", permuted(f"{p}number", f"{p}n", key))
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        (F.col(f"{p}place") % shards).cast("int").alias("shard"),
        F.floor(F.col(f"{p}place") / shards).cast("long").alias("slot"),
    )
