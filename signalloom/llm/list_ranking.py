"""Prefix sums along linked lists that are spread over all tasks.

Random-mate contraction: each round, an element that drew 0 absorbs its successor if
that drew 1, which a single join finds; about a quarter of the elements goes. What is
left, a bounded number, is walked in one task, and the rounds are undone in reverse,
each again by one join. The work of all rounds adds up to a few passes over the list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.tables import written

# Elements that one task walks (56 bytes each).
BASE = 1 << 17

ID, NEXT = ("c", "a"), ("next_c", "next_a")


def _walk(weights: Sequence[str]):
    """A task's lists walked from their heads: exclusive prefix sums of the weights."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        n = table.num_rows
        ids = list(zip(*(table[c].to_pylist() for c in ID), strict=True))
        at = {key: i for i, key in enumerate(ids)}
        following = [at.get(key, -1) for key in zip(*(table[c].to_pylist() for c in NEXT), strict=True)]
        own = np.stack([table[w].to_numpy() for w in weights], axis=1)
        before = np.zeros_like(own)
        for i in set(range(n)).difference(following):
            total = np.zeros(own.shape[1], own.dtype)
            while i >= 0:
                before[i] = total
                total = total + own[i]
                i = following[i]
        yield pa.RecordBatch.from_arrays(
            [table[c].combine_chunks() for c in ID] + [pa.array(before[:, k]) for k in range(own.shape[1])],
            names=[*ID, *weights],
        )

    return walk


def prefix_sums(elements: DataFrame, weights: Sequence[str], base: int = BASE) -> DataFrame:
    """(c, a, weights): for each element the sum of the weights before it in its list.

    ``elements`` holds (c, a, next_c, next_a, weights), all long; it should be a written
    table. Ids are unique; the last element of a list has a null successor. Lists end
    (there are no rings) and are few: one task gets the last element of each. An empty
    table gives no rows.
    """
    weights = list(weights)
    columns = [*ID, *NEXT, *weights]
    rounds: list[DataFrame] = []
    elements = elements.select(*columns)
    # A list that is down to one element has no link left.
    while elements.where("next_c IS NOT NULL").count() > base:
        coin = F.pmod(F.xxhash64(*ID, F.lit(len(rounds))), F.lit(2))
        x = elements.where(coin == 0).alias("x")
        y = elements.where(coin == 1).alias("y")
        step = x.join(y, F.expr("x.next_c = y.c AND x.next_a = y.a"), "full_outer")
        met = "x.c IS NOT NULL AND y.c IS NOT NULL"
        step = written(step.selectExpr(
            "coalesce(x.c, y.c) AS c", "coalesce(x.a, y.a) AS a",
            "if(y.c IS NOT NULL, y.next_c, x.next_c) AS next_c",
            "if(y.c IS NOT NULL, y.next_a, x.next_a) AS next_a",
            *[f"coalesce(x.{w}, 0L) + coalesce(y.{w}, 0L) AS {w}" for w in weights],
            # What was absorbed, and how far behind its absorber it starts.
            f"if({met}, y.c, NULL) AS gone_c", f"if({met}, y.a, NULL) AS gone_a",
            *[f"x.{w} AS gone_{w}" for w in weights],
        ), "ranking")
        rounds.append(step.where("gone_c IS NOT NULL"))
        elements = step.select(*columns)
    kind = ", ".join(f"{c} bigint" for c in [*ID, *weights])
    ranked = elements.coalesce(1).mapInArrow(_walk(weights), kind)
    for gone in reversed(rounds):
        ranked = written(ranked, "ranked")
        found = gone.alias("g").join(ranked.alias("r"), list(ID)).selectExpr(
            "g.gone_c AS c", "g.gone_a AS a", *[f"g.gone_{w} + r.{w} AS {w}" for w in weights]
        )
        ranked = ranked.unionByName(found)
    return ranked
