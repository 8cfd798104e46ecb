"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.tables import written


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every row with the least of u and all v it occurs with.

    The least is aggregated before it is shuffled and joined back, so a node with very
    many links is split like any skewed join key.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("_v")).select(
        F.col("u").alias("_u"), F.least("u", "_v").alias("m")
    )
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); component is its smallest node.

    Large and small stars in turn until nothing changes: a number of rounds that grows
    with the logarithm of the longest path. Each round is written, so none runs twice.
    """
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    edges, state = written(edges, "edges"), None
    while True:
        mark = edges.agg(
            F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0)).alias("s")
        ).first()
        if mark == state or mark["n"] == 0:
            break
        state = mark
        # Large star: larger neighbours of u move to its least neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: smaller neighbours of u, and u, move to the least of them.
        small = _star(large.where("u > v").distinct())
        edges = written(
            small.select(F.inline(F.array(
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            ))).where("u > v").distinct(),
            "edges",
        )
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
