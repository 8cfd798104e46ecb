"""Conversations as a trie of shared turns, measured by an Euler tour.

A node is a distinct sequence of first turns. It is named by its smallest member and
its depth, so the nodes that a conversation names lie in a row, from where it parts from
all smaller ones to its end. Every node has an enter and an exit arc: enter goes to
the first child's enter (or the own exit), exit to the next sibling's enter (or the
parent's exit). That makes one list of all arcs; prefix sums along it at a node's two
arcs differ by what its subtree holds, however deep or wide the trie is.

Arcs that follow each other along one conversation are joined to runs first; the list
of runs is then ranked (``list_ranking``). Texts take no part beyond their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.list_ranking import BASE, prefix_sums
from signalloom.llm.tables import wide_hash, written
from signalloom.operators.numbering import SPLITS, number_rows, running

# Depths of one conversation whose arcs are joined to runs together.
STRETCH = 1024
# Conversation ids of one range, at most as many as it is wide, make one chunk of text.
ID_RANGE = 4096
WEIGHTS = ("arcs", "leaves", "saved")


def number_turns(conversations: DataFrame, splits: int = SPLITS) -> DataFrame:
    """(conv_id, i, h1, h2, bytes): the turns of each conversation numbered from 0.

    The order is that of ``turn``, null first; turns of one number are ordered by role
    and then by the hash of their text. Null role and text are empty. Rows without
    conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length in front keeps role and text apart.
    h1, h2 = wide_hash(F.octet_length(role), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        h1.alias("h1"), h2.alias("h2"), F.octet_length(text).cast("long").alias("bytes"),
    )
    numbered = number_rows(turns, ["conv_id"], ["turn", "role", "h1", "h2"], "i", ["turn"], splits)
    return numbered.select("conv_id", "i", "h1", "h2", "bytes")


def share_openings(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with their group's opening: (turns, conversations).

    Conversation c starts with the first h turns of conversation c - c % ``group`` (all
    if that has fewer, none if it doesn't exist), h = crc32(c) % ``most``; its own turns
    after its first h follow. The first result has (conv_id, d, h1, h2, bytes) with d
    from 1, the second (conv_id, depth) for every conversation, turnless ones with 0.
    """
    convs = turns.groupBy("conv_id").agg((F.max("i") + 1).alias("n")).withColumns({
        "h": F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most,
        "g": F.col("conv_id") - F.col("conv_id") % group,
    })
    sizes = convs.select(F.col("conv_id").alias("g"), F.col("n").alias("_n"))
    convs = convs.join(sizes, "g", "left").withColumn("b", F.expr("least(h, coalesce(_n, 0L))"))
    convs = written(convs.select("conv_id", "g", "h", "b", "n"), "openings")
    own = turns.join(convs.select("conv_id", "h", "b"), "conv_id").where("i >= h").selectExpr(
        "conv_id", "b + i - h + 1 AS d", "h1", "h2", "bytes"
    )
    # A turn opens fewer than twice ``group`` conversations.
    opening = turns.where(F.col("i") < most).withColumnRenamed("conv_id", "g").join(
        convs.select("conv_id", "g", "h"), "g"
    ).where("i < h").selectExpr("conv_id", "i + 1 AS d", "h1", "h2", "bytes")
    depths = convs.selectExpr("conv_id", "b + greatest(n - h, 0L) AS depth")
    return own.unionByName(opening), depths


def trie_nodes(turns: DataFrame, depths: DataFrame, splits: int = SPLITS) -> tuple[DataFrame, DataFrame]:
    """The nodes, and (conv_id, node_c, depth): the node each conversation ends at.

    Nodes have (c, d, p1, p2, q1, q2, n_convs, bytes): the smallest member, the depth,
    128-bit identities of the sequence and of its parent's, the members and the bytes
    of the last text. ``turns`` and ``depths`` are as ``share_openings`` returns them.
    """
    salted = turns.selectExpr(
        "conv_id", "d", "bytes", "xxhash64(h1, h2, d) AS s1", "xxhash64(d, h2, h1) AS s2"
    )
    # A sequence's identity is the exclusive or of its turns' hashes, salted by place.
    amounts = {"p1": ("bit_xor", "s1"), "p2": ("bit_xor", "s2")}
    placed = written(running(written(salted, "salted"), ["conv_id"], ["d"], amounts, splits=splits), "prefixes")
    nodes = placed.groupBy("d", "p1", "p2").agg(
        F.min("conv_id").alias("c"), F.max(F.expr("p1 ^ s1")).alias("q1"), F.max(F.expr("p2 ^ s2")).alias("q2"),
        F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
    )
    zero = F.lit(0).cast("long")
    root = depths.agg(F.min("conv_id").alias("c"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        "c", zero.alias("d"), *[zero.alias(x) for x in ("p1", "p2", "q1", "q2")], "n_convs", zero.alias("bytes")
    )
    nodes = written(nodes.unionByName(root), "nodes")
    ends = placed.join(depths.withColumnRenamed("depth", "d"), ["conv_id", "d"]).select("conv_id", "d", "p1", "p2")
    ends = ends.unionByName(depths.where("depth = 0").select("conv_id", "depth", zero.alias("p1"), zero.alias("p2"))
                            .withColumnRenamed("depth", "d"))
    named = ends.join(nodes.select("d", "p1", "p2", F.col("c").alias("node_c")), ["d", "p1", "p2"])
    return nodes, named.select("conv_id", "node_c", F.col("d").alias("depth"))


def with_family(nodes: DataFrame, splits: int = SPLITS) -> DataFrame:
    """``nodes`` with parent_c (null for the root), n_children, first_c, next_c.

    Children are ordered by their smallest members; ``next_c`` is the next sibling.
    """
    up = nodes.selectExpr("c AS parent_c", "d + 1 AS d", "p1 AS q1", "p2 AS q2")
    # The root may be most nodes' parent: there is one, so it isn't joined.
    root = nodes.where("d = 0").agg(F.min("c")).scalar()
    low = nodes.where("d <= 1").withColumn("parent_c", F.when(F.col("d") == 1, root))
    linked = low.unionByName(nodes.where("d > 1").join(up.where("d > 1"), ["d", "q1", "q2"]))
    linked = written(linked.select("c", "d", "parent_c", "n_convs", "bytes"), "linked")
    children = linked.where("d > 0").select("c", "d", "parent_c")
    counted = children.groupBy("parent_c", "d").agg(F.count("*").alias("n_children"), F.min("c").alias("first_c"))
    counted = counted.selectExpr("parent_c AS c", "d - 1 AS d", "n_children", "first_c")
    numbered = written(number_rows(children, ["parent_c", "d"], ["c"], "nth", splits=splits), "siblings")
    following = numbered.select("parent_c", "d", F.col("c").alias("next_c"), (F.col("nth") - 1).alias("nth"))
    following = numbered.join(following, ["parent_c", "d", "nth"]).select("c", "d", "next_c")
    return linked.join(counted, ["c", "d"], "left").join(following, ["c", "d"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long"))
    )


def tour(family: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The arcs (c, a, succ_c, succ_a, weights, run_c, run_a, before …), a written table.

    ``a`` is twice the depth for an enter arc, and one more for an exit arc. ``run_c``
    and ``run_a`` name the first arc of the run an arc belongs to, ``before_*`` are the
    run's weights before the arc. A conversation's arcs are taken in stretches of
    depths, so no conversation is one task's work.
    """
    arcs = family.selectExpr("c", "d", f"d div {stretch} AS part", """inline(array(
        named_struct('a', 2 * d, 'at', d,
            'succ_c', coalesce(first_c, c), 'succ_a', if(n_children > 0, 2 * d + 2, 2 * d + 1),
            'arcs', 1L, 'leaves', if(n_children = 0, 1L, 0L), 'saved', (n_convs - 1) * bytes),
        named_struct('a', 2 * d + 1, 'at', 4611686018427387904L - d,
            'succ_c', coalesce(next_c, parent_c), 'succ_a', if(next_c IS NOT NULL, 2 * d, 2 * d - 1),
            'arcs', 1L, 'leaves', 0L, 'saved', 0L)))""")
    arcs = arcs.withColumn("succ_a", F.expr("if(succ_c IS NULL, NULL, succ_a)"))
    along = Window.partitionBy("c", "part").orderBy("at")
    follows = (F.lag("succ_c").over(along) == F.col("c")) & (F.lag("succ_a").over(along) == F.col("a"))
    arcs = arcs.withColumn("starts", F.when(follows, 0).otherwise(1))
    arcs = arcs.withColumn("run", F.sum("starts").over(along))
    inside = Window.partitionBy("c", "part", "run").orderBy("at")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    arcs = arcs.withColumns(
        {"run_c": F.col("c"), "run_a": F.first("a").over(inside)}
        | {f"before_{w}": F.coalesce(F.sum(w).over(earlier), F.lit(0).cast("long")) for w in WEIGHTS}
    )
    return written(arcs.drop("part", "at", "starts", "run"), "tour")


def subtree_totals(arcs: DataFrame, base: int = BASE) -> DataFrame:
    """(c, d, n_nodes, n_leaves, saved) of every node's subtree, from a ``tour``."""
    last = F.struct("before_arcs", "succ_c", "succ_a")
    runs = arcs.groupBy("run_c", "run_a").agg(
        F.max(last).alias("last"), *[F.sum(w).alias(w) for w in WEIGHTS]
    ).selectExpr("run_c AS c", "run_a AS a", "last.succ_c AS next_c", "last.succ_a AS next_a", *WEIGHTS)
    ranked = prefix_sums(written(runs, "runs"), WEIGHTS, base)
    ranked = ranked.selectExpr("c AS run_c", "a AS run_a", *[f"{w} AS head_{w}" for w in WEIGHTS])
    placed = arcs.join(ranked, ["run_c", "run_a"]).selectExpr(
        "c", "a div 2 AS d", "a % 2 AS side", *[f"head_{w} + before_{w} AS {w}" for w in WEIGHTS]
    )
    # What stands before the exit but not before the enter arc is the subtree's.
    sides = {w: f"sum(if(side = 1, {w}, -{w}))" for w in WEIGHTS}
    return placed.groupBy("c", "d").agg(
        F.expr(f"({sides['arcs']} + 1) div 2").alias("n_nodes"), F.expr(sides["leaves"]).alias("n_leaves"),
        F.expr(sides["saved"]).alias("saved"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each node's chunks, which come in order; only the running hash is kept."""
    node, hashed = None, None
    for batch in batches:
        done: list[list] = [[], [], []]
        for c, d, chunk in zip(*(batch.column(x).to_pylist() for x in ("c", "d", "chunk")), strict=True):
            if (c, d) != node:
                if node is not None:
                    for column, value in zip(done, (*node, hashed.hexdigest()), strict=True):
                        column.append(value)
                node, hashed = (c, d), hashlib.sha256()
            else:
                hashed.update(b",")
            hashed.update(chunk.encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())],
            names=["c", "d", "ends_sha256"],
        )
    if node is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([hashed.hexdigest()])],
            names=["c", "d", "ends_sha256"],
        )


def end_digests(ends: DataFrame, id_range: int = ID_RANGE) -> DataFrame:
    """(c, d, ends_sha256): the digest of the ids that end at a node, ascending, comma-joined.

    Ids are joined per range of ids in parallel; a node with very many of them then costs
    one task the hashing of few rows, one after the other.
    """
    chunks = ends.withColumn("part", F.floor(F.col("conv_id") / F.lit(id_range))).groupBy(
        F.col("node_c").alias("c"), F.col("depth").alias("d"), "part"
    ).agg(F.expr("array_join(transform(array_sort(collect_list(conv_id)), x -> cast(x AS string)), ',')").alias("chunk"))
    dealt = chunks.repartition("c", "d").sortWithinPartitions("c", "d", "part")
    return dealt.select("c", "d", "chunk").mapInArrow(_digests, "c bigint, d bigint, ends_sha256 string")


def prefix_trie(
    turns: DataFrame, depths: DataFrame, splits: int = SPLITS, stretch: int = STRETCH,
    base: int = BASE, id_range: int = ID_RANGE,
) -> DataFrame:
    """The trie of ``turns`` (conv_id, d, h1, h2, bytes) and ``depths`` (conv_id, depth).

    One row per node, the textless root included: conv_id (smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_nodes, n_leaves,
    saved_tokens (bytes of last texts that members share, over the subtree) and
    ends_sha256 (digest of the members that end there). Without conversations no rows.
    """
    turns = written(turns, "rebuilt")
    nodes, ends = trie_nodes(turns, depths, splits)
    family = written(with_family(nodes, splits), "family")
    totals = subtree_totals(tour(family, stretch), base)
    digests = end_digests(ends, id_range)
    nothing = hashlib.sha256(b"").hexdigest()
    return family.join(totals, ["c", "d"]).join(digests, ["c", "d"], "left").select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent_c").alias("parent_conv_id"),
        "n_convs", "n_children", "n_nodes", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame, **sizes: int) -> DataFrame:
    """``prefix_trie`` of ``conversations`` (conv_id, turn, role, text) with shared openings.

    Other columns are ignored. Null and tied turns: see ``number_turns``.
    """
    turns = written(number_turns(conversations, sizes.get("splits", SPLITS)), "turns")
    return prefix_trie(*share_openings(turns), **sizes)
