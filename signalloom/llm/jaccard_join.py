"""Documents whose word n-gram sets are alike, linked by an exact similarity join.

Sets are joined on the n-grams of their prefixes: with n-grams in rare-first order,
two sets as similar as asked for share one among the first ``n - need + 1``. Length,
positional and suffix filters, all of them upper bounds of the overlap, leave few
pairs; a pair is verified once, on the whole sets.

Copies make no work: equal sets are one class, represented by the smallest doc_id.
Near copies don't make all their pairs either, as only connected components are
asked for. First each set meets one leader of each of its prefix n-grams, then more and
more of them, in groups not yet connected. Once all pairs across the components found so
far are no more work than the next leaders, every one that passes the filters is verified.
Before each round rows go that share their n-gram with no set of a similar size in another
component; what is left is moved without histograms and earlier n-grams until sets meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm import textvec as tv
from signalloom.llm.components import components
from signalloom.llm.tables import written

WORDS = 4
PERCENT = 85
# Counters of the frequency sketches of words and of n-grams. More of them tell rare ones
# better apart; the order of n-grams never changes the result.
SKETCH = 1 << 20
CHUNK = 1 << 14
# Cells of the suffix filter's histogram, where they are full, how many leaders of an
# n-gram a set meets in the first rounds, and how many times more in each one after them.
CELLS = 64
FULL = 127
LEADERS = (1, 4, 16)
MORE = 4
# Shared n-grams before each one that are kept with it.
EARLIER = 8
# Up to so many ids (16 MB) are broadcast to pick their rows; more are joined.
BROADCAST_IDS = 2_000_000


def cell(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes % np.uint64(size)).astype(np.int64)


def grams(
    data: np.ndarray, offsets: np.ndarray, n: int, word_ranks: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, commonness) of the distinct word n-grams of each row, by row and hash.

    A row with fewer than ``n`` words, but any, has its whole sequence as one n-gram.
    Commonness is the sum of the words' ranks, 0 without ``word_ranks``.
    """
    w = tv.words(tv.lower(data), offsets)
    first, hashes = tv.windows(w, n)
    rows = w.row[first]
    common = np.zeros(len(first), dtype=np.int64)
    if word_ranks is not None:
        total = np.concatenate([[0], np.cumsum(word_ranks[cell(w.hashes, len(word_ranks))].astype(np.int64))])
        common = total[first + n] - total[first]
    counts = np.bincount(w.row, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        begins = np.searchsorted(w.row, short)
        whole = np.array(
            [tv.windows(tv.Words(w.starts[b:e], w.ends[b:e], w.row[b:e], w.hashes[b:e]), e - b)[1][0]
             for b, e in zip(begins, begins + counts[short], strict=True)], dtype=np.uint64,
        )
        rows = np.concatenate([rows, short])
        common = np.concatenate([common, np.zeros(len(short), np.int64)])
        hashes = np.concatenate([hashes, tv.mix(whole + counts[short].astype(np.uint64))])
    order = np.lexsort((hashes, rows))
    rows, hashes, common = rows[order], hashes[order], common[order]
    if len(rows):
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])])
        rows, hashes, common = rows[new], hashes[new], common[new]
    return rows, hashes, common


def _sets(
    batch: pa.RecordBatch, n: int, word_ranks: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row of the block, ends of each row's n-grams, hashes, commonness)."""
    for row, data, offsets in tv.blocks(batch.column("text")):
        rows, hashes, common = grams(data, offsets, n, word_ranks)
        yield row, np.searchsorted(rows, np.arange(len(offsets)), "left"), hashes, common


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Lists of the given lengths, one after the other from ``values``."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def signatures(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, n_grams, h1, h2): the size of each document's set and its 128-bit identity."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for _, ends, hashes, _ in _sets(batch, n):
                parts[0].append(np.diff(ends))
                for part, salt in ((parts[1], 1), (parts[2], 2)):
                    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
                    np.cumsum(tv.mix(hashes + np.uint64(salt)), out=total[1:])
                    part.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
            columns = [batch.column("doc_id"), *[pa.array(np.concatenate(p)) for p in parts]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_grams", "h1", "h2"])

    return docs.select("doc_id", "text").mapInArrow(
        sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_grams bigint, h1 bigint, h2 bigint"
    )


@dataclass
class Ranks:
    """How common words and n-grams are, by sketch counter."""

    words: np.ndarray  # 0 to 255, eight steps a doubling
    grams: np.ndarray  # 0 up to what chance puts into a counter, then two steps a doubling

    @classmethod
    def of(cls, words: np.ndarray, grams: np.ndarray) -> Ranks:
        mean = grams.mean() if len(grams) else 0
        usual = mean + 6 * np.sqrt(mean) + 4
        high = np.where(grams > usual, 1 + 2 * np.log2(np.maximum(grams, 1) / usual), 0)
        return cls(
            np.minimum(255, 8 * np.log2(1 + words)).astype(np.uint8), np.minimum(255, high).astype(np.uint8)
        )


def frequency_ranks(docs: DataFrame, n: int = WORDS, sketch: int = SKETCH) -> Ranks:
    """Counts of all words and n-grams of all documents in sketches of a fixed size.

    Every task counts its documents into two arrays of ``sketch`` counters and sends
    chunks of them; these are added up by chunk, and the sums (16 MB) reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * sketch, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in tv.blocks(batch.column("text")):
                w = tv.words(tv.lower(data), offsets)
                total[:sketch] += np.bincount(cell(w.hashes, sketch), minlength=sketch)
                _, hashes = tv.windows(w, n)
                total[sketch:] += np.bincount(cell(hashes, sketch), minlength=sketch)
        chunks = [c for c in range(0, 2 * sketch, CHUNK) if total[c : c + CHUNK].any()]
        values = [total[c : c + CHUNK] for c in chunks]
        values = [v.astype("<u4" if v.max() < 1 << 32 else "<u8").tobytes() for v in values]
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunks, pa.int32()), pa.array(values, pa.binary())], names=["chunk", "counts"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = min(CHUNK, 2 * sketch - chunk)
                values = np.frombuffer(counts, f"<u{len(counts) // size}").astype(np.int64)
                totals[chunk] = totals[chunk] + values if chunk in totals else values
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())],
            names=["chunk", "counts"],
        )

    kind = "chunk int, counts binary"
    counted = docs.select("text").mapInArrow(count, kind)
    total = np.zeros(2 * sketch, dtype=np.int64)
    for r in counted.repartition(16, "chunk").mapInArrow(add, kind).collect():
        values = np.frombuffer(r["counts"], np.int64)
        total[r["chunk"] : r["chunk"] + len(values)] = values
    return Ranks.of(total[:sketch], total[sketch:])


def need(percent: int, n: str, m: str) -> str:
    """SQL of the least overlap of similar sets with ``n`` and ``m`` members."""
    return f"cast(ceil({percent} * ({n} + {m}) / {100 + percent}) AS bigint)"


def prefixes(docs: DataFrame, n: int, percent: int, ranks: Ranks) -> DataFrame:
    """(doc_id, n, prefix, cells, fine): rare-first prefix and histograms of each non-empty set.

    N-grams that many documents share come last, and before them those of common words:
    that is rare-first without a count of every n-gram. ``cells`` counts the members per
    hash cell; FULL stands for that many or more. ``fine`` has as many cells as keep two to
    four members each, CELLS at least: by CELLS alone long sets look alike.
    """
    spread = docs.sparkSession.sparkContext.broadcast(ranks)  # of a fixed size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        for batch in batches:
            for row, ends, hashes, common in _sets(batch, n, known.words):
                size = np.diff(ends)
                owner = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((hashes, common, known.grams[cell(hashes, len(known.grams))], owner))
                length = size - -(-percent * size // 100) + 1
                kept = np.arange(len(hashes)) - ends[owner] < length[owner]
                hist = np.bincount(
                    owner * CELLS + (hashes >> np.uint64(58)).astype(np.int64) % CELLS,
                    minlength=len(size) * CELLS,
                )
                bits = np.maximum(CELLS.bit_length() - 1, np.frexp(size)[1] - 2)
                first = np.concatenate([[0], np.cumsum(1 << bits)])
                fine = np.bincount(
                    first[owner] + (hashes >> (64 - bits[owner]).astype(np.uint64)).astype(np.int64),
                    minlength=first[-1],
                )
                full = np.flatnonzero(size)
                fine = np.minimum(fine, FULL).astype(np.int8)[np.repeat(size > 0, 1 << bits)]
                hist = np.minimum(hist, FULL).astype(np.int8).reshape(len(size), CELLS)[full]
                prefix = hashes[order].view(np.int64)[kept]
                # A batch per block: what is on its way stays small.
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row + full)), pa.array(size[full]),
                     _lists(prefix, length[full]), _lists(hist.ravel(), np.full(len(full), CELLS)),
                     _lists(fine, 1 << bits[full])],
                    names=["doc_id", "n", "prefix", "cells", "fine"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, n bigint, prefix array<bigint>, cells array<tinyint>, fine array<tinyint>"
    )


def gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, grams): the whole sets."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ends, hashes, _ in _sets(batch, n):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(ends) - 1), _lists(hashes.view(np.int64), np.diff(ends))],
                    names=["doc_id", "grams"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, grams array<bigint>")


def _overlap_bound(x: str, y: str) -> str:
    """SQL of the most that sets with these histograms can have in common."""
    return f"""aggregate(zip_with({x}, {y}, (p, q) -> CASE WHEN p >= {FULL} AND q >= {FULL} THEN 1000000000
        ELSE cast(least(p, q) AS bigint) END), 0L, (s, v) -> s + v)"""


def _similar_bounds(percent: int, once: bool = True) -> Column:
    """Length, positional and suffix filters for rows x and y that share an n-gram.

    If it is the first one they share, what is left of both bounds their overlap; if it
    isn't, the first one has let the pair through already. The histograms bound the
    overlap whatever they share. ``once`` leaves out n-grams with an earlier shared one
    among the few before them, so that a pair doesn't come up at every one it shares;
    its first one never is left out.
    """
    least_overlap = need(percent, "x.n", "y.n")
    earlier = "AND NOT arrays_overlap(x.before, y.before)" if once else ""
    return F.expr(f"""
        100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
        AND least(x.n - x.pos, y.n - y.pos) >= {least_overlap} {earlier}
        AND {_overlap_bound("x.cells", "y.cells")} >= {least_overlap}""")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is among ``ids``, a written table: broadcast if counted to be small."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, "doc_id", "left_semi")


def _likely(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """The pairs whose fine histograms leave open that their sets are similar."""
    x = cells.select(F.col("doc_id").alias("a"), F.col("n").alias("_n"), F.col("fine").alias("_x"))
    y = cells.select(F.col("doc_id").alias("b"), F.col("n").alias("_m"), F.col("fine").alias("_y"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b")
    # Of two sizes of histograms, that differ by a factor of two, the larger one is folded.
    fold = "transform(sequence(1, {1}), i -> int(element_at({0}, 2 * i - 1)) + int(element_at({0}, 2 * i)))"
    for one, other in (("_x", "_y"), ("_y", "_x")):
        same = f"transform({one}, v -> int(v))"
        both = both.withColumn(f"{one}f", F.expr(
            f"CASE WHEN size({one}) > size({other}) THEN {fold.format(one, f'size({other})')} ELSE {same} END"
        ))
    similar = f"""100 * least(_n, _m) >= {percent} * greatest(_n, _m)
        AND (greatest(size(_x), size(_y)) > 2 * least(size(_x), size(_y))
             OR {_overlap_bound("_xf", "_yf")} >= {need(percent, "_n", "_m")})"""
    return both.where(similar).select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("_x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("_y"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b")
    both = both.withColumn("_common", F.size(F.array_intersect("_x", "_y")))
    union = "(size(_x) + size(_y) - _common)"
    return both.where(f"100L * _common >= {percent}L * {union}").select("a", "b").distinct()


def _with_component(rows: DataFrame, key: str, found: DataFrame, name: str) -> DataFrame:
    found = found.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    joined = rows.join(found, F.col(key) == F.col("_node"), "left")
    return joined.withColumn(name, F.coalesce("_component", key)).drop("_node", "_component")


def representatives(signed: DataFrame) -> DataFrame:
    """(h1, h2, rep): the smallest doc_id of each class of equal sets."""
    return signed.where("n_grams > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep")
    )


def similarity_links(
    docs: DataFrame, reps: DataFrame, n: int = WORDS, percent: int = PERCENT,
    leaders: tuple[int, ...] = LEADERS,
) -> DataFrame:
    """(node, component) of the representatives that are linked, directly or over others."""
    ranks = frequency_ranks(docs, n)
    ids = written(reps.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    cut = written(only(prefixes(docs, n, percent, ranks), ids), "prefixes")
    cells = cut.select(F.col("doc_id").alias("id"), F.col("n").alias("_n"), "cells").distinct()
    placed = cut.select(F.col("doc_id").alias("id"), "n", F.posexplode("prefix").alias("pos", "gram"))
    shared = F.count("*").over(Window.partitionBy("gram"))
    placed = placed.withColumn("_rows", shared).where("_rows > 1").drop("_rows").withColumn("component", F.col("id"))

    def meet(rows: DataFrame, turn: int, count: int) -> DataFrame:
        """Pairs of all rows with the leaders of their n-grams, chosen anew each turn."""
        joined = rows.alias("x").join(rows.where(f"nth <= {count}").alias("y"), "gram").where("x.id <> y.id")
        if turn:
            joined = joined.where("x.component <> y.component")
        return _pairs(joined.where(_similar_bounds(percent, once=turn > 0)))

    def meet_all(rows: DataFrame) -> DataFrame:
        """What isn't in its group's largest component meets all of the group but its own component."""
        joined = rows.where("component <> major").alias("x").join(rows.alias("y"), "gram").where(
            "x.component <> y.component AND (y.component = y.major OR x.id < y.id)"
        )
        return _pairs(joined.where(_similar_bounds(percent)))

    sets = done = found = None
    turn, count, last = 0, leaders[0], False
    while not last:
        if turn:
            # Groups with one row more than leaders, or fewer, have met completely.
            placed = rows.where(f"members > {count + 1}").select("id", "n", "pos", "gram").distinct()
            placed = _with_component(placed, "id", found, "component")
        rows = written(_with_sets(_in_groups(_with_partners(placed, percent), turn), cells), "open")
        if turn:
            left = rows.agg(
                F.count("*").alias("rows"), F.sum(F.expr("CASE WHEN component <> major THEN members END")).alias("pairs")
            ).first()
            if not left["rows"]:
                break
            count = leaders[turn] if turn < len(leaders) else MORE * count
            last = left["pairs"] <= count * left["rows"]
        new = meet_all(rows) if last else meet(rows, turn, count)
        if done is not None:
            new = new.join(done, ["a", "b"], "left_anti")
        new = written(new, "pairs")
        done = new if done is None else done.unionByName(new)
        likely = written(_likely(new, only(cut, written(_members(new), "met")), percent), "likely")
        asked = lacking = written(_members(likely), "asked")
        if sets is not None:
            lacking = written(asked.join(sets.select("doc_id"), "doc_id", "left_anti"), "lacking")
        more = written(gram_sets(only(docs, lacking), n), "sets")
        sets = more if sets is None else sets.unionByName(more)
        similar = written(_verified(likely, only(sets, asked), percent), "links")
        if found is None:
            found = components(similar)
        elif not similar.isEmpty():
            # What was found is stars already: only the new links are contracted.
            stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = components(stars.unionByName(similar))
        turn += 1
    return found


def _with_partners(placed: DataFrame, percent: int) -> DataFrame:
    """Rows that share their n-gram with a row of a similar size in another component.

    Sizes of similar sets are of the same class or of neighbouring ones; classes are a
    little wider than that takes, for rounding.
    """
    width = math.log(100 / percent) + 0.001
    near = Window.partitionBy("gram").orderBy("size").rangeBetween(-1, 1)
    rows = placed.withColumn("size", F.floor(F.log("n") / width).cast("int"))
    rows = rows.withColumn("_lo", F.min("component").over(near)).withColumn("_hi", F.max("component").over(near))
    return rows.where("_lo < _hi").drop("size", "_lo", "_hi")


def _in_groups(rows: DataFrame, turn: int) -> DataFrame:
    """With the rows of each n-gram, its largest component, and each row's place as a leader.

    A set has the same rank in all its groups, so near copies meet few different leaders.
    """
    group = Window.partitionBy("gram")
    rows = rows.withColumn("members", F.count("*").over(group))
    if turn:
        rows = rows.withColumn("_part", F.count("*").over(Window.partitionBy("gram", "component")))
        rows = rows.withColumn("major", F.max_by("component", F.struct("_part", "component")).over(group)).drop("_part")
    order = group.orderBy(F.xxhash64("id", F.lit(turn)), "id", "n")
    return rows.withColumn("nth", F.row_number().over(order))


def _with_sets(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """With the histogram of each row's set and the n-grams of the set just before the row's."""
    rows = rows.join(cells, "id").where("n = _n").drop("_n")
    # Tells apart sets that share an id.
    rows = rows.withColumn("_which", F.xxhash64("n", "cells"))
    earlier = Window.partitionBy("id", "_which").orderBy("pos").rowsBetween(-EARLIER, -1)
    return rows.withColumn("before", F.collect_list("gram").over(earlier)).drop("_which")


def join_documents(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_grams, component_id) for every row of ``docs``.

    Two documents are linked if their sets of word n-grams have ``percent`` of their
    union in common; A-Z is lower-cased, words are separated by ASCII blanks. A text
    with fewer words has its whole sequence as one n-gram; without words (or null) it
    is linked with nothing. ``component_id`` is the smallest doc_id reachable by links.
    Rows that share a doc_id are one document: it has the links of all of them. Rows
    without doc_id are linked with nothing and have no component.
    """
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs, n), "signatures")
    reps = written(representatives(signed), "representatives")
    found = similarity_links(docs, reps, n, percent)
    rows = signed.where("n_grams > 0 AND doc_id IS NOT NULL").join(reps, ["h1", "h2"])
    # A doc_id with several texts belongs to several classes and connects them.
    several = rows.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    several = written(
        rows.join(several.where("lo < hi").select("doc_id"), "doc_id").select(
            F.col("rep").alias("a"), F.col("doc_id").alias("b")
        ).distinct(),
        "several",
    )
    if not several.isEmpty():
        found = components(
            several.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        )
    by_class = _with_component(reps, "rep", found, "component_id").drop("rep")
    linked = signed.where("n_grams > 0 AND doc_id IS NOT NULL").join(by_class, ["h1", "h2"])
    alone = signed.where("n_grams = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_grams", "component_id"]
    return linked.select(*columns).unionByName(alone.select(*columns))
