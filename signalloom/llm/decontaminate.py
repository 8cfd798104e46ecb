"""Benchmark passages in documents, also edited ones.

Rare n-grams of the benchmark's items are seeds. A first pass counts in how many
documents each occurs, so that each item keeps its rarest ones; a second pass finds
them in the documents. Where several seeds of an item lie close together, the item is
aligned with the words around them (Smith-Waterman), and the alignment's score, as a
share of a perfect copy's, tells copies and edited copies from chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from signalloom.llm import textvec as tv
from signalloom.llm.tables import written

SEED_WORDS = 3
# Seeds of an item that must meet in one place before it is aligned there; an item with
# fewer places for seeds needs all of them.
LEAST_SEEDS = 2
# A seed so many times as frequent as its item's median one is no seed.
COMMON = 8
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
# Words of benchmark items that are broadcast at once; a larger benchmark takes several passes.
SLICE_WORDS = 2_000_000

# Words are runs of letters and digits (all that isn't ASCII counts as such), lower-cased
# in the ASCII and Latin-1 ranges, so punctuation doesn't hide a copy.
_SEPARATES = np.ones(256, dtype=bool)
_SEPARATES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tv.Words:
    folded = tv.lower(np.where(_SEPARATES[data], np.uint8(32), data))
    upper = np.flatnonzero((folded[1:] >= 0x80) & (folded[1:] <= 0x9E) & (folded[:-1] == 0xC3)) + 1
    folded[upper] += 32
    return tv.words(folded, offsets)


@dataclass
class Items:
    """Benchmark items as word hashes, and their seeds sorted by hash."""

    ids: np.ndarray
    words: list[np.ndarray]
    hashes: np.ndarray  # of seeds, ascending, repeated where items share one
    item: np.ndarray  # index of the item each seed belongs to
    place: np.ndarray  # where in the item it begins

    def distinct(self) -> np.ndarray:
        return np.unique(self.hashes)


def read_items(rows: list, n: int = SEED_WORDS) -> Items:
    """Items of at least ``n`` words; others can't be told from chance and are left out."""
    data, offsets = tv.text_bytes(pa.array([r["text"] for r in rows], pa.string()))
    w = plain_words(data, offsets)
    first, hashes = tv.windows(w, n)
    begins = np.searchsorted(w.row, np.arange(len(rows) + 1))
    order = np.argsort(hashes, kind="stable")
    item = w.row[first]
    return Items(
        np.array([r["item_id"] for r in rows], dtype=object),
        [w.hashes[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)],
        hashes[order], item[order], (first - begins[item])[order],
    )


def seed_frequencies(docs: DataFrame, items: Items, n: int = SEED_WORDS) -> np.ndarray:
    """In how many documents each distinct seed occurs, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(items.distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        total = np.zeros(len(seeds), dtype=np.int64)
        for batch in batches:
            for _, data, offsets in tv.blocks(batch.column("text")):
                w = plain_words(data, offsets)
                first, hashes = tv.windows(w, n)
                at, found = lookup(seeds, hashes)
                if len(at):
                    pairs = np.unique(np.stack([w.row[first[at]], found]), axis=1)
                    total += np.bincount(pairs[1], minlength=len(seeds))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["seed", "n"])

    counted = docs.select("text").mapInArrow(count, "seed bigint, n bigint")
    out = np.zeros(len(items.distinct()), dtype=np.int64)
    for r in counted.groupBy("seed").agg(F.sum("n").alias("n")).collect():  # as many as seeds
        out[r["seed"]] = r["n"]
    return out


def lookup(seeds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices into ``hashes``, indices into ``seeds``) of the hashes that are seeds."""
    if not len(seeds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(seeds >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(hashes >> np.uint64(48)).astype(np.int64)])
    found = np.minimum(np.searchsorted(seeds, hashes[at]), len(seeds) - 1)
    right = seeds[found] == hashes[at]
    return at[right], found[right]


def rare_seeds(items: Items, frequency: np.ndarray) -> Items:
    """Each item keeps the seeds that aren't far more frequent than its median one.

    So at least half of an item's seeds stay, however often it was copied, and those that
    occur in its copies are rare by this measure, unlike common phrases.
    """
    of = frequency[np.searchsorted(items.distinct(), items.hashes)]
    # Item by item in one order: the middle one of each is its median.
    order = np.lexsort((of, items.item))
    owner = items.item[order]
    begins = np.searchsorted(owner, np.arange(len(items.ids)))
    counts = np.bincount(items.item, minlength=len(items.ids))
    median = np.zeros(len(items.ids), dtype=np.int64)
    some = counts > 0
    median[some] = of[order][(begins + counts // 2)[some]]
    kept = of <= COMMON * np.maximum(1, median)[items.item]
    return Items(items.ids, items.words, items.hashes[kept], items.item[kept], items.place[kept])


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: (best score, end of the best local alignment in ``words``)."""
    slope = -GAP * np.arange(1, len(words) + 1)
    above = np.zeros(len(words) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        step = above[:-1] + np.where(words == word, MATCH, MISMATCH)
        here = np.maximum(0, np.maximum(step, above[1:] + GAP))
        # A gap of any length to the left costs its length: a running maximum.
        here = np.maximum(here, np.maximum.accumulate(here + slope) - slope)
        above[1:] = here
        top = int(here.argmax())
        if here[top] > best:
            best, end = int(here[top]), top + 1
    return best, end


def locate(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(score, begin, end) of the best local alignment."""
    score, end = align(item, words)
    if not score:
        return 0, 0, 0
    back, length = align(item[::-1], words[:end][::-1])
    return score, end - length, end


def places(items: Items, w: tv.Words, n: int = SEED_WORDS) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, seeds, first word, last word) of where enough seeds of an item are close."""
    first, hashes = tv.windows(w, n)
    distinct = items.distinct()
    at, found = lookup(distinct, hashes)
    if not len(at):
        return
    low = np.searchsorted(items.hashes, distinct[found], "left")
    times = np.searchsorted(items.hashes, distinct[found], "right") - low
    at = np.repeat(first[at], times)
    seed = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    row, item, place = w.row[at], items.item[seed], items.place[seed]
    order = np.lexsort((at, item, row))
    row, item, place, at = row[order], item[order], place[order], at[order]
    length = np.array([len(words) for words in items.words])
    new = np.ones(len(at), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > length[item[1:]])
    cuts = np.append(np.flatnonzero(new), len(at))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        seeds, size = len(np.unique(place[a:b])), int(length[item[a]])
        if seeds >= min(LEAST_SEEDS, size - n + 1):
            # Room for the whole item on both sides, and for words put in.
            before = int((at[a:b] - place[a:b]).min()) - size // 2
            after = int((at[a:b] + size - place[a:b]).max()) + size // 2
            yield int(row[a]), int(item[a]), seeds, before, after


def find_copies(
    docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, slice_words: int = SLICE_WORDS
) -> DataFrame:
    """(doc_id, row_hash, item_id, score, n_seeds, begin, end): each item's best place in each row.

    ``score`` is the alignment's score over that of a whole copy, ``begin`` and ``end``
    the byte span in the text. Items with null text or fewer than ``n`` words, and null
    or empty documents, match nothing. Items are worked on in slices of a bounded number
    of words, so what is broadcast is bounded for any benchmark.
    """
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    slices = 1 + size // (2 * slice_words)  # a word takes two characters at least
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, row_hash bigint, item_id {item_kind}, score double, n_seeds int, begin bigint, end bigint"
    )
    own = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    found = None
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        known = read_items(part.orderBy("item_id", "text").collect(), n)
        hits = _find(own, rare_seeds(known, seed_frequencies(docs, known, n)), n, schema, benchmark.schema["item_id"].dataType)
        found = hits if found is None else found.unionByName(hits)
    return found


def _find(own: DataFrame, items: Items, n: int, schema: str, item_kind: DataType) -> DataFrame:
    shared = own.sparkSession.sparkContext.broadcast(items)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            best: dict[tuple[int, int], tuple] = {}
            for first_row, data, offsets in tv.blocks(batch.column("text")):
                w = plain_words(data, offsets)
                begins = np.searchsorted(w.row, np.arange(len(offsets)))
                for row, item, seeds, before, after in places(known, w, n):
                    a, b = max(before, begins[row]), min(after, begins[row + 1])
                    score, begin, end = locate(known.words[item], w.hashes[a:b])
                    if end == begin:
                        continue
                    score /= MATCH * len(known.words[item])
                    span = (w.starts[a + begin] - offsets[row], w.ends[a + end - 1] - offsets[row])
                    key = (first_row + row, item)
                    if key not in best or score > best[key][0]:
                        best[key] = (score, seeds, *map(int, span))
            rows = [key[0] for key in best]
            ids = [known.ids[key[1]] for key in best]
            columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "row_hash")]
            columns += [pa.array(ids, items_type), pa.array([v[0] for v in best.values()], pa.float64())]
            columns += [pa.array([v[1] for v in best.values()], pa.int32())]
            columns += [pa.array([v[i] for v in best.values()], pa.int64()) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "row_hash", "item_id", "score", "n_seeds", "begin", "end"]
            )

    items_type = to_arrow_type(item_kind)
    return own.mapInArrow(find, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The copies of ``find_copies`` whose score reaches the threshold."""
    return find_copies(docs, benchmark).where(F.col("score") >= threshold)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without rows that hold a copy, all columns and other rows kept."""
    found = written(contaminated(docs, benchmark, threshold).select("doc_id", "row_hash").distinct(), "copies")
    found = found.select(F.col("doc_id").alias("_doc"), F.col("row_hash").alias("_row"))
    own = docs.withColumn("_own", F.xxhash64("text"))
    return own.join(found, F.expr("doc_id <=> _doc AND _own = _row"), "left_anti").drop("_own")
