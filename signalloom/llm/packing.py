"""Documents packed into training sequences of a fixed number of tokens.

Lengths are whole numbers up to the capacity, so the packing is worked out on their
histogram, which is bounded whatever the documents: lengths above a third of the
capacity pair at most twice per sequence by greedy matching, shorter ones go where
the gap is tightest. The result is a short list of placements ("these 700 documents
of length 312 go to sequences 4,000 to 4,349, two each, from offset 3,400"); documents
are numbered within their length and look their place up.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalloom.llm import textvec as tv
from signalloom.llm.tables import written

CAPACITY = 4096
END_ID = 1
# Each length is numbered in so many parts: no length is one task's work.
PARTS = 1024
# Words, and ids of words, that a task remembers (32 and 4 bytes each).
REMEMBERED, REMEMBERED_IDS = 1 << 19, 1 << 22
# Bytes of text whose words are looked up at once, and words that are encoded at once.
BLOCK, TOGETHER = 1 << 20, 1000
# A word that ends in ASCII letters and then punctuation.
ENDED = re.compile(rb"(.*[A-Za-z])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)
IS_PUNCTUATION = np.zeros(256, dtype=bool)
IS_PUNCTUATION[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, … for each size, one after the other."""
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class WordIds:
    """Ids of whole texts, word by word; what it knows of words are flat arrays.

    The tokenizer must drop blanks, never join what stands on both sides of one, and part
    letters from punctuation; words, and their punctuated ends, can then be encoded on
    their own. Where A-Z means the same as a-z to it (``folded``), words are lower-cased.
    Words are known by their hash and length and the sum of their squared bytes; a block
    in which that fails to tell words apart is encoded text by text. A task's words are
    forgotten with it, and sooner where there are too many.
    """

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.folded = self._encode([b"Aa", b"Zz"])[0].tolist() == self._encode([b"aa", b"zz"])[0].tolist()
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has). Words are encoded many together, a blank apart."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), TOGETHER):
            text = b" ".join(words[i : i + TOGETHER]).decode("utf-8")
            # What comes back holds far more than ids: one at a time.
            encoded = self.tokenizer.encode(text, add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in text.split(" "))])
            # A token belongs to the word in which it starts.
            at = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            flat.append(np.array(encoded.ids, dtype=np.uint32))
            sizes.append(np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(starts) - 1))
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> None:
        text, parts = data.tobytes(), {}
        number = parts.setdefault
        pairs = []
        # A word's punctuated end is encoded apart, which leaves far fewer words.
        for a, b, closed in zip(starts.tolist(), ends.tolist(), IS_PUNCTUATION[data[ends - 1]].tolist(), strict=True):
            word = text[a:b]
            if closed and b"<|" not in word and (m := ENDED.fullmatch(word)):
                pairs += (number(m[1], len(parts)), number(m[2], len(parts)))
            else:
                pairs += (number(word, len(parts)), -1)
        flat, sizes = self._encode(list(parts))
        pairs = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        halves = np.where(pairs >= 0, sizes[pairs], 0)
        chosen = pairs[pairs >= 0]
        found = spread((np.cumsum(sizes) - sizes)[chosen], sizes[chosen])
        total = halves.sum(axis=1)
        begins = len(self.ids) + np.cumsum(total) - total
        self.ids = np.concatenate([self.ids, flat[found]])
        at = np.searchsorted(self.hashes, hashes)
        for name, values in (("hashes", hashes), ("checks", checks), ("begins", begins), ("sizes", total)):
            setattr(self, name, np.insert(getattr(self, name), at, values))

    def block_ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, each with the closing one, and how many each row has)."""
        if self.folded:
            # Special tokens are found before anything is lower-cased.
            marked = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
            plain = np.ones(len(offsets) - 1, dtype=bool)
            plain[np.searchsorted(offsets, marked, "right") - 1] = False
            data = np.where(np.repeat(plain, np.diff(offsets)), tv.lower(data), data)
        w = tv.words(data, offsets)
        squares = np.concatenate([[0], np.cumsum(data.astype(np.int64) ** 2)])
        checks = ((w.ends - w.starts) << 40) ^ (squares[w.ends] - squares[w.starts])
        if len(self.hashes) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self._forget()
        distinct, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        there = at < len(self.hashes)
        there[there] = self.hashes[at[there]] == distinct[there]
        if (checks != checks[first][which]).any() or (self.checks[at[there]] != checks[first[there]]).any():
            return self._one_by_one(data, offsets, end_id)
        new = np.flatnonzero(~there)
        if len(new):
            of = first[new]
            self._learn(data, w.starts[of], w.ends[of], distinct[new], checks[of])
            at = np.searchsorted(self.hashes, distinct)
        # The closing id stands behind a row's words like one more.
        closing = np.searchsorted(w.row, np.arange(1, len(offsets)), "left")
        begins = np.insert(self.begins[at][which], closing, len(self.ids))
        sizes = np.insert(self.sizes[at][which], closing, 1)
        rows = np.insert(w.row, closing, np.arange(len(offsets) - 1))
        ids = np.append(self.ids, np.uint32(end_id))[spread(begins, sizes)]
        return ids, np.bincount(rows, weights=sizes, minlength=len(offsets) - 1).astype(np.int64)

    def _one_by_one(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].tobytes().decode("utf-8") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        found = [np.array([*e.ids, end_id], dtype=np.uint32) for e in encoded]
        return np.concatenate(found), np.array([len(f) for f in found], dtype=np.int64)


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
    end_id: int = END_ID, keep_ids: bool = False,
) -> DataFrame:
    """Cut each document's ids: (doc_id, row_hash, piece, start, length, ids_crc32[, ids]).

    All pieces but the last hold ``capacity`` ids. Null text is empty: one piece with the
    closing id. Repeated rows are packed each. ids are little-endian 32-bit integers.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        # A vocabulary file: a few MB, whatever the documents.
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())

    kinds = {"piece": pa.int32(), "ids": pa.binary()}
    names = ["doc_id", "row_hash", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(vocabulary.value)
        for batch in batches:
            for row, data, offsets in tv.blocks(batch.column("text"), BLOCK):
                ids, lengths = words.block_ids(data, offsets, end_id)
                pieces = -(-lengths // capacity)
                owner = np.repeat(np.arange(len(lengths)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(lengths[owner] - start, capacity)
                begin = (np.cumsum(lengths) - lengths)[owner] + start
                flat = memoryview(ids.astype("<u4").tobytes())
                parts = [flat[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = {
                    "piece": piece, "start": start, "length": length, "ids_crc32": [zlib.crc32(p) for p in parts],
                }
                if keep_ids:
                    columns["ids"] = [bytes(p) for p in parts]
                taken = pa.array(row + owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(taken) for c in ("doc_id", "row_hash")]
                    + [pa.array(v, kinds.get(c, pa.int64())) for c, v in columns.items()],
                    names=names,
                )
                del data, offsets, ids, flat, parts, columns
        # What the task held goes back to the system, not only to the next task.
        pa.default_memory_pool().release_unused()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_hash bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    own = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    return own.mapInArrow(cut, schema + (", ids binary" if keep_ids else ""))


@dataclass
class Placement:
    """Items first..first+count-1 of ``length``, ``per_bin`` to a bin from ``first_bin`` on, from ``offset``."""

    length: int
    first: int
    count: int
    first_bin: int
    per_bin: int
    offset: int


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Pack ``counts[length]`` items of every length.

    The list is bounded by the capacity, not by the items: a step uses a length up or
    fills a run of equal gaps, and a filled run's gap is less than half of what it was.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # runs (bin, bins)
    open_gaps = np.zeros(capacity + 1, dtype=bool)
    out: list[Placement] = []
    bins = 0

    def put(length: int, count: int, first_bin: int, per_bin: int, offset: int) -> None:
        out.append(Placement(length, used[length], count, first_bin, per_bin, offset))
        used[length] += count
        left[length] -= count

    def leave(gap: int, first_bin: int, n: int) -> None:
        if n and gap:
            gaps[gap].append((first_bin, n))
            open_gaps[gap] = True

    # Large items: the longest ones take the longest partner that fits.
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:
        while left[s]:
            fitting = (p for p in large if p <= min(s, capacity - s) and left[p] > (p == s))
            partner = next(fitting, None)
            if partner is None:
                n = left[s]
                put(s, n, bins, 1, 0)
                leave(capacity - s, bins, n)
            elif partner == s:
                n = left[s] // 2
                put(s, 2 * n, bins, 2, 0)
                leave(capacity - 2 * s, bins, n)
            else:
                n = min(left[s], left[partner])
                put(s, n, bins, 1, 0)
                put(partner, n, bins, 1, s)
                leave(capacity - s - partner, bins, n)
            bins += n

    # Small items: the tightest gap that holds one; a bin stays the tightest until it is full.
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            found = int(open_gaps[s:].argmax()) + s
            if open_gaps[found]:
                first_bin, n = gaps[found].pop()
                open_gaps[found] = bool(gaps[found])
                gap = found
            else:
                gap, first_bin = capacity, bins
                n = -(-left[s] // (capacity // s))
                bins += n
            per_bin = gap // s
            whole = min(n, left[s] // per_bin)
            if whole:
                put(s, whole * per_bin, first_bin, per_bin, capacity - gap)
                leave(gap - per_bin * s, first_bin, whole)
            if whole < n:
                rest = left[s]  # fewer than a bin takes, if any
                if rest:
                    put(s, rest, first_bin + whole, rest, capacity - gap)
                    leave(gap - rest * s, first_bin + whole, 1)
                leave(gap, first_bin + whole + bool(rest), n - whole - bool(rest))
    return out


def number_by_length(pieces: DataFrame, parts: int = PARTS) -> DataFrame:
    """``pieces`` with ``nth``, numbering the pieces of each length from 0."""
    keyed = pieces.withColumn(
        "_part", F.pmod(F.xxhash64("doc_id", "row_hash", "piece"), F.lit(parts)).cast("int")
    )
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("length", "_part").agg(F.count("*").alias("_n")).select(
        "length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "row_hash", "piece")
    return (
        keyed.withColumn("_in", F.row_number().over(inside) - 1)
        .join(sizes, ["length", "_part"])
        .withColumn("nth", (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_part", "_before", "_in")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, parts: int = PARTS) -> DataFrame:
    """``pieces`` (doc_id, row_hash, piece, length, …) with ``sequence_id`` and ``offset``.

    ``pieces`` should be a written table: it is read for the histogram (at most
    ``capacity`` rows come to the driver) and again to be placed. A table without rows
    gives none.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    kind = "length bigint, first bigint, count bigint, first_bin bigint, per_bin bigint, at bigint"
    rows = spark.createDataFrame([astuple(p) for p in plan], kind)
    # One row per length, so the broadcast is bounded by the capacity as the plan is.
    by_length = rows.groupBy("length").agg(
        F.collect_list(F.struct("first", "count", "first_bin", "per_bin", "at")).alias("_plan")
    )
    placed = number_by_length(pieces, parts).join(F.broadcast(by_length), "length")
    placed = placed.withColumn(
        "_p", F.expr("filter(_plan, p -> nth >= p.first AND nth < p.first + p.count)[0]")
    ).withColumn("_i", F.expr("nth - _p.first"))
    return placed.select(
        *pieces.columns,
        F.expr("_p.first_bin + _i div _p.per_bin").alias("sequence_id"),
        F.expr("_p.at + (_i % _p.per_bin) * length").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """Tokenize, cut and pack ``docs``: one row per piece."""
    pieces = written(token_pieces(docs, tokenizer_path, capacity, keep_ids=keep_ids), "pieces")
    return pack(pieces, capacity).drop("row_hash")
