"""Quality scores by the votes of the nearest labelled documents.

Texts become hashed character n-gram vectors, weighted by rarity and projected onto the
leading directions of a labelled sample (latent semantic analysis). The sample's vectors
are broadcast, their number being a parameter; every document's cosines with all of them
are computed in blocks, and the nearest ones vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm import textvec as tv

# Labelled rows learned from, per label (about): bounds the fit and the broadcast.
SAMPLE = 1500
BUCKETS = 4096
# The first buckets count words that repeat the word before them, which no n-gram shows:
# several of them, so that repetition weighs as much as a handful of n-grams.
REPEATS = 16
DIMENSIONS = 64
NEIGHBOURS = 25
# Similarities are raised to this power, so near neighbours outvote far ones.
SHARPNESS = 4
ROWS = 256


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x BUCKETS: counts of the byte trigrams inside each row, and of repeated words."""
    n = len(offsets) - 1
    w = tv.words(data, offsets)
    again = np.flatnonzero((w.hashes[1:] == w.hashes[:-1]) & (w.row[1:] == w.row[:-1])) + 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    value = data.astype(np.uint32)
    gram = (value[:-2] | value[1:-1] << np.uint32(8) | value[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
    inside = row[:-2] == row[2:]
    bucket = (gram >> np.uint32(20)).astype(np.int64)[inside]
    bucket = np.maximum(bucket, REPEATS)
    place = np.concatenate([row[:-2][inside] * BUCKETS + bucket, w.row[again] * BUCKETS + again % REPEATS])
    total = np.bincount(place, minlength=n * BUCKETS)
    return total.reshape(n, BUCKETS)


def row_blocks(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Blocks of a bounded number of bytes and rows (one row at least)."""
    for first, data, offsets in tv.blocks(column):
        for a in range(0, len(offsets) - 1, ROWS):
            b = min(a + ROWS, len(offsets) - 1)
            yield (slice(first + a, first + b), data[offsets[a] : offsets[b]],
                   offsets[a : b + 1] - offsets[a])


@dataclass
class Neighbours:
    idf: np.ndarray  # BUCKETS
    basis: np.ndarray  # BUCKETS x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, of length 1
    good: np.ndarray  # the rows' labels, 0 or 1
    weight: np.ndarray  # undoes the sample's balance
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts).astype(np.float32) * self.idf
        latent = weighted @ self.basis
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def scores(self, latent: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """The weighted share of good labels among each row's ``k`` nearest ones.

        Rows without a similar neighbour, like empty texts, get the share of all.
        """
        if not len(self.vectors):
            return np.full(len(latent), self.prior)
        cosines = latent @ self.vectors.T
        k = min(k, cosines.shape[1])
        nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        near = np.maximum(np.take_along_axis(cosines, nearest, axis=1), 0) ** SHARPNESS
        near = near * self.weight[nearest]
        total = near.sum(1)
        votes = (near * self.good[nearest]).sum(1)
        return np.clip(np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior), 0, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(quality, n, text): about ``sample`` rows of each label, n being all rows of the label.

    Rows are chosen by the hash of their id, the share to keep following from the counts.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality").distinct()
    counts = known.groupBy("quality").agg(F.count("*").alias("n"))  # two rows
    chosen = known.join(F.broadcast(counts), "quality").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(sample) / F.col("n") * (1 << 30)
    )
    # About 2 x sample rows, whatever the tables.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "n", "text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 11) -> Neighbours:
    """Fit the projection on a labelled sample and keep its vectors and labels.

    The driver gets one sparse count vector per sampled row. Without labels every text
    scores 0.5.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span, data, offsets in row_blocks(batch.column("text")):
                counts = term_counts(data, offsets)
                some = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("quality")[span], batch.column("n")[span],
                     pa.array([s.astype(np.int32) for s in some], pa.list_(pa.int32())),
                     pa.array([c[s].astype(np.int32) for c, s in zip(counts, some, strict=True)], pa.list_(pa.int32()))],
                    names=["quality", "n", "buckets", "counts"],
                )

    kind = "quality int, n bigint, buckets array<int>, counts array<int>"
    rows = labelled_sample(docs, labels, sample).selectExpr("cast(quality AS int) AS quality", "n", "text")
    rows = sorted(rows.mapInArrow(count, kind).collect(), key=lambda r: (r["quality"], r["buckets"], r["counts"]))
    counts = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for c, r in zip(counts, rows, strict=True):
        c[r["buckets"]] = r["counts"]
    good = np.array([r["quality"] for r in rows], dtype=np.float32)
    of_label = {r["quality"]: r["n"] for r in rows}
    prior = of_label.get(1, 0) / sum(of_label.values()) if rows else 0.5
    sampled = {q: max(1, int((good == q).sum())) for q in (0, 1)}
    weight = np.array([r["n"] / sampled[r["quality"]] for r in rows], dtype=np.float32)
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    weighted = np.log1p(counts) * idf
    # Leading right singular vectors by randomised subspace iteration.
    size = min(DIMENSIONS, BUCKETS)
    basis = np.random.default_rng(seed).standard_normal((BUCKETS, size)).astype(np.float32)
    for _ in range(4 if len(rows) else 0):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    model = Neighbours(idf, basis.astype(np.float32), np.zeros((0, size), np.float32), good, weight, prior)
    model.vectors = model.embed(counts)
    return model


def score(docs: DataFrame, model: Neighbours, k: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with ``score``, read from the text alone; a column of that name is replaced.

    Null text counts as empty: it has no similar neighbour and scores the share of good
    labels.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for span, data, offsets in row_blocks(batch.column("text")):
                found[span] = shared.value.scores(shared.value.embed(term_counts(data, offsets)), k)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found)], names=[*batch.schema.names, "score"]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(vote, ", ".join([*fields, "score double"]))
