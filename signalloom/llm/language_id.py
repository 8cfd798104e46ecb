"""Language identification by error-correcting output codes.

Every language has a codeword; a binary classifier over byte n-grams predicts each bit
of it. A text's bits are decoded to the language whose codeword loses least, each bit
weighted by how sure its classifier is, so single wrong bits are corrected. Texts whose
two best codewords are close are flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm import textvec as tv

UNKNOWN = "und"
# N-gram lengths in bytes, and the buckets they are hashed to.
SIZES = (2, 3, 4)
BUCKETS = 1 << 16
# Bytes of text whose n-grams are in memory at once.
BLOCK = 1 << 18
# Labelled rows learned from, per language at most (about; see ``training_rows``).
SAMPLE = 3000
# Added to every n-gram's count; and the score below which a text is flagged.
SMOOTHING = 0.5
AMBIGUOUS = 0.7

# Letters keep their (lower-cased) byte, what else is ASCII becomes a blank.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all n-grams of a block; rows begin and end with a blank.

    N-grams with two blanks in a row are left out, so runs of blanks and marks add nothing.
    """
    n = len(offsets) - 1
    place = np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(n), np.diff(offsets))
    text = np.full(len(data) + 2 * n, 32, dtype=np.uint8)
    text[place] = _FOLD[data]
    # Letters of the Latin-1 range in UTF-8: C3 80 to C3 9E are upper case.
    upper = np.flatnonzero((text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[:-1] == 0xC3)) + 1
    text[upper] += 32
    row = np.repeat(np.arange(n), np.diff(offsets) + 2)
    blank = text == 32
    rows, buckets = [], []
    value = text.astype(np.uint32)
    for size in SIZES:
        count = len(text) - size + 1
        if count <= 0:
            continue
        gram = np.full(count, size, dtype=np.uint32)
        twice = np.zeros(count, dtype=bool)
        for k in range(size):
            gram = gram * np.uint32(0x01000193) ^ value[k : k + count]
            if k:
                twice |= blank[k - 1 : k - 1 + count] & blank[k : k + count]
        gram *= np.uint32(0x9E3779B1)
        kept = np.flatnonzero(~twice & (row[:count] == row[size - 1 :]))
        rows.append(row[kept])
        buckets.append((gram[kept] >> np.uint32(16)).astype(np.int64) % BUCKETS)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """A ``k`` x bits matrix of -1 and 1; no two rows, and no two columns, say the same.

    Up to five languages get every way to part them in two; more get random columns, the
    best of many draws by the least distance of two codewords.
    """
    if k < 2:
        return np.ones((k, 0))
    if k <= 5:
        columns = [c for c in itertools.product((1, -1), repeat=k - 1) if -1 in c]
        return np.array([(1, *c) for c in columns]).T
    rng, best, distance = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice((-1, 1), size=(k, 2 * math.ceil(5 * math.log2(k))))
        code = np.unique(code[:, np.abs(code.sum(0)) < k] * code[:1, np.abs(code.sum(0)) < k], axis=1)
        agree = code @ code.T
        apart = (code.shape[1] - agree[~np.eye(k, dtype=bool)].max()) // 2
        if apart > distance:
            best, distance = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: how much an n-gram speaks for the bit

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """texts x languages: each bit's logistic loss, weighted by the bit's certainty."""
        certainty = np.abs(margins) / np.maximum(np.abs(margins).sum(1, keepdims=True), 1e-12)
        agreement = margins[:, None, :] * self.code[None, :, :]
        return (np.logaddexp(0, -agreement) * certainty[:, None, :]).sum(2) * self.code.shape[1]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score): score is the best one's share of exp(-loss)."""
        if len(self.languages) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins))
        losses = self.losses(margins)
        best = losses.argmin(1)
        share = np.exp(losses.min(1, keepdims=True) - losses)
        return best, 1 / share.sum(1)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """texts x bits: the classifiers' outputs, growing with the evidence of a text."""
        n = len(offsets) - 1
        rows, buckets = ngrams(data, offsets)
        out = np.empty((n, self.code.shape[1]))
        for bit in range(out.shape[1]):
            out[:, bit] = np.bincount(rows, self.weights[bit][buckets], minlength=n)
        count = np.bincount(rows, minlength=n)
        return out / np.sqrt(np.maximum(count, 1))[:, None]


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text): about ``sample`` labelled rows of each language, chosen by hash.

    The hash's share to keep follows from the counts of all labelled rows per language,
    so the expected number is bounded at every size; the choice doesn't depend on
    partitions. Null and blank labels are left out.
    """
    labelled = docs.where("lang IS NOT NULL AND trim(lang) <> '' AND text IS NOT NULL")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("_n"))  # one row per language
    kept = labelled.join(F.broadcast(counts), "lang").where(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(sample) / F.col("_n") * (1 << 30)
    )
    return kept.select("lang", "text")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``docs`` (doc_id, text, lang).

    Tasks count n-grams per language; the driver gets languages x BUCKETS counts. Each
    bit's classifier compares the n-gram's share in the languages on both sides (each
    language counting alike), as a naive Bayes classifier does.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            for first, data, offsets in tv.blocks(batch.column("text"), BLOCK):
                rows, buckets = ngrams(data, offsets)
                of = langs[first : first + len(offsets) - 1]
                for lang in set(of):
                    mine = buckets[(of == lang)[rows]]
                    totals[lang] = totals.get(lang, 0) + np.bincount(mine, minlength=BUCKETS)
        for lang, total in totals.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])],
                names=["lang", "bucket", "n"],
            )

    counted = training_rows(docs, sample).mapInArrow(count, "lang string, bucket int, n bigint")
    per_lang = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = per_lang.groupBy("lang").agg(
        F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts")
    ).orderBy("lang").collect()
    languages = [r["lang"] for r in rows]
    shares = np.empty((len(rows), BUCKETS))
    for share, r in zip(shares, rows, strict=True):
        share[:] = SMOOTHING
        np.add.at(share, r["buckets"], r["counts"])
        share /= share.sum()
    code = codewords(len(languages))
    weights = np.array([
        np.log(shares[column > 0].mean(0)) - np.log(shares[column < 0].mean(0)) for column in code.T
    ]).reshape(code.shape[1], BUCKETS)
    return Model(languages, code, weights.astype(np.float32))


def identify(docs: DataFrame, model: Model, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous, read from the text alone.

    Null text, and text without a letter, is ``und`` with score 0, not ambiguous; so is
    every text if the model knows no language. Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    # Languages x bits and bits x buckets: bounded by the languages, not by the documents.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array(known.languages + [UNKNOWN], dtype=object)
        for batch in batches:
            text = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False)
            lettered = lettered.to_numpy(zero_copy_only=False) & bool(known.languages)
            best = np.full(batch.num_rows, len(known.languages))
            score = np.zeros(batch.num_rows)
            for first, data, offsets in tv.blocks(text, BLOCK) if known.languages else ():
                span = slice(first, first + len(offsets) - 1)
                best[span], score[span] = known.decode(known.margins(data, offsets))
            best[~lettered], score[~lettered] = len(known.languages), 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(score),
                 pa.array(lettered & (score < ambiguous))],
                names=[*batch.schema.names, "lang_pred", "score", "ambiguous"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(
        predict, ", ".join([*fields, "lang_pred string", "score double", "ambiguous boolean"])
    )
