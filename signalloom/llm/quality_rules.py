"""Quality rules whose cutoffs carry a guarantee.

Every document gets counts; rules compare ratios of them with cutoffs. The cutoffs
tighten together along a fixed path. For each stratum, labelled good documents are
the holdout: going from the loosest step to tighter ones, a step is accepted while
the exact binomial test rejects "more than ``risk`` of good documents would be
thrown out". Testing in fixed order needs no correction within a stratum, and
dividing ``delta`` by the number of strata corrects across them: with probability
1 - delta, no stratum loses more than ``risk`` of its good documents by the rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm import textvec as tv

RISK = 0.02
DELTA = 0.05
STEPS = 40
WINDOW = 8

# Loosest and tightest cutoff of each rule; the path goes from one to the other.
PATH = {
    "symbols_per_word": (1.5, 0.12),
    "upper_share": (0.9, 0.25),
    "dup_line_share": (0.9, 0.35),
    "echo_share": (0.95, 0.25),
}

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_echoes",
]

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def count_block(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS for every row of a block."""
    n = len(offsets) - 1
    w = tv.words(data, offsets)
    out = {"n_words": np.bincount(w.row, minlength=n)}
    # Words that are the word before them once more.
    echo = np.flatnonzero((w.hashes[1:] == w.hashes[:-1]) & (w.row[1:] == w.row[:-1])) + 1
    out["n_echoes"] = np.bincount(w.row[echo], minlength=n)
    lead = (data & 0xC0) != 0x80
    out["word_chars"] = tv.per_row(lead & ~tv.IS_BLANK[data], offsets)
    out["n_symbols"] = tv.per_row(_SYMBOL[data], offsets)
    out["n_upper"] = tv.per_row((data >= 65) & (data <= 90), offsets)

    breaks = np.flatnonzero(data == 10)
    out["n_lines"] = 1 + tv.per_row(data == 10, offsets)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([offsets[1:], breaks]))
    row = np.repeat(np.arange(n), out["n_lines"])
    wordy = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    key = tv.with_row(tv.span_hashes(data, starts[wordy], ends[wordy]), row[wordy])
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(row[wordy], minlength=n) - np.bincount(
        row[wordy][first], minlength=n
    )

    at, hashes = tv.windows(w, WINDOW)
    covered = np.zeros(len(w.row) + 1, dtype=np.int64)
    if len(at):
        _, inverse, times = np.unique(
            tv.with_row(hashes, w.row[at]), return_inverse=True, return_counts=True
        )
        twice = at[times[inverse] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    repeated = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = np.bincount(w.row[repeated], minlength=n)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.schema.get_field_index("text")
        parts = [count_block(data, offsets) for _, data, offsets in tv.blocks(batch.column(texts))]
        counts = [
            pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64())
            for c in COUNTS
        ]
        kept = [batch.column(i) for i in range(batch.num_columns) if i != texts]
        names = [f for f in batch.schema.names if f != "text"]
        yield pa.RecordBatch.from_arrays(kept + counts, names=names + COUNTS)


def document_counts(docs: DataFrame) -> DataFrame:
    """Every column of ``docs`` but text, and the counts; columns of their names are replaced.

    Null or empty text has one line, no word. One row per input row.
    """
    docs = docs.drop(*COUNTS)
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(_count, ", ".join(rest + [f"{c} bigint" for c in COUNTS]))


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


RATIOS = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / n_lines",
    "echo_share": "n_echoes / greatest(n_words, 1)",
}


def reject_step(steps: int = STEPS) -> Column:
    """The first step (1 is the loosest) at which a rule throws the row out; null if none does."""
    firsts = []
    for rule, (loose, tight) in PATH.items():
        # Cutoff of step k: loose + (tight - loose) * (k - 1) / (steps - 1); thrown out if above.
        k = f"1 + greatest(0, floor(({loose} - {RATIOS[rule]}) / {(loose - tight) / (steps - 1)!r}) + 1)"
        firsts.append(
            f"CASE WHEN {RATIOS[rule]} > {loose} THEN 1 WHEN {RATIOS[rule]} > {tight} THEN {k} END"
        )
    return F.expr(f"cast(least({', '.join(firsts)}) AS int)")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly."""
    if k >= n:
        return 1.0
    i = np.arange(1, k + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i))])
    logs += np.arange(k + 1) * math.log(p) + (n - np.arange(k + 1)) * math.log1p(-p)
    top = logs.max()
    return min(1.0, math.exp(top) * float(np.exp(logs - top).sum()))


def accepted_step(thrown: np.ndarray, n: int, risk: float, level: float) -> int:
    """The tightest step whose test, and those of all looser steps, succeed; 0 if none does.

    ``thrown[k]``: good documents that step k+1 throws out, of ``n``.
    """
    for k, lost in enumerate(thrown):
        if n == 0 or lost >= n * risk or binomial_tail(int(lost), n, risk) > level:
            return k
    return len(thrown)


def certified_steps(
    good: DataFrame, risk: float = RISK, delta: float = DELTA, steps: int = STEPS
) -> DataFrame:
    """(stratum, n_good, step) from good documents with ``stratum`` and ``reject_step``."""
    counted = good.groupBy("stratum", "reject_step").agg(F.count("*").alias("n"))
    # As many rows as strata from here on.
    per_stratum = counted.groupBy("stratum").agg(
        F.collect_list("reject_step").alias("at"),
        F.collect_list(F.when(F.col("reject_step").isNotNull(), F.col("n"))).alias("times"),
        F.sum("n").alias("n_good"),
    )
    counted_strata = per_stratum.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(1))))

    @F.pandas_udf("int")
    def tightest(at: pd.Series, times: pd.Series, n: pd.Series, strata: pd.Series) -> pd.Series:
        found = []
        for a, t, total, m in zip(at, times, n, strata, strict=True):
            lost = np.cumsum(np.bincount(np.asarray(a, int), np.asarray(t, float), steps + 1))[1:]
            found.append(accepted_step(lost, int(total), risk, delta / m))
        return pd.Series(found, dtype="int32")

    return counted_strata.select(
        "stratum", "n_good", tightest("at", "times", "n_good", "strata").alias("step")
    )


def judge(
    counts: DataFrame, labels: DataFrame, stratum: str,
    risk: float = RISK, delta: float = DELTA, steps: int = STEPS,
) -> DataFrame:
    """``counts`` with base_failed, reject_step, step (the stratum's accepted one) and kept.

    ``labels``: (doc_id, quality); rows with quality 1 that pass the base are the holdout.
    A null stratum is a stratum of its own. A stratum without labels, or with too few
    to prove anything, accepts no step: its rows fail by the base rules only. A document
    labelled twice counts once, as good if any label says so. ``counts`` should be a
    written table, as it is read twice.
    """
    names = ["base_failed", "reject_step", "step", "kept"]
    judged = (
        counts.drop(*names)
        .withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
        .withColumn("base_failed", base_failed())
        .withColumn("reject_step", reject_step(steps))
    )
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    holdout = judged.where("NOT base_failed").join(good, "doc_id", "left_semi")
    certified = certified_steps(
        holdout.select(F.col("_stratum").alias("stratum"), "reject_step"), risk, delta, steps
    ).select(F.col("stratum").alias("_stratum"), "step")
    return judged.join(certified, "_stratum", "left").drop("_stratum").withColumn(
        "kept",
        F.expr("NOT base_failed AND NOT coalesce(reject_step <= step, false)"),
    )
