import math
from collections import Counter
import re

import numpy as np
import pyarrow as pa

from signalloom.llm import quality_rules as qr
from signalloom.llm import queries
from signalloom.llm import textvec as tv


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {i + k for i in range(len(words) - 7) if spans[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked),
        text.count("\n") + 1, sum("A" <= c <= "Z" for c in text),
        sum(a == b for a, b in zip(words, words[1:], strict=False)),
    )


def test_counts_equal_brute_force(documents, odd_rows):
    texts = [r["text"] for r in documents.collect()] + [r[1] for r in odd_rows]
    got = []
    for _, data, offsets in tv.blocks(pa.array(texts), size=50_000):
        counts = qr.count_block(data, offsets)
        got += list(zip(*[counts[c].tolist() for c in qr.COUNTS], strict=True))
    assert got == [brute(t) for t in texts]


def test_word_hashes_do_not_depend_on_the_block():
    data, offsets = tv.text_bytes(pa.array(["one two", None, "two  one two"]))
    w = tv.words(data, offsets)
    assert w.row.tolist() == [0, 0, 2, 2, 2]
    assert w.hashes[0] == w.hashes[3] and w.hashes[1] == w.hashes[2] == w.hashes[4]
    assert len(set(w.hashes.tolist())) == 2


def test_binomial_tail_and_steps():
    exact = sum(math.comb(50, i) * 0.1**i * 0.9 ** (50 - i) for i in range(4))
    assert abs(qr.binomial_tail(3, 50, 0.1) - exact) < 1e-12
    # 300 good documents: none lost proves a risk below 2 % at level 0.05 / 4, one doesn't.
    assert qr.accepted_step(np.array([0, 0, 1, 1]), 300, 0.02, 0.0125) == 2
    assert qr.accepted_step(np.array([0, 0, 0]), 50, 0.02, 0.0125) == 0
    assert qr.accepted_step(np.array([0]), 0, 0.02, 0.05) == 0


def test_reject_step_follows_the_path(spark):
    rows = [(w, 100, s, 0, 0, 10, u, 0) for w, s, u in [(100, 0, 0), (100, 13, 0), (100, 200, 0), (100, 0, 91), (100, 0, 26), (0, 0, 0)]]
    df = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in qr.COUNTS))
    got = [r[0] for r in df.select(qr.reject_step()).collect()]
    assert got[0] is None and got[1] == qr.STEPS and got[2] == 1 and got[3] == 1 and got[4] == qr.STEPS
    assert got[5] is None
    for r, share in zip(got, [0, 0.13, 2.0], strict=False):
        loose, tight = qr.PATH["symbols_per_word"]
        cutoffs = [loose + (tight - loose) * k / (qr.STEPS - 1) for k in range(qr.STEPS)]
        want = next((k + 1 for k, c in enumerate(cutoffs) if share > c), None)
        assert r == want


def test_guarantee_holds_per_stratum(spark):
    """Good documents of one stratum look like junk: its rules must not bite."""
    rows = []
    for i in range(1200):
        stratum = "plain" if i % 2 else "marked"
        symbols = 0 if stratum == "plain" or i % 20 else 100
        rows.append((i, stratum, 100, 400, symbols, 0, 0, 10, 0, 0))
    rows += [(5000 + i, None, 100, 400, 300, 0, 0, 10, 0, 0) for i in range(5)]
    counts = spark.createDataFrame(rows, "doc_id bigint, s string, " + ", ".join(f"{c} bigint" for c in qr.COUNTS))
    labels = spark.createDataFrame([(i, 1) for i in range(1200)] + [(7, 1), (None, 1)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in qr.judge(counts, labels, "s").collect()}
    assert len(got) == len(rows)
    assert got[1]["step"] == qr.STEPS and 0 < got[0]["step"] < qr.STEPS
    assert all(got[i]["kept"] for i in range(1200))
    assert got[5000]["step"] is None and got[5000]["kept"]


def test_odd_documents(odd, none, odd_rows, spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    counted = qr.document_counts(odd.withColumn("n_words", odd.doc_id))
    assert counted.count() == len(odd_rows)
    judged = qr.judge(counted.withColumn("kept", counted.doc_id), labels, "lang")
    assert judged.count() == len(odd_rows)
    assert judged.where("kept IS NULL").count() == 0
    assert qr.judge(qr.document_counts(none), labels, "lang").count() == 0


def test_query_returns_every_document(spark):
    df = queries.op2_risk_controlled_rules(spark, "/root/testdata/sf0.01")
    rows = df.collect()
    assert len(rows) == 1000
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[:5]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r["kept"] <= (not r["base_failed"])
