import zlib

import numpy as np
import pyarrow as pa

from signalloom.llm import quality_knn as qk
from signalloom.llm import queries
from signalloom.llm import textvec as tv


def test_query_scores_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op9_nearest_neighbour_quality(spark, sf).collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    good = [r["score"] for r in held if labels[r["doc_id"]]]
    bad = [r["score"] for r in held if not labels[r["doc_id"]]]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_votes_equal_brute_force():
    rng = np.random.default_rng(1)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((n, 8)))
    model = qk.Neighbours(None, None, unit(50), rng.integers(0, 2, 50), np.ones(50), 0.5)
    latent = unit(20)
    for x, got in zip(latent, model.scores(latent, k=5), strict=True):
        near = sorted(zip(model.vectors @ x, model.good, strict=True), reverse=True)[:5]
        weights = [max(s, 0) ** qk.SHARPNESS for s, _ in near]
        want = sum(w * g for w, (_, g) in zip(weights, near, strict=True)) / sum(weights)
        assert abs(got - want) < 1e-9


def test_counts_are_those_of_single_texts():
    texts = ["abcabc", "", "ab", "the the the end", "é"]
    whole = qk.term_counts(*tv.text_bytes(pa.array(texts)))
    for text, counts in zip(texts, whole, strict=True):
        one = qk.term_counts(*tv.text_bytes(pa.array([text])))[0]
        assert (counts[qk.REPEATS :] == one[qk.REPEATS :]).all()
        assert counts[: qk.REPEATS].sum() == one[: qk.REPEATS].sum()
    assert whole[3, : qk.REPEATS].sum() == 2


def test_odd_documents(odd, none, odd_rows, spark):
    labels = spark.createDataFrame(
        [(10, 1), (11, 0), (11, 0), (14, 1), (None, 1), (3, None), (999, 1)], "doc_id bigint, quality int"
    )
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = qk.score(odd.withColumn("score", odd.doc_id), qk.train(odd, known)).collect()
        assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert qk.score(none, qk.train(odd, labels)).count() == 0
    assert {r["score"] for r in qk.score(odd, qk.train(none, labels)).collect()} == {0.5}
