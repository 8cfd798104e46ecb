import zlib

import numpy as np
import pyarrow as pa
import pytest

from signalloom.llm import language_id as li
from signalloom.llm import queries
from signalloom.llm import textvec as tv


def test_query_identifies_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_error_correcting_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("k", [2, 3, 4, 5, 9, 30])
def test_codewords_are_apart(k):
    code = li.codewords(k)
    assert code.shape[0] == k and set(np.unique(code)) <= {-1, 1}
    distance = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
    assert min(distance) >= (2 ** (k - 2) if k <= 5 else code.shape[1] // 4)
    assert len({tuple(c * c[0]) for c in code.T}) == code.shape[1]


def test_one_wrong_bit_is_corrected():
    model = li.Model(list("abcd"), li.codewords(4), np.zeros((7, 1)))
    for k in range(4):
        for bit in range(7):
            margins = 3.0 * model.code[k].astype(float)
            margins[bit] *= -0.3
            assert model.decode(margins[None])[0][0] == k


def test_ngrams_are_those_of_single_texts():
    texts = ["Été à là", "", "a", "one  TWO!!", "ÀÉ 12 é"]
    data, offsets = tv.text_bytes(pa.array(texts))
    rows, buckets = li.ngrams(data, offsets)
    for i, text in enumerate(texts):
        one = li.ngrams(*tv.text_bytes(pa.array([text])))[1]
        assert sorted(buckets[rows == i]) == sorted(one)
    upper, lower = (sorted(li.ngrams(*tv.text_bytes(pa.array([t])))[1]) for t in ("ÀÉ ÉT", "àé ét."))
    assert upper == lower


def test_odd_documents(odd, none, odd_rows, spark):
    for docs in (odd, none, odd.withColumn("lang", odd.text).limit(0)):
        model = li.train(docs)
        rows = li.identify(odd.withColumn("score", odd.doc_id), model).collect()
        assert len(rows) == len(odd_rows)
        for r in rows:
            lettered = r["text"] is not None and any(c.isalpha() for c in r["text"])
            assert (r["lang_pred"] == li.UNKNOWN) == (not lettered or not model.languages)
    assert li.identify(none, li.train(odd)).count() == 0
    single = li.train(odd.where("lang = 'en'"))
    assert {r["lang_pred"] for r in li.identify(odd, single).collect()} == {"en", "und"}
