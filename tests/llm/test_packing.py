import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from signalloom.llm import packing, queries
from signalloom.llm import textvec as tv

PATH = public_tokenizers.path("word_bpe_49k.json")


def unpack(plan, counts, capacity):
    """Every placement item by item; checks that bins are filled without gaps."""
    seen, bins = defaultdict(list), defaultdict(list)
    for p in plan:
        for i in range(p.count):
            seen[p.length].append(p.first + i)
            bins[p.first_bin + i // p.per_bin].append((p.offset + i % p.per_bin * p.length, p.length))
    for length, n in counts.items():
        assert sorted(seen[length]) == list(range(n))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in items) <= 2
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_item_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([12, 100, 4096])
    counts = {s: rng.choice([0, 1, 2, 7, 1000]) for s in rng.sample(range(1, capacity + 1), min(capacity, 60))}
    plan = packing.plan_packing(counts, capacity)
    bins = unpack(plan, counts, capacity)
    total = sum(s * n for s, n in counts.items())
    assert len(bins) >= -(-total // capacity)
    # First-fit decreasing as a yardstick: no more than 1 % (and one bin) worse.
    gaps = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)[:4000]:
        for i, g in enumerate(gaps):
            if g >= s:
                gaps[i] -= s
                break
        else:
            gaps.append(capacity - s)
    if sum(counts.values()) <= 4000:
        assert len(bins) <= 1.01 * len(gaps) + 1


def test_plan_is_bounded_by_the_capacity():
    few = packing.plan_packing(dict.fromkeys(range(1, 4097), 3))
    many = packing.plan_packing(dict.fromkeys(range(1, 4097), 3_000_001))
    assert len(many) < 60_000 and len(few) < 60_000


def test_words_encode_like_whole_texts(documents, odd_rows):
    tokenizer = Tokenizer.from_file(PATH)
    texts = [r["text"] for r in documents.collect()] + [r[1] or "" for r in odd_rows]
    texts += ["it's  don't\tI'll rock'n'roll.", "á e ́x", "<|endoftext|> a<|startoftext|>b", "1234 5x6", "\x1c\x85 wide"]
    texts += ["<|ENDOFTEXT|> A,b.c... x!'s d'.e 'f' (g) h-i--", "ÉTÉ, ŒUVRE. İstanbul. ΣΑΣ. a…, “b”.", "a\u0301. K\u212a. ﬁ."]
    words = packing.WordIds(tokenizer.to_str())
    for block in (texts, texts[::-1], ["", ""], texts[:3]):
        data, offsets = tv.text_bytes(pa.array(block))
        ids, counts = words.block_ids(data, offsets, 1)
        whole = [tokenizer.encode(text, add_special_tokens=False).ids + [1] for text in block]
        assert ids.tolist() == sum(whole, []) and counts.tolist() == list(map(len, whole))


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    tokenizer = Tokenizer.from_file(PATH)
    words = packing.WordIds(tokenizer.to_str())
    for i in range(30):
        text = f"common word{chr(97 + i % 26)} other{chr(97 + i // 2)}."
        ids, _ = words.block_ids(*tv.text_bytes(pa.array([text])), 1)
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert len(words.hashes) == len(words.checks) <= 10 + 3


def test_words_that_hashes_do_not_tell_apart(monkeypatch):
    monkeypatch.setattr(tv, "span_hashes", lambda data, starts, ends: np.ones(len(starts), np.uint64))
    tokenizer = Tokenizer.from_file(PATH)
    words = packing.WordIds(tokenizer.to_str())
    for text in ("one", "one two three", "two"):
        ids, _ = words.block_ids(*tv.text_bytes(pa.array([text, None])), 1)
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1, 1]


def check_packed(rows, docs, capacity=4096):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {}
    for doc_id, text in docs:
        ids.setdefault(doc_id, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    assert len(rows) == sum(-(-len(x) // capacity) for v in ids.values() for x in v)
    sequences = defaultdict(list)
    for r in rows:
        assert r["start"] == r["piece"] * capacity
        parts = [x[r["start"] : r["start"] + capacity] for x in ids[r["doc_id"]]]
        crcs = {(len(p), zlib.crc32(np.asarray(p, "<u4").tobytes())) for p in parts if p}
        assert (r["length"], r["ids_crc32"]) in crcs
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in rows)


def test_query_packs_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op7_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    n, tokens = check_packed(rows, [tuple(d) for d in docs])
    assert n <= 1.02 * tokens / 4096 + 1


def test_odd_documents(odd, odd_rows, none):
    rows = packing.pack_documents(odd.withColumn("length", odd.n_chars), PATH, keep_ids=True).collect()
    check_packed(rows, [r[:2] for r in odd_rows])
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert packing.pack_documents(none, PATH).count() == 0
