import random

import numpy as np
import pytest

from signalloom.llm import decontaminate as dc
from signalloom.llm import queries


def brute_alignment(item, words):
    """The whole table, cell by cell."""
    best = 0
    table = [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(words, 1):
            step = table[i - 1][j - 1] + (dc.MATCH if x == y else dc.MISMATCH)
            table[i][j] = max(0, step, table[i - 1][j] + dc.GAP, table[i][j - 1] + dc.GAP)
            best = max(best, table[i][j])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_alignment_equals_brute_force(seed):
    rng = random.Random(seed)
    item = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 25))], dtype=np.uint64)
    words = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 60))], dtype=np.uint64)
    score, begin, end = dc.locate(item, words)
    assert score == brute_alignment(item, words)
    assert brute_alignment(item, words[begin:end]) == score


def passage(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    items = [(i, " ".join(passage(rng, rng.randrange(20, 60)))) for i in range(12)]
    rows, want = [], set()
    for d in range(120):
        words = passage(rng, rng.randrange(0, 300))
        if d % 3 == 0:
            i = rng.randrange(12)
            copy = items[i][1].split()
            for _ in range(len(copy) * (d % 4) // 12):  # up to a quarter of the words edited
                kind, at = rng.randrange(3), rng.randrange(len(copy))
                copy[at : at + (kind != 0)] = passage(rng, 1) if kind != 1 else []
            at = rng.randrange(len(words) + 1)
            text = " ".join(words[:at]) + " " + ", ".join(copy).upper() + ". " + " ".join(words[at:])
            want.add((d, i))
        else:
            text = " ".join(words + items[d % 12][1].split()[: 5])
        rows.append((d, text))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    return docs, spark.createDataFrame(items, "item_id bigint, text string"), want, dict(rows), dict(items)


def test_edited_copies_are_found_and_fragments_not(planted):
    docs, benchmark, want, texts, items = planted
    rows = dc.contaminated(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    for r in rows:
        span = texts[r["doc_id"]].encode()[r["begin"] : r["end"]].decode().lower().split()
        item = items[r["item_id"]].split()
        assert [w.strip(",.") for w in span][0] in item and len(span) <= 1.5 * len(item)


def test_slices_change_nothing(planted):
    docs, benchmark, want, _, _ = planted
    found = dc.find_copies(docs, benchmark, slice_words=300).where("score >= 0.5")
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_clean_rows_stay(planted):
    docs, benchmark, want, texts, _ = planted
    kept = dc.drop_contaminated(docs.withColumn("score", docs.doc_id), benchmark)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {r["doc_id"] for r in kept.collect()} == set(texts) - {d for d, _ in want}


def test_odd_documents(odd, none, odd_rows, spark):
    line = "a line that many documents share word for word"
    benchmark = spark.createDataFrame(
        [(1, None), (2, ""), (3, "two words"), (4, line), (None, line), (5, line)], "item_id bigint, text string"
    )
    rows = dc.contaminated(odd.withColumn("item_id", odd.doc_id), benchmark).collect()
    holds = [r[0] for r in odd_rows if r[1] and line in r[1].lower().replace(",", "")]
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, holds * 2))
    assert dc.drop_contaminated(odd, benchmark).count() == len(odd_rows) - len(holds)
    assert dc.contaminated(none, benchmark).count() == 0
    assert dc.drop_contaminated(odd, benchmark.limit(0)).count() == len(odd_rows)


def test_query_finds_whole_copies(spark):
    """Every document that holds an item word for word is found, with a full score."""
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in queries.op10_seeded_alignment(spark, sf).collect()}
    whole = {(d, i) for d, t in docs.items() for i, b in items.items() if b in t}
    assert whole and whole <= set(got)
    assert all(got[x] == 1.0 for x in whole)


def test_items_of_three_words_and_other_ids(spark):
    docs = spark.createDataFrame([(1, "so alpha beta gamma it is"), (2, "alpha beta"), (3, "beta gamma alpha")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "Alpha, beta gamma!"), (8, "beta gamma")], "item_id smallint, text string")
    got = dc.contaminated(docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["score"], r["n_seeds"]) for r in got] == [(1, 7, 1.0, 1)]


def test_rare_seeds_of_very_many_items():
    rng = np.random.default_rng(1)
    n, each = 100_000, 12
    hashes = np.sort(rng.integers(0, 1 << 62, n * each).astype(np.uint64))
    item = rng.permutation(np.repeat(np.arange(n), each))
    items = dc.Items(np.arange(n), [], hashes, item, np.zeros(n * each, np.int64))
    frequency = rng.integers(0, 40, len(items.distinct()))
    kept = dc.rare_seeds(items, frequency)
    of = frequency[np.searchsorted(items.distinct(), hashes)]
    for i in (0, 1, 999, n - 1):
        mine = of[item == i]
        want = mine <= dc.COMMON * max(1, np.sort(mine)[len(mine) // 2])
        assert (kept.item == i).sum() == want.sum()
