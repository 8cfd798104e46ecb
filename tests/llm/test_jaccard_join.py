import itertools
import random

import brute
import pytest

from signalloom.llm import components as cc
from signalloom.llm import jaccard_join as jj


def families(seed, n=14):
    """Texts with copies, near copies at all distances from the threshold, and chains."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefg") * rng.randrange(1, 3) + rng.choice("xyzuvw")
    shared = [word() for _ in range(60)]
    rows = []
    for _ in range(n):
        base = [word() for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.4:
            base += shared
        for _ in range(rng.randrange(1, 9)):
            rows.append(" ".join(base).title() if rng.random() < 0.2 else " ".join(base))
            base = base[:]
            for _ in range(rng.randrange(0, 3)):
                if base:
                    base[rng.randrange(len(base))] = word()
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("leaders", [(1,), (1, 2), (1, 4, 16)])
def test_components_equal_all_pairs(spark, leaders, monkeypatch):
    rows = families(len(leaders))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    monkeypatch.setattr(jj.similarity_links, "__defaults__", (jj.WORDS, jj.PERCENT, leaders))
    got = {r["doc_id"]: (r["n_grams"], r["component_id"]) for r in jj.join_documents(docs).collect()}
    want = brute.jaccard_components(rows)
    assert got == {d: (len(brute.shingles(t)), want[d]) for d, t in rows}
    assert 1 < len(set(want.values())) < len(rows)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(90)]
    rows = []
    for i in range(150):
        words = base[:]
        for _ in range(3):
            words[rng.randrange(90)] = f"v{rng.randrange(4)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows + [(i + 1000, rows[0][1]) for i in range(50)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jj.join_documents(docs).collect()}
    want = brute.jaccard_components(rows)
    assert got == want | {i + 1000: want[0] for i in range(50)}
    assert len(set(want.values())) > 1


def test_odd_documents(odd, none, odd_rows):
    got = jj.join_documents(odd.withColumn("n", odd.doc_id).withColumn("h1", odd.doc_id)).collect()
    want = brute.jaccard_components([r[:2] for r in odd_rows])
    assert len(got) == len(odd_rows)
    texts = {r[0]: r[1] for r in odd_rows}
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"])
        if r["doc_id"] is not None:
            assert r["n_grams"] == len(brute.shingles(texts[r["doc_id"]]))
    assert jj.join_documents(none).count() == 0


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(5, a), (7, a), (7, b), (9, b), (11, "else where to go now")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jj.join_documents(docs).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 11)}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_links(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(25)]
    links += [(300, 300 + i) for i in range(40)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in cc.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {x: find(x) for x in root if x not in loops}
    assert cc.components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.fixture
def rows_written(monkeypatch):
    """How many rows each table of the join has had in all, by name."""
    sizes = {}

    def count(df, name, write=jj.written):
        out = write(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jj, "written", count)
    return sizes


def test_near_copies_with_few_links_make_few_pairs(spark, rows_written):
    # Each text is linked with one in eight others, those that share an edit with it.
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i, j in itertools.combinations(range(30), 2):
        words = base[:]
        words[5 * i], words[5 * j] = f"x{i}", f"x{j}"
        rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["component_id"] for r in jj.join_documents(docs).collect()} == {0}
    assert rows_written["pairs"] < 12 * len(rows)


def test_long_texts_that_share_a_sentence_are_not_verified(spark, rows_written):
    rng = random.Random(5)
    rows = []
    for i in range(8):
        words = [f"w{rng.randrange(200)}" for _ in range(9000)]
        rows.append((i, " ".join([*words, *(f"own{i // 2}x{k}" for k in range(8))])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(r["component_id"] == r["doc_id"] for r in jj.join_documents(docs).collect())
    assert rows_written["pairs"] > 0 and rows_written["sets"] == 0


def test_histograms_of_two_sizes(spark):
    rng = random.Random(8)
    rows = []
    for top in (70, 300, 600, 1150):
        for _ in range(3):
            words = [f"w{rng.randrange(4000)}" for _ in range(top)]
            rows += [(0, " ".join(words[: rng.randrange(top * 6 // 10, top)])) for _ in range(5)]
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jj.join_documents(docs).collect()}
    assert got == brute.jaccard_components(rows)
    assert 12 < len(set(got.values())) < len(rows)
