import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from signalloom.llm import divergence as dv

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "lang string, source string, text string"


def brute(rows, least=3, top=200):
    """By definition, in whole numbers: sorted (lang, source, part, item, value, rank)."""
    counts, docs, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [g[1] for g in counts if g[0] == lang]

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, x, v, i + 1) for i, (v, x) in enumerate(items[:most])]
    return sorted(out)


def result(df):
    assert df.dtypes[4:] == [("value", "bigint"), ("rank", "int")]
    return sorted(tuple(r) for r in df.collect())


def some_documents(seed, n=300):
    rng = random.Random(seed)
    words = ["one", "Two", "three3four", "ÉTÉ", "été", "Σ", "x-y", "\U0001f600", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "de", "en", None])
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(9)}"
        rows.append((lang, source, " ".join(rng.choices(words, k=rng.randrange(30)))))
    return rows


@pytest.mark.parametrize("blocks", [(2, 3), (32, 4096)])
def test_audit_equals_brute_force(spark, blocks):
    rows = some_documents(1) + [("fr", "a", "rare words"), ("fr", "b", None), ("fr", "c", "1 2 3"), ("it", "only", "uno")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(dv.audit(df, group_block=blocks[0], term_block=blocks[1])) == brute(rows)
    assert result(dv.audit(df, least=1, top=4)) == brute(rows, 1, 4)


def test_odd_documents(odd, odd_rows):
    rows = [(r[2], r[3], r[1]) for r in odd_rows]
    clash = odd.selectExpr("*", "doc_id AS term", "doc_id AS n", "doc_id AS p", "doc_id AS place")
    assert result(dv.audit(clash, least=2)) == brute(rows, 2)


def test_no_documents(none):
    assert dv.audit(none).count() == 0


def test_large_counts_stay_exact(spark):
    kept = spark.sql("SELECT 9000000000000L AS n, 7L AS g, 3L AS v").selectExpr(dv.share("n", "n + g", "v") + " AS p")
    assert kept.first()[0] == 1 + 10**9 * 9_000_000_000_001 // 9_000_000_000_010


def test_counters_are_sent_on(monkeypatch):
    rows = some_documents(2, 50)
    columns = [pa.array([r[i] or "" for r in rows]) for i in range(3)]
    batch = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "text"])

    def totals(held):
        monkeypatch.setattr(dv, "HELD", held)
        parts = list(dv._counted(iter([batch.slice(i, 10) for i in range(0, 50, 10)])))
        sums = Counter()
        for part in parts:
            for lang, source, term, n, docs in zip(*(c.to_pylist() for c in part.columns), strict=True):
                sums[lang, source, term, "n"] += n
                sums[lang, source, term, "docs"] += docs
        return len(parts), sums

    (many, a), (few, b) = totals(3), totals(10**6)
    assert many > few and a == b
