import hashlib
import re
from collections import Counter

import pytest

from signalloom.llm import imatch as im
from signalloom.llm import queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PART = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def md5(values, digits):
    return hashlib.md5(",".join(map(str, values)).encode()).hexdigest()[:digits]


def terms(text):
    return {int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in PART.findall((text or "").translate(FOLD))}


def brute_lexicon(texts, rare=1024, common=8, size=1 << 13):
    counts = Counter(t for text in texts for t in terms(text))
    n = len(texts)
    band = [(-df, t) for t, df in counts.items() if df >= 2 and df * rare >= n and df * common <= n]
    return {t for _, t in sorted(band)[:size]}


def brute_print(text, known):
    own = sorted((terms(text) & known) or terms(text))
    out = [md5(own, 16)]
    for k in range(64):
        part = [t for t in own if (t >> k // 4 * 3) % 1024 < 64 >> k % 4 * 2]
        out.append(md5(part, 4) if part else "-" * 4)
    return "".join(out)


def brute_likeness(a, b):
    cells = [(a[i : i + 4], b[i : i + 4]) for i in range(16, 272, 4)]
    cells = [c for c in cells if c != ("-" * 4, "-" * 4)]
    return sum(x == y for x, y in cells) / len(cells) if cells else float(a == b)


def brute(rows, known, text_hash):
    """Sorted (doc_id, n_chars, edited, fingerprints, likenesses), each row followed by the one before it."""
    order = lambda r: (r[0] is not None, r[0] or 0, text_hash[r[1] or ""])
    rows = sorted(rows, key=order)
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[i - 1][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (brute_print(t, known) for t in (text, edited, following))
        out.append((doc_id, len(text), edited, a, b, brute_likeness(a, b), brute_likeness(a, c)))
    return sorted(map(repr, out))


def hashes(spark, texts):
    df = spark.createDataFrame([(t,) for t in sorted(set(texts))], "t string").selectExpr("t", "xxhash64(t) AS h")
    return {r["t"]: r["h"] for r in df.collect()}


@pytest.mark.parametrize("splits", [0, 5, 1000])
def test_odd_documents(spark, odd, odd_rows, splits):
    clash = odd.selectExpr("*", "doc_id AS h", "doc_id AS range", "doc_id AS next", "doc_id AS fingerprint", "doc_id AS term")
    texts = [r[1] for r in odd_rows]
    known = brute_lexicon(texts, 1024, 2)
    found = im.lexicon(clash, 1024, 2)
    assert {r["term"] for r in found.collect()} == known and known
    got = im.edited_likeness(clash, found, splits)
    want = brute([r[:2] for r in odd_rows], known, hashes(spark, [t or "" for t in texts]))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_query_equals_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    known = brute_lexicon([r[1] for r in rows])
    want = brute(rows, known, hashes(spark, [t or "" for _, t in rows]))
    got = im.edited_likeness(documents, im.lexicon(documents)).collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def test_edits_lower_the_likeness_and_unrelated_texts_have_none(spark):
    rows = queries.op11_imatch_fingerprints(spark, "/root/testdata/sf0.01").where("n_chars > 500").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.9 * len(rows)
    assert sorted(r["near_next"] for r in rows)[int(0.9 * len(rows))] < 0.1


def test_an_added_word_leaves_most_hashes(spark, documents):
    known = im.lexicon(documents)
    own = im.with_fingerprint(documents.where("n_chars > 300"), known)
    more = own.selectExpr("doc_id", "text || ' Nevertheless' AS text", "fingerprint AS plain")
    near = im.with_fingerprint(more, known).select(im.likeness("plain", "fingerprint").alias("near"))
    assert near.where("near < 0.8").count() == 0


def test_columns_stay(spark, odd, none):
    known = im.lexicon(odd)
    clash = odd.selectExpr("*", "1 AS low", "2 AS own", "3 AS inside", "4 AS chosen")
    got = im.with_fingerprint(clash, known)
    assert got.columns == [*clash.columns, "fingerprint"]
    assert {r["chosen"] for r in got.collect()} == {4}
    assert im.with_fingerprint(none, im.lexicon(none)).count() == 0
    assert im.edited_likeness(none, im.lexicon(none)).count() == 0
    # Without a lexicon all terms count.
    assert im.with_fingerprint(odd, im.lexicon(none)).where("doc_id = 6").first()["fingerprint"] == brute_print("a", set())
