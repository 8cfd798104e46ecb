import hashlib

import brute
import pytest

from signalloom.llm import line_dedup as ld
from signalloom.llm import queries


def plain(rows):
    return sorted(map(repr, rows))


def test_query_equals_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute.dedup_lines(rows)]
    got = queries.op4_line_dedup(spark, "/root/testdata/sf0.001").collect()
    assert plain(map(tuple, got)) == plain(want)


@pytest.mark.parametrize("salts", [1, 3, 256])
def test_odd_documents(odd, odd_rows, salts):
    clash = odd.withColumn("n_lines", odd.doc_id).withColumn("first", odd.doc_id).withColumn("pos", odd.doc_id)
    clash = clash.selectExpr("*", "1 AS _doc", "2 AS _own", "3 AS __runs")
    got = ld.dedup_lines(clash, salts=salts)
    assert got.columns == [*odd.columns, "first", "pos", "_doc", "_own", "__runs", "n_lines", "n_dropped"]
    assert {(r["_doc"], r["_own"], r["__runs"]) for r in got.collect()} == {(1, 2, 3)}
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()]
    assert plain(got) == plain(brute.dedup_lines([r[:2] for r in odd_rows]))


def test_bitmaps_tell_the_kept_runs(spark):
    line = "0123456789"
    rows = [(1, line), (2, f"a\n{line}\nb\nc\n{line}"), (3, f"{line}\n{line}"), (4, "short\nshort"), (5, "short")]
    got = ld.line_bitmaps(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    runs = {r["doc_id"]: (r["n_lines"], r["n_dropped"], [tuple(x) for x in r["keep_runs"]]) for r in got}
    assert runs == {2: (5, 2, [(0, 1), (2, 2)]), 3: (2, 2, [])}


def test_no_documents(none):
    assert ld.dedup_lines(none).count() == 0 and ld.line_bitmaps(none).count() == 0


def test_one_line_in_very_many_documents(spark):
    df = spark.range(30_000).selectExpr("id AS doc_id", "concat('own line ', id, '\nthe line that all share') AS text")
    got = ld.dedup_lines(df)
    assert got.where("n_dropped = 0").select("doc_id").collect()[0][0] == 0
    assert got.where("n_dropped = 1").count() == 29_999
