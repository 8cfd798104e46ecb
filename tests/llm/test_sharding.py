import zlib
from collections import defaultdict

import pytest

from signalloom.llm import queries, sharding


def check(rows, shards=16):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_query_places_every_document(spark, documents):
    rows = queries.op6_feistel_sharding(spark, "/root/testdata/sf0.001").collect()
    check(rows)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert (r["law"], r["grown_shard"]) == ("rows", None)


@pytest.mark.parametrize("total", [1, 2, 3, 5, 17, 100, 1000, 4097])
def test_the_permutation_is_a_bijection(spark, total):
    df = spark.range(total).selectExpr("id AS n", f"{total}L AS total")
    got = [r[0] for r in df.select(sharding.permuted("n", "total", "key")).collect()]
    assert sorted(got) == list(range(total))


def test_keys_shuffle_differently_and_reproducibly(spark):
    df = spark.range(500).selectExpr("id AS doc_id")
    one, again, other = (
        {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign_shards(d, key=k).collect()}
        for d, k in ((df, "a"), (df.repartition(7), "a"), (df, "b"))
    )
    assert one == again and one != other
    # Neighbours are torn apart.
    assert sum(one[i][0] == one[i + 1][0] for i in range(499)) < 80


def test_row_numbers_have_no_gaps(spark):
    df = spark.range(1000).selectExpr("id % 7 AS doc_id", "cast(id AS string) AS text")
    rows = sharding.number_rows(df, ranges=4).collect()
    assert sorted(r["row_number"] for r in rows) == list(range(1000))
    assert {r["n_rows"] for r in rows} == {1000}


def test_odd_documents(odd, none, odd_rows):
    clash = odd.selectExpr("*", "doc_id AS row_number", "1 AS n_rows", "2 AS _range", "3 AS __in", "4 AS `a.b`")
    rows = sharding.assign_shards(clash.withColumn("slot", odd.doc_id))
    assert rows.columns == [*clash.columns, "shard", "slot"]
    assert {(r["n_rows"], r["_range"], r["__in"], r["a.b"]) for r in rows.collect()} == {(1, 2, 3, 4)}
    check(rows.collect())
    assert rows.count() == len(odd_rows)
    assert sharding.assign_shards(none).count() == 0
