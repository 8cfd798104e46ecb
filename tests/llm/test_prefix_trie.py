import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from signalloom.llm import list_ranking, queries
from signalloom.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """The trie by its definition: {(conv_id, depth): (parent, members, children, nodes, leaves, saved, digest)}."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(v, key=lambda x: (x[0], x[1] or 0, *x[2:]))] for c, v in own.items()}
    nodes = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        # Remainders of negative ids are negative or 0, as in SQL.
        group = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        turns = tuple(own.get(group, [])[:h] + turns[h:])
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append((c, d == len(turns)))
    out = {}
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = {p for p in below if len(p) == len(prefix) + 1}
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c, last in members if last))
        parent = min(nodes[prefix[:-1]])[0] if prefix else None
        out[min(members)[0], len(prefix)] = (
            parent, len(members), len(children), len(below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()
        )
    return out


def result(df):
    rows = df.collect()
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_nodes"],
                                        r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(got) == len(rows)
    return got


def some_conversations(seed, n=60):
    """Short conversations over few texts, so that they share openings."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 150), n):
        length = 40 if c == 7 else rng.randrange(1, 12)
        rows += [(c, t, "user" if t % 2 else "assistant", rng.choice(["a", "bb", "ç€", ""])) for t in range(length)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"splits": 50, "stretch": 3, "base": 60, "id_range": 4}])
def test_trie_equals_brute_force(spark, sizes):
    rows = some_conversations(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert result(pt.rebuilt_trie(df, **sizes)) == brute(rows)


def test_odd_conversations(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", None), (0, 0, "user", "x"),
        (1, None, "user", "only turn"), (1, None, "user", "only turn"), (1, None, "assistant", ""),
        (2, 5, "user", "x" * 300_000), (2, -3, None, "\x00"), (None, 0, "user", "nobody's"), (None, None, None, None),
        (3, 1, "b", "tie"), (3, 1, "a", "tie"), (6, 0, "user", "group absent"), (25, 2, "ab", "c"), (30, 2, "a", "bc"),
        (2**62, 0, "user", "far"), (-7, 0, "user", "below"),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", d bigint")
    clash = df.selectExpr("*", "d AS i", "d AS h1", "d AS c", "d AS _bucket", "d AS n")
    assert result(pt.rebuilt_trie(clash)) == brute(rows)


def test_no_conversations(spark):
    assert pt.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_many_equal_conversations(spark):
    n = 20_000
    df = spark.range(n).selectExpr("id * 5 AS conv_id", "0L AS turn", "'user' AS role", "'same' AS text")
    got = result(pt.rebuilt_trie(df))
    ends = hashlib.sha256(",".join(str(5 * i) for i in range(n)).encode()).hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    assert got == {(0, 0): (None, n, 1, 2, 1, 4 * (n - 1), none), (0, 1): (0, n, 0, 1, 1, 4 * (n - 1), ends)}


@pytest.mark.parametrize("base", [20, 10_000])
def test_list_ranking(spark, base):
    rng = random.Random(4)
    order = rng.sample(range(1000), 300)
    lists = [order[:1], order[1:40], order[40:]]
    rows, want = [], {}
    for items in lists:
        total = (0, 0)
        for x, following in zip(items, [*items[1:], None], strict=True):
            w = (1, rng.randrange(100))
            rows.append((x, x % 3, following, None if following is None else following % 3, *w))
            want[x, x % 3] = total
            total = (total[0] + w[0], total[1] + w[1])
    df = spark.createDataFrame(rows, "c bigint, a bigint, next_c bigint, next_a bigint, n bigint, w bigint")
    got = list_ranking.prefix_sums(df, ["n", "w"], base)
    assert {(r["c"], r["a"]): (r["n"], r["w"]) for r in got.collect()} == want
    assert list_ranking.prefix_sums(df.where("false"), ["n", "w"], base).count() == 0


def test_query_has_every_node(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_prefix_trie(spark, sf)
    want = {k: (v[:3] + v[4:]) for k, v in brute(rows).items()}
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got.collect()} == want
