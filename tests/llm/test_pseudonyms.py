import itertools
import re
from datetime import date

import pytest

from signalloom.llm import pseudonyms as ps
from signalloom.llm import queries

VALUES = {
    "email": ["the.72@mail3.example.com", "Ab_c-1@x.org"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0199", "212-555-0199", "+49 30 1234 5678"],
    "ip": ["97.51.17.173", "0.0.0.0"],
    "card": ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004"],
    "date": ["1984-02-29", "29.02.1984", "02/29/1984", "31/12/1999", "2099/12/31"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "ssn": ["123-45-6789", "899-99-9999"],
    "secret": ["04dbebab91ab85687d33eeaaf9ac699e1188f962"],
}
OTHERS = [
    "4111 1111 1111 1112", "1983-02-29", "31.04.1990", "999.1.1.1", "1.2.3", "000-45-6789", "GB83 WEST 1234 5698 7654 32",
    "a @ b.com", "12 345", "1899-12-31", "3.14159265358979323846", "0000000000000000", "1234567", "version 2.0.1.4.5",
]


def luhn(text):
    digits = [int(c) for c in reversed(text) if c.isdigit()]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def iban(text):
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def shape(text):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", text)))


def run(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r for r in ps.pseudonymise(df, **options).orderBy("doc_id").collect()]


def test_formats_are_kept_and_valid(spark):
    kinds, values = zip(*[(k, v) for k, vs in VALUES.items() for v in vs], strict=True)
    rows = run(spark, [f"Say {v}, then ({v})." for v in values])
    for kind, value, row in zip(kinds, values, rows, strict=True):
        assert [f["kind"] for f in row["found"]] == [kind, kind], value
        new = row["found"][0]["pseudonym"]
        assert row["text"] == f"Say {new}, then ({new})." and new != value
        if kind != "ip":
            assert shape(new) == shape(value) or kind == "secret"
        if kind == "card":
            assert luhn(new)
        if kind == "iban":
            assert iban(new) and new[:2] == value[:2]
        if kind == "ip":
            assert all(0 <= int(o) <= 255 for o in new.split("."))
        if kind == "secret":
            assert re.fullmatch("[0-9a-f]{40}", new)
        if kind == "phone" and value[0] == "+":
            assert new.split(" ")[0] == value.split(" ")[0]
        if kind == "email":
            assert new.rsplit(".", 1)[1] == value.rsplit(".", 1)[1]
    dates = {v: r["found"][0]["pseudonym"] for k, v, r in zip(kinds, values, rows, strict=True) if k == "date"}
    day = date.fromisoformat(dates["1984-02-29"])
    # One day, three formats: still one day.
    assert dates["29.02.1984"] == day.strftime("%d.%m.%Y") and dates["02/29/1984"] == day.strftime("%m/%d/%Y")


def test_invalid_values_stay(spark):
    rows = run(spark, [f"x {v} y" for v in OTHERS])
    assert [r["text"] for r in rows] == [f"x {v} y" for v in OTHERS]
    assert all(r["found"] == [] for r in rows)


@pytest.mark.parametrize("radices", [(17, 4297), (10, 10, 10, 1, 10), (3,), (1, 1), (2, 26, 5)])
def test_feistel_is_a_bijection(spark, radices):
    cells = list(itertools.product(*[range(r) for r in radices]))
    df = spark.createDataFrame([(list(c),) for c in cells], "v array<bigint>")
    d = f"named_struct('m', '', 'kind', 'x', 'v', v, 'r', array({', '.join(f'{r}L' for r in radices)}))"
    sql = f"transform(array({d}), d -> {ps.feistel('key', 6)})[0].v AS w"
    got = [tuple(r["w"]) for r in df.repartition(8).selectExpr(sql).collect()]
    assert sorted(got) == cells


def test_key_decides(spark):
    one, again, other = (run(spark, ["97.51.17.173"], key=k)[0]["text"] for k in ("a", "a", "b'\\"))
    assert one == again != other


def test_odd_documents(odd, none, odd_rows):
    rows = ps.pseudonymise(odd.withColumn("found", odd.doc_id)).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(repr, (r[:2] for r in odd_rows)))
    assert ps.pseudonymise(none).count() == 0


def test_query_replaces_every_planted_value(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_feistel_pseudonyms(spark, sf).collect()
    assert len(rows) == len(texts)
    planted = re.compile(
        r"[a-z]+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])"
        r"|(?<!\d)\d{16}(?!\d)|\b[0-9a-f]{40}\b"
    )
    n = 0
    for r in rows:
        values = [v for v in planted.findall(texts[r["doc_id"]]) if not re.fullmatch(r"\d{16}", v) or luhn(v)]
        assert r["n_values"] == len(values)
        n += len(values)
        assert not any(v in r["text"] for v in values)
        if not values:
            assert r["text"] == texts[r["doc_id"]]
    assert n > 50


BESIDE = {
    "+1 (826) 555-4081 190.137.223.204": ["+1 (826) 555-4081", "190.137.223.204"],
    "4111111111111111 12": ["4111111111111111"],
    "12 4111111111111111": ["4111111111111111"],
    "4111 1111 1111 1111 123": ["4111 1111 1111 1111"],
    "12 4111 1111 1111 1111 12": ["4111 1111 1111 1111"],
    "3782 822463 10005 20": ["3782 822463 10005"],
    "4111111111111111 5500-0000-0000-0004": ["4111111111111111", "5500-0000-0000-0004"],
    "BE68 5390 0754 7034 2024": ["BE68 5390 0754 7034"],
    "DE89370400440532013000 USA 7": ["DE89370400440532013000"],
    "AB11 BE68 5390 0754 7034": ["BE68 5390 0754 7034"],
    "(212) 555-1234 20": ["(212) 555-1234"],
    "20 (212) 555-1234 4111 1111 1111 1111": ["(212) 555-1234", "4111 1111 1111 1111"],
    "+49 30 1234 5678 4111 1111 1111 1111": ["+49 30 1234 5678", "4111 1111 1111 1111"],
    "+44 20 7946 0958 212-555-0199 1984-02-29": ["+44 20 7946 0958", "212-555-0199", "1984-02-29"],
    "+44 20 7946 0958 97.51.17.173 123-45-6789": ["+44 20 7946 0958", "97.51.17.173", "123-45-6789"],
    "a_4111111111111111@x.org 4111111111111111": ["a_4111111111111111@x.org", "4111111111111111"],
}


def test_values_side_by_side(spark):
    rows = run(spark, [f"{before}{t}{after}" for t in BESIDE for before, after in (("", ""), ("é, ", ". End"))])
    for i, (t, values) in enumerate(BESIDE.items()):
        for row, (before, after) in zip(rows[2 * i : 2 * i + 2], (("", ""), ("é, ", ". End")), strict=True):
            assert [f["value"] for f in row["found"]] == values, t
            want = t
            for f in row["found"]:
                want = want.replace(f["value"], f["pseudonym"], 1)
            assert row["text"] == before + want + after


def test_small_numbers_do_not_break_links(spark):
    """A value has one pseudonym, whatever numbers stand before and behind it."""
    values = ["4111111111111111", "4111 1111 1111 1111", "(212) 555-1234", "+1 (826) 555-4081", "BE68 5390 0754 7034"]
    around = ["{}", *[f"{n} {{}}" for n in (1, 12, 123, 1234)], *[f"{{}} {n}" for n in (1, 12, 13, 20, 123, 1234)]]
    rows = run(spark, [a.format(v) for v in values for a in around])
    for i, value in enumerate(values):
        found = [r["found"] for r in rows[i * len(around) : (i + 1) * len(around)]]
        assert all([f["value"] for f in fs] == [value] for fs in found), value
        assert len({fs[0]["pseudonym"] for fs in found}) == 1


def test_international_phones_of_any_grouping(spark):
    shapes = {"+493012345678": "+49", "+49 30 1234567": "+49", "+4930 1234567": "+49", "+35312345678": "+353",
              "+1-2125550199": "+1", "+44 7 911 123 456": "+44"}
    rows = run(spark, [f"call {v} or 4111111111111111" for v in shapes])
    for (value, code), row in zip(shapes.items(), rows, strict=True):
        assert [f["value"] for f in row["found"]] == [value, "4111111111111111"]
        new = row["found"][0]["pseudonym"]
        assert shape(new) == shape(value) and new.startswith(code) and new != value
    others = ["+0.12345678", "+123456", "+1234567890123456"]
    assert [r["text"] for r in run(spark, others)] == others
