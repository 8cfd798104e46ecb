"""Small tables of awkward documents for the text operators."""

import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 997} other{i % 13}" for i in range(60_000))
    line = "A line that many documents share, word for word."
    texts = [
        None, "", " ", "\n", "\n\n\n", "\t \r\n\x0b\x0c", "a", "é", "12345", "…!?", line,
        line + "\n" + line, "  " + line.upper() + "  \nOwn words stand here.", "tail\n" + line + "\n",
        long, "x" * 300_000, "# $ % & | < > *\n# $ % & | < > *\nÉté où ça", "nul \x00 byte and   space",
        "\U0001f600 smile \U0001f600\nsmile", "Σ greek Ω words ΑΒΓ",
    ]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 2}", None) for i, t in enumerate(texts)]
    rows += [rows[11], rows[11], (None, line, "de", "s1", 3), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
