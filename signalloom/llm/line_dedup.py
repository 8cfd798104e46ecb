"""Lines that other documents hold too, dropped by keep bitmaps.

Every line's hash is dealt by range together with its document and position; a
sorted pass over each range streams the first occurrences. A hash held by many
documents is salted by document, so one range sees a bounded part of it: rows
that aren't the first of their salt are dropped at once, and only the first ones
(at most ``salts`` documents per hash) meet in a second pass. Text takes no part
in this; what returns is, per document that loses lines, a run-length compressed
bitmap of the lines it keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.tables import BLANKS, ascii_lower, free_prefix, wide_hash, written

SALTS = 256
MIN_LENGTH = 10

LINES = "split(coalesce(text, ''), '\n', -1)"


def row_hash() -> Column:
    """Tells apart rows that share a doc_id but not the text."""
    return F.xxhash64(F.col("text"))


def line_keys(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, row_hash, n_lines, pos, h1, h2) of every line whose key is long enough."""
    lines = docs.select("doc_id", row_hash().alias("row_hash"), F.expr(LINES).alias("lines"))
    exploded = lines.select(
        "doc_id", "row_hash", F.size("lines").alias("n_lines"),
        F.posexplode("lines").alias("pos", "line"),
    )
    keyed = exploded.withColumn("key", F.btrim("line", F.lit(BLANKS)))
    keyed = keyed.where(F.length("key") >= min_length).withColumn("key", ascii_lower(F.col("key")))
    h1, h2 = wide_hash(F.col("key"))
    return keyed.select("doc_id", "row_hash", "n_lines", "pos", h1.alias("h1"), h2.alias("h2"))


def line_bitmaps(
    docs: DataFrame, min_length: int = MIN_LENGTH, salts: int = SALTS
) -> DataFrame:
    """(doc_id, row_hash, n_lines, n_dropped, keep_runs) of documents that lose lines.

    ``keep_runs`` is an array of (start, length), the runs of kept lines. A line's
    key is the line stripped of blanks, A-Z lower-cased. A key of ``min_length`` code
    points or more held by two or more documents keeps its lines in the document of
    the smallest doc_id only, there all of them. Null text is one empty line. Rows
    with one doc_id are one document for this; a null doc_id is the smallest.
    """
    keys = written(line_keys(docs, min_length), "line_keys")
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    by_salt = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos")
    streamed = salted.repartitionByRange("h1", "h2", "salt").withColumn(
        "first", F.first("doc_id").over(by_salt)
    )
    # Read twice, so it is written: neither branch runs the pass again.
    streamed = written(
        streamed.select(
            "doc_id", "row_hash", "n_lines", "pos", "h1", "h2",
            F.expr("NOT (doc_id <=> first)").alias("later"),
        ),
        "line_firsts",
    )
    later = streamed.where("later")
    by_key = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    later_salts = (
        streamed.where("NOT later")
        .withColumn("first", F.first("doc_id").over(by_key))
        .where("NOT (doc_id <=> first)")
    )
    columns = ["doc_id", "row_hash", "n_lines", "pos"]
    dropped = later.select(*columns).unionByName(later_salts.select(*columns))
    # The same row may occur twice in the input: positions are a set.
    per_doc = dropped.groupBy("doc_id", "row_hash").agg(
        F.max("n_lines").alias("n_lines"),
        F.array_sort(F.collect_set("pos")).alias("gone"),
    )
    runs = """filter(
        transform(
            arrays_zip(concat(array(-1), gone), concat(gone, array(n_lines))),
            g -> struct(g.`0` + 1 AS start, g.`1` - g.`0` - 1 AS length)),
        r -> r.length > 0)"""
    return per_doc.select(
        "doc_id", "row_hash", "n_lines", F.size("gone").alias("n_dropped"),
        F.expr(runs).alias("keep_runs"),
    )


def dedup_lines(
    docs: DataFrame, min_length: int = MIN_LENGTH, salts: int = SALTS
) -> DataFrame:
    """``docs`` with the text of kept lines, and ``n_lines`` and ``n_dropped`` (long).

    All rows and columns stay. Null text becomes empty (one line, none dropped).
    Columns of ``docs`` called n_lines or n_dropped are replaced.
    """
    p = free_prefix(docs.columns)
    bitmaps = line_bitmaps(docs, min_length, salts).select(
        F.col("doc_id").alias(f"{p}doc"), F.col("row_hash").alias(f"{p}row"),
        F.col("n_dropped").alias(f"{p}dropped"), F.col("keep_runs").alias(f"{p}runs"),
    )
    own = docs.drop("n_lines", "n_dropped").withColumn(f"{p}own", row_hash())
    joined = own.join(
        bitmaps, F.expr(f"doc_id <=> {p}doc AND {p}own = {p}row"), "left"
    )
    kept = f"""CASE WHEN {p}runs IS NULL THEN coalesce(text, '') ELSE
        array_join(flatten(transform({p}runs, r -> slice({LINES}, r.start + 1, r.length))), '\n') END"""
    n_lines = "length(coalesce(text, '')) - length(replace(coalesce(text, ''), '\n', '')) + 1"
    return joined.select(
        *[F.col(f"`{c}`") if c != "text" else F.expr(kept).alias("text")
          for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.expr(n_lines).cast("long").alias("n_lines"),
        F.coalesce(f"{p}dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )
