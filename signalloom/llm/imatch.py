"""I-Match fingerprints: hashes of the terms a document shares with random sub-lexicons.

The lexicon holds the terms of a chosen band of inverse document frequency: neither so
common that all documents have them nor so rare that only few do. A document's terms
within it, distinct and sorted, are hashed once as a whole and once per sub-lexicon.
Sub-lexicons are random; their sizes from a 16th to a 1,024th of the lexicon make
sure that some hold few terms of a document, however long it is, so edited copies
keep a part of the hashes. Everything is an SQL expression on the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.tables import ascii_lower, written
from signalloom.operators.numbering import split_points, with_bucket

# The band: terms in at least two documents and one in RARE of them, at most one in COMMON.
RARE, COMMON = 1024, 8
# Of the band's terms, the most common ones; that bounds the lexicon (64 KB) at any size.
LEXICON = 1 << 13
# Sub-lexicons: sixteen random families of four sizes, each smaller one within the larger.
FAMILIES, LEVELS = 16, 4
# Hexadecimal digits of their hashes, and of the hash of all terms, which tells texts
# apart; the short ones only have to tell how much of two texts agrees.
DIGITS, WHOLE = 4, 16
SUBSETS = FAMILIES * LEVELS
NONE = "-" * DIGITS

# Runs of ASCII characters other than letters and digits.
SEPARATORS = "[\\\\x00-\\\\x2F\\\\x3A-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]+"

TERMS = f"""transform(array_distinct(filter(split(low, '{SEPARATORS}'), w -> w <> '')),
    w -> cast(conv(substr(md5(w), 1, 15), 16, 10) AS bigint))"""


def fresh(taken: list[str], name: str) -> str:
    """``name``, or a longer one that isn't taken."""
    while name in taken:
        name += "_"
    return name


def lexicon(docs: DataFrame, rare: int = RARE, common: int = COMMON, size: int = LEXICON) -> DataFrame:
    """(term): the terms of the band, at most ``size``, a written table.

    Document frequencies are those of all rows of ``docs``. Of equally common terms at
    the edge those with the smaller number stay.
    """
    n = docs.agg(F.count(F.lit(1))).scalar()
    low = docs.select(ascii_lower(F.coalesce("text", F.lit(""))).alias("low"))
    counts = low.select(F.explode(F.expr(TERMS)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = counts.where((F.col("df") >= 2) & (F.col("df") * rare >= n) & (F.col("df") * common <= n))
    return written(band.orderBy(F.desc("df"), "term").limit(size).select("term"), "lexicon")


def with_fingerprint(
    docs: DataFrame, lexicon: DataFrame, text: str = "text", name: str = "fingerprint"
) -> DataFrame:
    """``docs`` with the fingerprint of a text column: equal texts have equal ones.

    It is a hash of all the text's terms in the lexicon, then one per sub-lexicon; the
    hash of an empty selection is all dashes. A text without terms in the lexicon is
    taken by all its terms. Null is empty. A column called ``name`` is replaced.
    """
    docs = docs.drop(name)
    low, own, inside, chosen = (fresh(docs.columns, c) for c in ("low", "own", "inside", "chosen"))
    known = lexicon.agg(F.collect_list("term")).scalar()  # one row of at most ``size`` numbers
    digest = "substr(md5(array_join(cast({} AS array<string>), ',')), 1, {})".format
    # A window of a term's bits below 64, then 16, 4 and 1 of 1,024: a quarter of the terms before.
    smaller = "filter(element_at(a, -1), t -> shiftright(t, f * 3) % 1024 < shiftright(64, 2 * l))"
    nested = f"slice(aggregate(sequence(0, {LEVELS - 1}), array({chosen}), (a, l) -> array_append(a, {smaller})), 2, {LEVELS})"
    hashes = f"""transform(flatten(transform(sequence(0, {FAMILIES - 1}), f -> {nested})),
        s -> if(size(s) = 0, '{NONE}', {digest('s', DIGITS)}))"""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    docs = docs.withColumn(low, ascii_lower(F.coalesce(F.col(text), F.lit(""))))
    docs = docs.select(*columns, F.expr(TERMS.replace("split(low", f"split({low}")).alias(own))
    docs = docs.withColumn(inside, F.array_intersect(known, F.col(own)))
    docs = docs.select(*columns, F.expr(f"sort_array(if(size({inside}) > 0, {inside}, {own}))").alias(chosen))
    return docs.select(*columns, F.expr(f"concat({digest(chosen, WHOLE)}, array_join({hashes}, ''))").alias(name))


def likeness(a: str, b: str) -> Column:
    """Of the sub-lexicons with a term of either text, the share whose hashes are equal.

    1 for equal texts, 0 for texts without a common term. Where no sub-lexicon has a
    term, the hashes of all terms decide.
    """
    at = f"{WHOLE + 1} + k * {DIGITS}, {DIGITS}"
    same = f"substr({a}, {at}) = substr({b}, {at})"
    some = f"(substr({a}, {at}) <> '{NONE}' OR substr({b}, {at}) <> '{NONE}')"
    count = f"size(filter(sequence(0, {SUBSETS - 1}), k -> {{}}))".format
    return F.expr(
        f"if({count(some)} = 0, if({a} = {b}, 1D, 0D), {count(f'{same} AND {some}')} / cast({count(some)} AS double))"
    )


def with_next(
    rows: DataFrame, prepare: Callable[[DataFrame], DataFrame], values: list[str], splits: int | None = None
) -> DataFrame:
    """``prepare(rows)`` (doc_id, h, …) with ``next``: a struct of the next row's ``values``.

    ``prepare`` works row by row, so it can also be applied to the few rows that are
    looked up. The next row is the one that follows by descending (doc_id, h), null last; after the
    last comes the first. Rows equal in both follow each other. Rows are dealt once, in
    ranges found by a sample; only the ranges' last rows (one each) are looked up.
    """
    if splits is None:
        splits = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, order = ["everything"], ["doc_id", "h"]
    dealt = rows.withColumn("everything", F.lit(1))
    points = split_points(dealt.select(*keys, *order), keys, order, splits)
    placed = prepare(with_bucket(dealt, keys, order, points, splits, "range").drop(*keys))
    # Descending order seen from its end: the next row is the one before.
    along = Window.partitionBy("range").orderBy("doc_id", "h")
    linked = placed.withColumn("before", F.lag(F.struct(*values)).over(along))
    # The last row of each range is the next of the following range's first one.
    ids = with_bucket(dealt.select(*keys, *order), keys, order, points, splits, "range")
    ends = ids.groupBy("range").agg(F.max(F.struct(*order)).alias("end"))
    ranges = ends.withColumns({
        "after": F.lead("range").over(Window.orderBy("range")), "least": F.min("range").over(Window.partitionBy())
    }).select(F.coalesce("after", "least").alias("range"), F.col("end.doc_id").alias("e"), F.col("end.h").alias("eh"))
    ranges = F.broadcast(ranges)  # a row per range
    found = prepare(rows.join(ranges, F.expr("doc_id <=> e AND h = eh")))
    found = found.groupBy("range").agg(F.first(F.struct(*values)).alias("end"))
    return linked.join(found, "range", "left").withColumn("next", F.coalesce("before", "end")).drop("range", "before", "end")


def edited_likeness(docs: DataFrame, lexicon: DataFrame, splits: int | None = None) -> DataFrame:
    """What fingerprints make of an edit: one row per row of ``docs`` (doc_id, text, …).

    The edited text is the text with its last floor(n / 2) code points replaced by the
    first as many (or all) of the next document's. Returns doc_id, n_chars, edited,
    fingerprint, edited_fingerprint, near_edited and near_next, the likeness to the
    edited text and to the next document. Null text is empty. The order is by doc_id,
    descending, null last; rows of one id are ordered by their text's hash.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    linked = with_next(own, lambda rows: with_fingerprint(rows, lexicon), ["text", "fingerprint"], splits)
    edited = linked.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.expr("concat(left(text, char_length(text) - char_length(text) div 2), left(next.text, char_length(text) div 2))").alias("edited"),
        "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"),
    )
    both = with_fingerprint(edited, lexicon, "edited", "edited_fingerprint")
    return both.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
