"""How the word use of sources differs, within each language, in exact whole numbers.

Groups are (lang, source). All pairs of groups are compared over all terms in a cube of
cells (group block, group block, term block): a cell gets the slices of its two group
blocks over its term block, each replicated along the cube's other group axis, and
computes its part of every divergence; the parts are added along the term axis. A
cell's size is fixed, so neither many sources nor many terms make a task large.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.tables import written

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
# Groups and terms of one block of the cube.
GROUP_BLOCK, TERM_BLOCK = 32, 4096
# Counters a task holds before it sends them on.
HELD = 300_000

# A-Z to a-z; what is neither an ASCII letter nor part of a multi-byte character separates.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term per (lang, source), added up over many rows."""
    terms: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in terms.items():
            n = len(counts)
            held = docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                 pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()),
                 pa.array([held[t] for t in counts], pa.int64())],
                names=["lang", "source", "term", "n", "n_docs"],
            )
        terms.clear()
        docs.clear()

    for batch in batches:
        for row in range(batch.num_rows):
            lang, source, text = (batch.column(c)[row].as_py() for c in ("lang", "source", "text"))
            words = Counter(text.encode("utf-8").translate(LETTERS).split())
            if words:
                terms.setdefault((lang, source), Counter()).update(words)
                docs.setdefault((lang, source), Counter()).update(words.keys())
        if sum(map(len, terms.values())) > HELD:
            yield from flush()
    yield from flush()


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, total, first): counts of the terms that a language keeps.

    ``total`` is the term's count in its language and ``first`` true in one row of each
    (lang, term). ``docs`` has lang, source and text without nulls; each row is a document.
    """
    kind = "lang string, source string, term string, n bigint, n_docs bigint"
    counted = docs.select("lang", "source", "text").mapInArrow(_counted, kind)
    # Tasks have added up their rows; by term, a task gets one row per task and source.
    counts = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")
    )
    term = Window.partitionBy("lang", "term")
    return counts.withColumns({
        "total": F.sum("n").over(term), "_docs": F.sum("n_docs").over(term),
        "first": F.row_number().over(term.orderBy("source")) == 1,
    }).where(F.col("_docs") >= least).drop("_docs", "n_docs")


def share(count: str, n: str, v: str) -> str:
    """SQL of the smoothed share, in parts of ``SCALE`` and one more."""
    return f"(1L + (cast({SCALE} AS decimal(10, 0)) * ({count} + 1)) div ({n} + {v}))"


def measured(docs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, n_group, place) and languages (lang, n_lang, v, n_groups).

    Every occurring group and language is there; ``place`` numbers a language's groups.
    """
    groups = docs.select("lang", "source").distinct().join(
        kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group")), ["lang", "source"], "left"
    ).select(
        "lang", "source", F.coalesce("n_group", F.lit(0).cast("long")).alias("n_group"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"),
    )
    groups = written(groups, "groups")
    sizes = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum(F.col("first").cast("long")).alias("v"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_groups")).join(sizes, "lang", "left").na.fill(0)
    return groups, written(langs, "languages")


def telling_terms(kept: DataFrame, groups: DataFrame, langs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): terms a source uses more than its language does.

    The value is floor((p - q)^2 / q) of the shares in the source and in the language;
    the ``top`` terms of each source are kept, ties in the order of their UTF-8 bytes.
    """
    shares = kept.join(groups, ["lang", "source"]).join(langs, "lang").where("n > 0").selectExpr(
        "lang", "source", "term AS item", f"{share('n', 'n_group', 'v')} AS p", f"{share('total', 'n_lang', 'v')} AS q"
    )
    valued = shares.where("p > q").selectExpr("lang", "source", "item", "(p - q) * (p - q) div q AS value")
    return ranked(valued).where(F.col("rank") <= top)


def ranked(valued: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order))


def _cell(key: tuple, table: pa.Table) -> pa.Table:
    """The divergences of a cell: the groups of one block from those of the other, both ways.

    Rows without a term are the groups, with the share of a term they don't have; the
    cell's terms that none of them has differ by that share alone.
    """
    _, a, b, _ = (k.as_py() for k in key)
    is_group = table["term"].is_null().to_numpy()
    block, place, p = (table[c].to_numpy() for c in ("block", "place", "p"))
    order = np.flatnonzero(is_group)[np.argsort(place[is_group])]
    places, blocks, absent = place[order], block[order], p[order]
    terms = table["term"].filter(pa.array(~is_group)).combine_chunks().dictionary_encode()
    shares = np.repeat(absent[:, None], len(terms.dictionary), axis=1)
    shares[np.searchsorted(places, place[~is_group]), terms.indices.to_numpy()] = p[~is_group]
    # One column for a term that none of them has, counted as often as there are such.
    shares = np.concatenate([shares, absent[:, None]], axis=1)
    times = np.ones(shares.shape[1], dtype=np.int64)
    times[-1] = table["n_terms"][int(order[0])].as_py() - len(terms.dictionary)
    mine, other = np.flatnonzero(blocks == a), np.flatnonzero(blocks == b)
    out: list[list[np.ndarray]] = [[], [], []]
    for i in mine:
        theirs = other[other != i]
        squares = (shares[i] - shares[theirs]) ** 2
        there = (squares // shares[theirs]) @ times
        sides = [(np.full(len(theirs), places[i]), places[theirs], there)]
        if a != b:
            sides.append((places[theirs], np.full(len(theirs), places[i]), (squares // shares[i]) @ times))
        for side in sides:
            for column, values in zip(out, side, strict=True):
                column.append(values)
    lang = key[0].as_py()
    columns = [np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in out]
    return pa.table({
        "lang": pa.array([lang] * len(columns[0]), pa.string()),
        "place": columns[0], "other": columns[1], "value": columns[2],
    })


def divergences(
    kept: DataFrame, groups: DataFrame, langs: DataFrame,
    group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK,
) -> DataFrame:
    """(lang, source, item, value): of every group from each other group of its language.

    The value is the sum of floor((p - q)^2 / q) over all kept terms, q being the other
    group's share; 0 in a language without kept terms.
    """
    cube = langs.selectExpr(
        "lang", "v", f"ceil(n_groups / {group_block}) AS n_blocks", f"greatest(ceil(v / {term_block}), 1L) AS n_slices"
    )
    at = groups.join(cube, "lang").withColumn("block", F.expr(f"place div {group_block}"))
    slices = kept.join(at, ["lang", "source"]).selectExpr(
        "lang", "block", "place", "n_blocks", "term", f"{share('n', 'n_group', 'v')} AS p",
        "pmod(xxhash64(term), n_slices) AS slice", "cast(NULL AS bigint) AS n_terms",
    )
    in_slice = kept.where("first").join(cube, "lang").groupBy(
        "lang", F.expr("pmod(xxhash64(term), n_slices)").alias("slice")
    ).agg(F.count("*").alias("n_terms"))
    # Without kept terms any share will do.
    named = at.selectExpr(
        "lang", "block", "place", "n_blocks", "cast(NULL AS string) AS term",
        f"if(v = 0, 1L, {share('0L', 'n_group', 'greatest(v, 1L)')}) AS p", "explode(sequence(0L, n_slices - 1)) AS slice",
    ).join(in_slice, ["lang", "slice"], "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0).cast("long")))
    cells = slices.unionByName(named.select(*slices.columns)).selectExpr(
        "*", "explode(sequence(0L, n_blocks - 1)) AS with"
    ).selectExpr(
        "lang", "least(block, with) AS a", "greatest(block, with) AS b", "slice",
        "cast(block AS bigint) AS block", "cast(place AS bigint) AS place", "term", "p", "n_terms",
    )
    parts = cells.groupBy("lang", "a", "b", "slice").applyInArrow(
        _cell, "lang string, place bigint, other bigint, value bigint"
    )
    sums = parts.groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))
    one = groups.select("lang", "place", "source")
    two = groups.select("lang", F.col("place").alias("other"), F.col("source").alias("item"))
    return sums.join(one, ["lang", "place"]).join(two, ["lang", "other"]).select("lang", "source", "item", "value")


def audit(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS,
    group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text).

    Part ``pair`` lists for each group all other sources of its language by divergence,
    part ``term`` the terms that tell it from its language. Null lang, source and text
    are empty; each row is a document, repeated ones too; other columns are ignored.
    Ties are ranked by the item's UTF-8 bytes. No documents give no rows.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = written(kept_terms(docs, least), "kept_terms")
    groups, langs = measured(docs, kept)
    pairs = ranked(divergences(kept, groups, langs, group_block, term_block)).withColumn("part", F.lit("pair"))
    terms = telling_terms(kept, groups, langs, top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
