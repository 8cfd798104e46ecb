"""Documents through the text operators, stage by stage, to packed training sequences.

Each stage takes what its predecessor kept, as a written table. All but the last return
the columns of ``documents``; the last one returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from signalloom.llm.tables import read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Near copies have 80 % of their five-word n-grams in common (the op8 query: four words, 85 %).
NEAR_WORDS, NEAR_PERCENT = 5, 80


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the operator finds a language for; those without a letter go."""
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs.select(*COLUMNS), model)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds too are cut out; n_chars follows."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, once."""
    own = docs.select(*COLUMNS)
    linked = written(jaccard_join.join_documents(docs, NEAR_WORDS, NEAR_PERCENT), "linked")
    first = written(linked.where("doc_id = component_id").select("doc_id").distinct(), "first")
    kept = jaccard_join.only(own, first)
    # Rows that share an id, if there are any, leave one; no other text is shuffled for it.
    shared = linked.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    shared = written(shared, "shared")
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), *COLUMNS[1:])
    one = jaccard_join.only(kept, shared).withColumn("_nth", F.row_number().over(once))
    out = kept.join(shared, "doc_id", "left_anti").unionByName(one.where("_nth = 1").drop("_nth"))
    return out.unionByName(own.where("doc_id IS NULL")).select(*COLUMNS)


def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or edited, go."""
    benchmark = read(spark, sf_dir, "benchmark")
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), benchmark).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", languages),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_copies),
    ("best-fit packing", sequences),
]
# Trained models, alignment and a tokenizer are beyond SQL; tests check each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
