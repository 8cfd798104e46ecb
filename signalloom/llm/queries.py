"""The registered queries of the text operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import (
    decontaminate,
    divergence,
    imatch,
    jaccard_join,
    language_id,
    license_rules,
    line_dedup,
    packing,
    prefix_trie,
    pseudonyms,
    quality_knn,
    quality_rules,
    sharding,
)
from signalloom.llm.tables import read, written

# Rows whose labels no model learns from.
HELD_OUT = "crc32(cast(doc_id AS string)) % 4 = 2"

Query = Callable[[SparkSession, str], DataFrame]
LLM_CATALOG: dict[str, Query] = {}


def query(fn: Query) -> Query:
    LLM_CATALOG[fn.__name__] = fn
    return fn


@query
def op1_feistel_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs).select(
        "doc_id", "text", F.size("found").alias("n_values"),
        F.expr("array_join(array_sort(array_distinct(found.kind)), ',')").alias("kinds"),
    )


@query
def op2_risk_controlled_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "lang", "text")
    counts = written(quality_rules.document_counts(docs), "counts")
    judged = quality_rules.judge(counts, read(spark, sf, "labels"), "lang")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "reject_step", "step",
    )


@query
def op3_sentence_rule_licenses(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return license_rules.recognise(docs).select(
        "doc_id",
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join("sentence_ids.id", ",").alias("sentence_ids"),
        F.size("sentence_ids").alias("n_known"),
    )


@query
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


@query
def op5_error_correcting_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(f"NOT ({HELD_OUT})"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


@query
def op6_feistel_sharding(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sized = read(spark, sf, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return sharding.assign_shards(sized).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = jaccard_join.join_documents(read(spark, sf, "documents"))
    return joined.withColumnRenamed("n_grams", "n_shingles")


@query
def op9_nearest_neighbour_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    labels = read(spark, sf, "labels").where(f"NOT ({HELD_OUT})")
    scored = quality_knn.score(docs, quality_knn.train(docs, labels))
    return scored.select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@query
def op10_seeded_alignment(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    copies = decontaminate.contaminated(docs, read(spark, sf, "benchmark"))
    return copies.select("doc_id", "item_id", "score", "n_seeds", "begin", "end")


@query
def op11_imatch_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return imatch.edited_likeness(docs, imatch.lexicon(docs)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next",
    )


@query
def op12_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(read(spark, sf, "documents"))


@query
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    trie = prefix_trie.rebuilt_trie(read(spark, sf, "conversations"))
    return trie.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
