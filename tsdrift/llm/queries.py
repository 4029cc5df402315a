"""Registered queries of the corpus operators, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tsdrift.llm import (
    hpy_lm, html_main, iblt, langid, lexical, line_dedup, mixing, packing, phrases, preference, quality_rules, setsketch, simhash)
from tsdrift.llm.common import fold, table
from tsdrift.llm.oracle import ORACLE  # noqa: F401  (read by the entry module)
from tsdrift.session import materialize


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = quality_rules.passes(quality_rules.POLICIES[0])
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
        (~base).alias("base_failed"), quality_rules.passes(quality_rules.PRODUCTION).alias("kept"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.format_pairs(preference.mismatched_pairs(table(spark, sf_dir, "conversations")))
    spans = {c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
             for c in ("chosen_mask", "rejected_mask")}
    return pairs.withColumns(spans)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "text", "dropped_lines")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.summary(table(spark, sf_dir, "documents")).drop("first_shard")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(table(spark, sf_dir, "documents").select(
        "doc_id", simhash.fingerprints(F.col("text")).alias("fp")), "simhash")
    return simhash.near_duplicates(prints).select(
        "doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hpy_lm.score(docs, fold(F.col("doc_id"), 5) == 1)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.versions(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.tokenizer_path())


def op7_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", (fold(F.col("doc_id"), 3) == 1).alias("held_out"))
    protos = langid.prototypes(docs.where("not held_out"))
    return langid.predict(docs.drop("lang"), protos)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "quality_ablation": quality_ablation,
    "op5_preference": op5_preference,
    "op2_simhash": op2_simhash,
    "op3_language_model": op3_language_model,
    "op4_fingerprints": op4_fingerprints,
    "op6_packing": op6_packing,
    "op7_html_main": op7_html_main,
    "op10_language": op10_language,
    "pipeline": corpus_pipeline.run,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op11_phrases": op11_phrases,
    "op12_search": op12_search,
    "op13_setsketch": op13_setsketch,
}
