"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bpe, contamination, html, jaccard, langid, minhash, pii, quality, spelling, suffixes, toxicity, urls, vectorcodes
from .common import fold
from .oracles import ORACLES  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.extract(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return made.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("all_spans")).alias("spans"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.host_quality(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), ["page_id"], urls.RULES)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = langid.learn_and_identify(table(spark, sf_dir, "documents"), ["doc_id"])
    return made.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("word_bpe_49k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_ids(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = toxicity.learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return made.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.codes(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality_rules, op3_suffix_dedup, op4_html_extraction, op5_url_filters, op6_language_id, op7_decontamination, op8_bpe, op9_jaccard_join, op10_toxicity, op11_spelling_variants, op12_minhash, op13_vector_codes)}
