"""A corpus pipeline: language ID, near-duplicate removal, decontamination, personal data, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import bpe, contamination, jaccard, langid, pii
from tallystone.llm.common import materialise
from tallystone.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that the labelled ones teach."""
    ship(spark)
    return langid.in_known_language(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each component of similar ones."""
    ship(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages, by the contamination rule."""
    return contamination.decontaminated(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the new text."""
    made = pii.redact(docs)
    return made.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in made.columns else made


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the number of tokens, digests of ids and decoded text, and the ids."""
    ship(spark)
    return bpe.encode(docs, ["doc_id", "lang", "source"], public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's output is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: language profiles, signatures and encoding can't be expressed in it.
ORACLE_SQL = None
