"""The corpus pipeline: language, near-duplicates, personal data, mixture, packing; each stage on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowarden.llm import curriculum, language, packing, pseudonyms, simhash
from flowarden.session import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, no letter) go; the others get the language found as ``lang``.

    The model learns from all documents with a language that are not held out. Without any, all documents go.
    """
    model = language.learn(docs.where(~language.held_out()))
    found = docs.withColumn("__found", language.identify("text", model)["lang_pred"]).where(F.col("__found") != language.UNKNOWN)
    return found.withColumn("lang", F.col("__found")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest id.

    The SimHash operator decides, with its own shingle length and bit distance.
    """
    return simhash.keep_one(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by format-preserving pseudonyms; ``n_chars`` follows where a text changed."""
    hidden = pseudonyms.pseudonymise(docs, found_as="__found")
    changed = F.when(F.size("__found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return hidden.withColumn("n_chars", changed).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whole, repeated or left out as their source's target asks, in the order of the curriculum."""
    return curriculum.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences; a document that the mixture repeats is packed as often."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None  # trained profiles and a tokenizer: checked against brute force in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
