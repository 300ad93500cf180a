"""The corpus pipeline: language, near duplicates, personal data, mixture, packing; each stage on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagecraft.llm import langid, mixing, packing, pii, simhash
from passagecraft.llm.common import materialize, small_batches, table, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is in a language that can be told; lang becomes the predicted one.

    A null or empty text, and one without a letter, is in none and goes. Where nothing can be learned, as from an empty
    table, nothing stays. Repeated rows are judged alike, and columns of any name pass through.
    """
    small_batches(spark)
    told = unused(docs, "told")
    found = langid.identify(docs, langid.fit(docs), told).where(F.col(told)["lang"] != langid.UNKNOWN)
    return found.withColumn("lang", F.col(told)["lang"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, as simhash.keep_one() says for ties, nulls and repeated rows."""
    small_batches(spark)
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with personal data replaced and n_chars counted anew; null text stays null, with null n_chars."""
    small_batches(spark)
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one with null or empty text has no words, and its source says how often."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they stand; a document of null or empty text is one piece, the id that ends it."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: Learned models, fingerprints and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each one but the last returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", narrow=False)
    return STAGES[-1][1](spark, docs, sf_dir)
