"""From raw documents to packed sequences: each stage takes what the one before it kept.

The stages read doc_id, text and lang and carry all other columns along, whatever their names.
Null and empty texts have no language and go in the first stage. An empty table runs through
all stages and gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notalith.llm import dedup, langid, ngram_join, packing, pii
from notalith.llm.common import table, written

#: A document whose language is less likely than this is rejected, like one without letters.
LEAST_SCORE = 0.3
#: Words of a shingle and the similarity in percent from which documents are near copies.
SHINGLE, SIMILAR = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which a language is recognised."""
    net = langid.train(langid.training_part(docs))
    found = langid.identify(docs.select(F.struct("*").alias("row"), "text"), net, ["row"])
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar shingle sets connect."""
    return ngram_join.drop_similar(docs, SHINGLE, SIMILAR)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data; n_chars follows the text."""
    out = pii.replace(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", known_language), ("exact_dedup", exact_copies), ("ngram_join", near_copies), ("pii", private_data), ("packing", packed)]

#: A trained network and a tokenizer are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
