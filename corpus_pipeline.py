"""A corpus job: toxic texts out, unreadable ones out, recurring lines out, near duplicates out, then packed.

Each stage reads what the one before has written, and all but the last give back the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epicell.llm import byte_cnn, line_templates, ngram_join, packing, toxicity
from epicell.llm.queries import WORD_VOCABULARY, held_out, ship_package, table
from epicell.session import settle

TOXIC_FROM = 0.7
# a text is unreadable when it has no letter, or no language reaches this share
READABLE_FROM = 0.35


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold. The field learns from the labels of the input tables.

    NULL and empty texts have nothing toxic and stay; copies and rows with equal keys are judged alike.
    """
    labels = table(spark, sf_dir, "labels").where(~held_out(3, 1))
    model = toxicity.train(table(spark, sf_dir, "documents"), labels)
    return toxicity.drop_toxic(docs, model, TOXIC_FROM)


def readable(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; it learns from the languages of the input tables.

    NULL and empty texts, and those without a letter, are in none and go.
    """
    model = byte_cnn.train(table(spark, sf_dir, "documents").where(~held_out(3, 1)))
    return byte_cnn.keep_readable(docs, model, READABLE_FROM).select(*docs.columns)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs; `n_chars` follows the text.

    A long line goes from two different texts on, and any line that recurs word for word.
    """
    cleaned = line_templates.drop_recurring_lines(docs, min_long_texts=line_templates.MIN_LONG_TEXTS, verbatim=True)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("dropped_lines") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    ship_package(spark)
    return ngram_join.keep_one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with the crc32 of their ids. A NULL or empty text is its end id alone."""
    ship_package(spark)
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path(WORD_VOCABULARY)))


STAGES = [
    ("toxicity", without_toxic),
    ("language", readable),
    ("line_dedup", without_recurring_lines),
    ("near_duplicates", without_near_duplicates),
    ("packing", packed),
]

# models, tokenizer and packing order are beyond SQL: the stages are tested one by one
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
