"""A corpus pipeline over the table documents: language ID, quality rules, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pegspark.llm import langid, linededup, nearcopies, packing, quality
from pegspark.llm.common import read, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no letter go; a null lang is filled with the prediction, and stays where no row has one.

    A low score is no reason to reject: clean documents in two languages have one too.
    """
    found = langid.predict_rows(docs, langid.fit(docs))
    kept = found.filter(F.col("row.text").rlike(r"\p{L}"))
    lang = F.coalesce(F.col("row.lang"), F.when(F.col("lang_pred") != langid.UNKNOWN, F.col("lang_pred")))
    return kept.select(*(lang.alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the production policy go."""
    return quality.verdicts(quality.ledger_rows(docs)).filter("kept").select("row.*")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines frequent within their source go; every document stays."""
    return linededup.dedup(docs, "source").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (at least 0.8 of their five-word shingles in common) stays."""
    return nearcopies.representatives(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences, with checksums for their ids."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("line dedup", drop_boilerplate_lines),
    ("near-dedup", drop_near_copies),
    ("packing", pack_sequences),
]
#: Trained machines, fingerprints and tokenizers are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, f"stage-{k}")
    return docs
