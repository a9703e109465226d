"""A corpus pipeline: stages that each call one operator of millrace.llm.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that its predecessor kept; run() writes what a stage
returns and reads it back for the next one. All but the last return the columns of documents.

For every stage: columns beyond those of documents pass through, whatever their names; repeated rows are judged alike; empty tables
give empty ones; texts are read whole, however long; null ids and labels are values like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, exact_dedup, language_id, sentence_pieces, simhash
from millrace.llm.common import forget, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language no model recognises go, and those without a letter, null and empty ones too. Of languages that fit
    equally well the one that sorts first counts."""
    return language_id.accepted_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z and a-z alike, null as empty) the row with the largest id stays, one of several with that id, decided
    through a digest index of the run."""
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the least id, then of the least hash of its text. Null and
    empty texts are one group."""
    return simhash.kept_documents(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are words of benchmark passages go; exactly a twentieth goes too. Documents
    without words stay, and all stay where the benchmark is empty."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text they decode to; an empty text is the end id alone."""
    return sentence_pieces.op7_sentencepiece(spark, docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("decontaminate", benchmark),
    ("sentencepiece", pieces),
]

#: Language models and sub-word merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, written = stored(docs, f"stage-{name}")
            if before:
                forget(spark, before)
            before = written
    return docs
