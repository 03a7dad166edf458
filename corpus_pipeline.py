"""A corpus pipeline of five stages, each one an operator of ``rowloom.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. Stages but the
last return the columns of the documents; :func:`run` writes each stage's result and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import bpe, decontaminate, language, near_dup, sentence_spans
from rowloom.llm.common import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or sharing nothing with any language profile, go."""
    return language.keep_known(docs, language.fit(docs, where=~language.held_out()))


def one_per_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays."""
    return near_dup.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of sentences are cut out; ``n_chars`` follows the text."""
    return sentence_spans.remove_repeats(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text, per document."""
    return bpe.digests(docs.select("doc_id", "source", "text"), bpe.default_path())


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_per_near_copy),
    ("repeats", without_repeats),
    ("decontamination", decontaminated),
    ("tokens", tokens),
]

#: The banded search for near duplicates has no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
