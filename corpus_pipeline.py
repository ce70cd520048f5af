"""A training corpus from the table documents, stage by stage.

Language identification drops texts that it rejects and writes the language it
predicts for the others into lang, near duplicates leave one document of each class, documents that hold a benchmark
item go, secrets are replaced in the texts, and what is left is packed.

Defined results: a text that is null, empty or without letters is rejected by the
first stage; of rows that share a doc_id one stays, the one whose text comes
first; a row with a null doc_id is a document by its text, and of equal ones one
stays; of a class the smallest doc_id stays; texts of any length are read whole;
an empty table gives no rows; the stages before the last return all columns of
the table and change text and lang alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, languages, near_dup, packing, secrets
from skein.llm.common import dropped, new_dir, table
from skein.llm.encoding import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows, with the predicted language as
    lang. A text is rejected or not, so repeated or null ids do not matter."""
    return languages.recognised(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs, threshold=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), threshold=0.8)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 2048)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", replace_secrets),
    ("packing", pack_sequences),
]

#: No SQL states what trained language identification and packing return.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read by the next; a table
    goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            dropped(spark, before)
        before = path
    return docs
