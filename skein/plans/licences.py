"""Licence notices of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import licences
from skein.plans.registry import query
from skein.sources.tables import table


@query()
def txt4_licence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice with its span; equal to the alignment of whole texts in tests."""
    return licences.find(table(spark, sf_dir, "documents"))


#: The notices of the tables as one expression each, where SQL can state them.
STATED = {
    "Apache-2.0": r"licensed\W+under\W+the\W+apache\W+license\W+version\W+2\W+0",
    "MIT": r"released\W+under\W+the\W+mit\W+license",
    "GPL-3.0": r"licensed\W+under\W+the\W+gnu\W+general\W+public\W+license\W+version\W+3",
    "CC-BY-NC-4.0": r"licensed\W+under\W+cc\W+by\W+nc\W+4\W+0",
}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS licence, CAST(len(regexp_extract_all(lower(text), '\\b{v}\\b')) AS BIGINT) AS n FROM documents WHERE regexp_matches(lower(text), '\\b{v}\\b')" for k, v in STATED.items()))
def txt4_short_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short notices of each document, which are allowed no edits."""
    found = licences.find(table(spark, sf_dir, "documents"), notices={k: licences.NOTICES[k] for k in STATED})
    return found.groupBy("doc_id", "licence").agg(F.count("*").alias("n"))
