"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import attribution, decontaminate, languages, near_dup, oracles, packing, private, quality, quality_rules, secrets, spelling, token_store, topk, vector_codes
from skein.llm.common import table
from skein.llm.encoding import vocabulary


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"), threshold=0.8)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.find(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(table(spark, sf_dir, "documents"))


def op5_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.by_line(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_files(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64.0, every=20)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096.0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"), least=7, occurrences=2, times=10, every=31)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_personal_data": op2_personal_data,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_language_id": op4_language_id,
    "op5_token_attribution": op5_token_attribution,
    "op6_token_files": op6_token_files,
    "op7_benchmark_leaks": op7_benchmark_leaks,
    "op8_secret_scan": op8_secret_scan,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_quality": op10_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_quality_rules": op13_quality_rules,
}
ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": oracles.NEAR_DUPLICATES,
    "op2_personal_data": oracles.PERSONAL_DATA,
    "op7_benchmark_leaks": oracles.BENCHMARK_LEAKS,
    "op8_secret_scan": oracles.secrets([(r.kind, r.full) for r in secrets.RULES], secrets.BASE),
    "op9_exact_top_k": """
        WITH code AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), part AS (
            SELECT vec_id, generate_subscripts(c, 1) AS i, unnest(c) AS v, len(c) AS n FROM code
        ), score AS (
            SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(sum(q.v * p.v) AS BIGINT) AS score
            FROM part q JOIN part p ON q.i = p.i AND q.n = p.n AND q.vec_id <> p.vec_id
            WHERE q.vec_id % 20 = 0 GROUP BY ALL
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM score
        ) SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op11_vector_codes": oracles.vector_codes(parts=8, entries=16, rounds=6, scale=4096),
    "op12_spelling_variants": oracles.SPELLING,
    "op13_quality_rules": oracles.QUALITY_RULES,
}
