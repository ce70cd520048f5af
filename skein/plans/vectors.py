"""Nearest neighbours by cosine: the rows whose vec_id 50 divides, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import neighbours
from skein.plans.registry import query
from skein.sources.tables import table

EXACT = """
    WITH part AS (
        SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings
    ), length AS (
        SELECT vec_id, sqrt(sum(x * x)) AS l FROM part GROUP BY vec_id
    ), score AS (
        SELECT q.vec_id AS query_id, p.vec_id AS vec_id, round(sum(q.x * p.x) / (any_value(a.l) * any_value(b.l)), 9) AS score
        FROM part q JOIN part p ON q.i = p.i AND q.vec_id <> p.vec_id JOIN length a ON a.vec_id = q.vec_id JOIN length b ON b.vec_id = p.vec_id
        WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, p.vec_id
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM score
    ) """


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = neighbours.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return base, base.where(F.col("id") % 50 == 0)


def _named(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(EXACT + "SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10")
def vec1_cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(neighbours.exact(*_sides(spark, sf_dir), k=10))


@query()
def vec2_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(neighbours.approximate(*_sides(spark, sf_dir), k=10))


@query(EXACT + "SELECT count(*) AS neighbours, true AS nine_of_ten_found FROM ranked WHERE rank <= 10")
def vec2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the approximate search finds nine tenths of the exact neighbours."""
    base, queries = _sides(spark, sf_dir)
    counted = neighbours.recall(neighbours.approximate(base, queries, k=10), neighbours.exact(base, queries, k=10))
    return counted.select(F.col("n").alias("neighbours"), (10 * F.col("hits") >= 9 * F.col("n")).alias("nine_of_ten_found"))
