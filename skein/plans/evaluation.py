"""A score of built-in expressions over documents, evaluated against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import evaluation
from skein.plans.registry import query
from skein.sources.tables import table

SCORED = r"""
    WITH scored AS (
        SELECT quality, round(least(1, len(list_distinct(w)) / greatest(len(w), 1)) * (1 - least(1, 8 * length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) / greatest(length(text), 1))), 3) AS score
        FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}]+') AS w FROM documents) JOIN labels USING (doc_id)
    ), n AS (
        SELECT score, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality <> 1) AS q FROM scored GROUP BY score
    ), point AS (
        SELECT score, p, q, sum(p) OVER (ORDER BY score DESC) AS tp, sum(q) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS ap, sum(q) OVER () AS aq FROM n
    ) """


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(quality, score): the share of different words, less for many symbols."""
    text = F.col("text")
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))
    documents = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"), F.char_length(text).alias("n"), F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("symbols"))
    different = F.least(F.lit(1.0), F.size(F.array_distinct("w")) / F.greatest(F.size("w"), F.lit(1)))
    clean = 1 - F.least(F.lit(1.0), 8 * F.col("symbols") / F.greatest("n", F.lit(1)))
    return documents.join(table(spark, sf_dir, "labels"), "doc_id").select("quality", F.round(different * clean, 3).alias("score"))


@query(SCORED + "SELECT score AS threshold, round(tp / ap, 9) AS true_positive_rate, round(fp / aq, 9) AS false_positive_rate, round(tp / (tp + fp), 9) AS precision, round(2 * tp / (tp + fp + ap), 9) AS f1 FROM point")
def txt6_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = evaluation.rates(evaluation.curve(scored(spark, sf_dir), "score", "quality"))
    return points.select("threshold", *[F.round(c, 9).alias(c) for c in points.columns[1:]])


@query(SCORED + """
    SELECT CAST(sum(p + q) AS BIGINT) AS rows, CAST(sum(p) AS BIGINT) AS positives, round(sum(q * (tp - p + p / 2)) / (any_value(ap) * any_value(aq)), 9) AS auc,
        round(sum(p * tp / (tp + fp)) / any_value(ap), 9) AS average_precision, round(max(2 * tp / (tp + fp + ap)), 9) AS best_f1,
        arg_max(score, {'f': 2 * tp / (tp + fp + ap), 's': score}) AS best_threshold FROM point""")
def txt6_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = evaluation.summary(evaluation.curve(scored(spark, sf_dir), "score", "quality"))
    return row.select("rows", "positives", *[F.round(c, 9).alias(c) for c in ("auc", "average_precision", "best_f1")], "best_threshold")


@query(SCORED + """
    SELECT CAST(greatest(least(floor(score * 10), 9), 0) AS INTEGER) AS bin, CAST(sum(p + q) AS BIGINT) AS rows, round(sum(score * (p + q)) / sum(p + q), 9) AS mean_score,
        round(sum(p) / sum(p + q), 9) AS share FROM n GROUP BY bin""")
def txt6_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = evaluation.calibration(scored(spark, sf_dir), "score", "quality")
    return bins.select("bin", "rows", F.round("mean_score", 9).alias("mean_score"), F.round("share", 9).alias("share"))
