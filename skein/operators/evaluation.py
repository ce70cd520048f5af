"""Evaluation of a score against labels from counts of its values.

Rows are counted by score first, positives and negatives apart. Only the counts are
summed up along the scores: inside blocks of scores, and over the blocks, of which there
are BLOCKS at most. So a score that a third of all rows share is one count, and no task
sorts all rows or all scores.

Defined results: rows with a null score, a NaN or a null label are left out; a label is
positive if it is 1; equal scores are one threshold, so that ties count as half in the
area under the curve; measures that lack positives or negatives are null; an empty
table gives no points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 1024


def counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, positives, negatives) of each distinct score."""
    s = F.col(score).cast("double")
    rows = df.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull()).select((s + 0.0).alias("score"), (F.col(label) == 1).cast("long").alias("y"))
    return rows.groupBy("score").agg(F.sum("y").alias("positives"), F.sum(1 - F.col("y")).alias("negatives"))


def curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """A point for each distinct score, taken as the least score that is predicted
    positive: threshold, positives and negatives at it, true_positives and false_positives
    from it on, all_positives, all_negatives."""
    n = counts(df, score, label)
    # Blocks are ranges of scores with about as many distinct scores each.
    edges = n.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    width = (F.col("high") - F.col("low")) / BLOCKS
    place = F.when(width > 0, F.least(F.floor((F.col("score") - F.col("low")) / width), F.lit(BLOCKS - 1))).otherwise(F.lit(0))
    placed = n.join(F.broadcast(edges)).select("score", "positives", "negatives", place.alias("block"))  # edges is one row
    blocks = placed.groupBy("block").agg(F.sum("positives").alias("p"), F.sum("negatives").alias("q"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    higher = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    blocks = blocks.select(F.col("block").alias("of"), higher("p").alias("p0"), higher("q").alias("q0"), F.sum("p").over(everything).alias("all_positives"), F.sum("q").over(everything).alias("all_negatives"))
    inside = Window.partitionBy("block").orderBy(F.desc("score"))
    summed = placed.withColumns({"p1": F.sum("positives").over(inside), "q1": F.sum("negatives").over(inside)})
    joined = summed.join(F.broadcast(blocks), F.col("block") == F.col("of"))  # at most BLOCKS rows
    return joined.select(F.col("score").alias("threshold"), "positives", "negatives", (F.col("p0") + F.col("p1")).alias("true_positives"), (F.col("q0") + F.col("q1")).alias("false_positives"), "all_positives", "all_negatives")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def rates(points: DataFrame) -> DataFrame:
    """threshold, true_positive_rate (recall), false_positive_rate, precision, f1."""
    tp, fp = F.col("true_positives"), F.col("false_positives")
    return points.select(
        "threshold",
        ratio(tp, F.col("all_positives")).alias("true_positive_rate"),
        ratio(fp, F.col("all_negatives")).alias("false_positive_rate"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(2 * tp, tp + fp + F.col("all_positives")).alias("f1"),
    )


def summary(points: DataFrame) -> DataFrame:
    """One row: rows, positives, auc (ties count as half), average_precision, and
    best_f1 with the highest threshold that reaches it."""
    p, n = F.col("positives"), F.col("negatives")
    tp, fp = F.col("true_positives"), F.col("false_positives")
    f1 = ratio(2 * tp, tp + fp + F.col("all_positives"))
    totals = points.agg(
        F.coalesce(F.sum(p + n), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(p), F.lit(0)).alias("positives"),
        # A negative is beaten by all positives above it and by half of its equals.
        F.sum((n * (2 * (tp - p) + p)).cast("decimal(38,0)")).cast("double").alias("twice"),
        F.sum(p * tp / (tp + fp)).alias("precisions"),
        F.max(F.struct(f1, "threshold")).alias("best"),
    )
    negatives = F.col("rows") - F.col("positives")
    return totals.select(
        "rows", "positives",
        F.when(F.col("positives") * negatives > 0, F.col("twice") / (2.0 * F.col("positives") * negatives)).alias("auc"),
        ratio(F.col("precisions"), F.col("positives")).alias("average_precision"),
        F.col("best.col1").alias("best_f1"), F.col("best.threshold").alias("best_threshold"),
    )


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, rows, mean_score, share) of scores from 0 to 1 in bins of one width; 1 and
    what lies beyond belongs to the last bin."""
    bin_ = F.greatest(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    n = F.col("positives") + F.col("negatives")
    grouped = counts(df, score, label).groupBy(bin_.alias("bin")).agg(F.sum(n).alias("rows"), F.sum(F.col("score") * n).alias("s"), F.sum("positives").alias("p"))
    return grouped.select("bin", "rows", (F.col("s") / F.col("rows")).alias("mean_score"), (F.col("p") / F.col("rows")).alias("share"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """One row: the mean distance of share and mean score, by rows, and the largest."""
    far = F.abs(F.col("share") - F.col("mean_score"))
    return bins.agg((F.sum(far * F.col("rows")) / F.sum("rows")).alias("expected_error"), F.max(far).alias("largest_error"))
