"""Detection thresholds, ranking quality and interval estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running

Z95 = 1.959963984540054


def wilson(hits: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound of a proportion; null for no trial."""
    n, p = total.cast("double"), F.try_divide(hits.cast("double"), total.cast("double"))
    scale = 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / scale, F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / scale
    some = total > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))


def score_counts(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, score, n0, n1: negatives and positives at each distinct score. Everything below works on this."""
    return scores.groupBy(*keys, F.col("detection_score").alias("score")).agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))


def tie_safe_threshold(scores: DataFrame, keys: Sequence[str], target: float) -> DataFrame:
    """The smallest score at which at most target of the negatives are accepted (score >= threshold).

    If even the highest negative is too many, threshold is that score and strict says to go beyond it. Distinct scores
    are summed up in ranges, so a group of any size is split over tasks.
    """
    at = score_counts(scores.where("label = 0"), keys)
    total = at.groupBy(*keys).agg(F.sum("n0").alias("total"))
    rated = running(at, keys, -F.col("score"), {"above": "n0"}).join(total, list(keys)).withColumn("accepted", F.col("above") + F.col("n0"))
    fits = F.col("accepted") / F.col("total") <= target
    return rated.groupBy(*keys).agg(F.coalesce(F.min(F.when(fits, F.col("score"))), F.max("score")).alias("threshold"), (F.count_if(fits) == 0).alias("strict"), F.max("total").alias("negatives"))


def auc(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC-AUC with half credit for ties: per distinct score, positives times the negatives below it.

    Twice the wins are whole numbers, so their sum is exact; distinct scores are summed up in ranges.
    """
    wins = running(score_counts(scores, keys), keys, F.col("score"), {"under": "n0"})
    twice = F.col("n1").cast("decimal(20,0)") * (2 * F.col("under") + F.col("n0")).cast("decimal(18,0)")
    return wins.groupBy(*keys).agg(
        F.sum("n1").alias("positives"), F.sum("n0").alias("negatives"),
        F.try_divide(F.sum(twice).cast("double"), 2 * F.sum("n1").cast("double") * F.sum("n0")).alias("auc"),
    )
