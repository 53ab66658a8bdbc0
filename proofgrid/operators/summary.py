"""Grouped summaries of fact tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(column: str | Column) -> Column:
    """NaN as null, so that averages skip it."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def moments(metrics: Sequence[str], sample: bool = True) -> list[Column]:
    """Mean and standard deviation of each metric, nulls skipped; the deviation of one row is null for a sample."""
    std = F.stddev_samp if sample else F.stddev_pop
    return [c for m in metrics for c in (F.avg(finite(m)).alias(f"{m}_mean"), std(finite(m)).alias(f"{m}_std"))]


def summarize(facts: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """records, then mean and sample deviation of metrics, for each group; null keys are a group."""
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), *moments(metrics))


def summarize_sets(facts: DataFrame, sets: Sequence[Sequence[str]], metrics: Sequence[str]) -> DataFrame:
    """One pass for several groupings; a column outside a row's grouping is the word all."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    grouped = facts.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(*[F.grouping(k).alias(f"_{k}") for k in keys], F.count(F.lit(1)).alias("records"), *moments(metrics))
    named = [F.when(F.col(f"_{k}") == 1, F.lit("all")).otherwise(F.col(k).cast("string")).alias(k) for k in keys]
    return grouped.select(*named, *[c for c in grouped.columns if c not in keys and c not in {f"_{k}" for k in keys}])


def last_of(facts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, in the given order."""
    return first_of(facts, keys, [F.desc(c) for c in order])


def first_of(facts: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return facts.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def unit_means(facts: DataFrame, unit: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row for each cluster unit: means over all that was done to it."""
    return facts.groupBy(*unit).agg(*[F.avg(finite(m)).alias(m) for m in metrics])


def share(condition: Column) -> Column:
    """Share of rows for which a condition holds; a null condition doesn't count."""
    return F.avg(condition.cast("double"))
