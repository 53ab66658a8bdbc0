"""Paired comparisons: the same cell under two models or methods, side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(facts: DataFrame, by: str, reference: str, other: str, key: Sequence[str], metrics: Sequence[str], complete: bool = True) -> DataFrame:
    """key, and for each metric reference_m, other_m: one row a cell, made by one grouping instead of a self join.

    The rows of a cell meet in one shuffle of facts. With complete, a cell that lacks a side or holds it twice fails
    the job; otherwise such cells are left out.
    """
    side = lambda value: [F.max(F.when(F.col(by) == value, F.col(m))).alias(f"{'reference' if value == reference else 'other'}_{m}") for m in metrics]
    count = lambda value: F.count_if(F.col(by) == value)
    cells = facts.where(F.col(by).isin(reference, other)).groupBy(*key).agg(count(reference).alias("_r"), count(other).alias("_o"), *side(reference), *side(other))
    ok = (F.col("_r") == 1) & (F.col("_o") == 1)
    if complete:
        broken = F.raise_error(F.concat_ws(" ", F.lit("incomplete pair"), *[F.col(k).cast("string") for k in key]))
        return cells.where(F.when(ok, F.lit(True)).otherwise(broken.cast("boolean"))).drop("_r", "_o")
    return cells.where(ok).drop("_r", "_o")


def covering(facts: DataFrame, by: str, baseline: str, other: str, key: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """The pairs of a method with a baseline whose cells it must all have, each once; a cell that it lacks fails the job.
    Cells of the method beyond the baseline are left out."""
    side = lambda value: [F.max(F.when(F.col(by) == value, F.col(m))).alias(f"{'reference' if value == baseline else 'other'}_{m}") for m in metrics]
    cells = facts.where(F.col(by).isin(baseline, other)).groupBy(*key).agg(F.count_if(F.col(by) == baseline).alias("_r"), F.count_if(F.col(by) == other).alias("_o"), *side(baseline), *side(other)).where("_r > 0")
    broken = F.raise_error(F.concat_ws(" ", F.lit("uncovered or repeated cell"), *[F.col(k).cast("string") for k in key]))
    return cells.where(F.when((F.col("_r") == 1) & (F.col("_o") == 1), F.lit(True)).otherwise(broken.cast("boolean"))).drop("_r", "_o")


def transitions(recovered_reference: str = "reference_complete_recovery", recovered_other: str = "other_complete_recovery") -> list[Column]:
    """Counts of rescued, regressed, both and neither recovered."""
    r, o = F.col(recovered_reference) == 1, F.col(recovered_other) == 1
    return [F.count_if(~r & o).alias("rescued"), F.count_if(r & ~o).alias("regressed"), F.count_if(r & o).alias("both_recovered"), F.count_if(~r & ~o).alias("both_failed")]


def gains(metrics: Sequence[str], scale: float = 1.0) -> list[Column]:
    """Mean of other minus reference for each metric."""
    return [F.avg((F.col(f"other_{m}") - F.col(f"reference_{m}")) * scale).alias(f"{m}_gain") for m in metrics]


def wide(facts: DataFrame, key: Sequence[str], by: str, values: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row for each key with a column value_metric for each listed value: a pivot without a scan for the values."""
    return facts.groupBy(*key).agg(*[F.avg(F.when(F.col(by) == v, F.col(m))).alias(f"{v}_{m}") for v in values for m in metrics])
