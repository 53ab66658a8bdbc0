"""Bisection of a parameter on an aggregate of a table, and upserts of what it gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bisect_rates(limits: DataFrame, group: Sequence[str], limit: str, low: float, high: float, target: float, steps: int) -> DataFrame:
    """group, step, strength, rate, selected, bracketed: both bounds (steps 0 and 1) and each midpoint.

    A row passes at a strength up to its limit, so the share that passes falls with the strength. A bisection of so
    many steps only looks at places of a grid of 2**steps parts; one count by part tells every group's shares at all
    of them, and each group is bisected inside its row. selected is the step nearest to the target, the first of equal
    ones; bracketed says whether the bounds enclose it. A null limit never passes.
    """
    parts, unit = 1 << steps, (high - low) / (1 << steps)
    at = lambda k: F.lit(low) + k * unit
    near = F.greatest(F.lit(-1), F.least(F.lit(parts), F.floor((F.col(limit) - low) / unit)))
    # The division can be off by a rounding at a place of the grid; what counts is the comparison with the place itself.
    part = F.when(F.col(limit) < at(near), near - 1).when(F.col(limit) >= at(near + 1), near + 1).otherwise(near)
    part = F.coalesce(F.greatest(F.lit(-1), F.least(F.lit(parts), part)), F.lit(-1))
    counted = limits.groupBy(*group, part.cast("int").alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    row = counted.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_part", "_n"))).alias("_counts"), F.sum("_n").alias("_total"))  # parts + 2 entries at most
    tail = F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda k: F.aggregate(F.map_entries(F.map_filter("_counts", lambda p, n: p >= k)), F.lit(0).cast("long"), lambda s, e: s + e["value"]) / F.col("_total"))
    rated = row.select(*group, tail.alias("_rates"))
    found = F.expr(
        f"aggregate(sequence(2, {steps + 1}), named_struct('low', 0, 'high', {parts}, 'seen', array(named_struct('step', 0, 'k', 0), named_struct('step', 1, 'k', {parts}))), "
        f"(s, i) -> transform(array(int((s.low + s.high) / 2)), m -> named_struct('low', IF(_rates[m] > {target}D, m, s.low), 'high', IF(_rates[m] > {target}D, s.high, m), 'seen', concat(s.seen, array(named_struct('step', i, 'k', m)))))[0], s -> s.seen)"
    )
    best = F.array_min(F.transform("_seen", lambda x: F.struct(F.abs(F.get("_rates", x["k"]) - target).alias("off"), x["step"].alias("step")))).getField("step")
    enclosed = (F.col("_rates")[0] >= target) & (F.element_at("_rates", -1) <= target)
    told = rated.withColumn("_seen", found).select(*group, "_rates", best.alias("_best"), enclosed.alias("bracketed"), F.explode("_seen").alias("x"))
    return told.select(*group, "x.step", at(F.col("x.k")).alias("strength"), F.get("_rates", F.col("x.k")).alias("rate"), (F.col("x.step") == F.col("_best")).alias("selected"), "bracketed")


def upsert(earlier: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """earlier with the rows of fresh in place of those of the same key, and whether a row is new, kept or replaced."""
    values = [c for c in earlier.columns if c not in key]
    a, b = earlier.withColumn("_a", F.lit(True)), fresh.withColumn("_b", F.lit(True))
    both = a.alias("a").join(b.alias("b"), list(key), "full_outer")
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "kept").otherwise("replaced")
    return both.select(*key, *[F.when(F.col("_b"), F.col(f"b.{v}")).otherwise(F.col(f"a.{v}")).alias(v) for v in values], state.alias("state"))
