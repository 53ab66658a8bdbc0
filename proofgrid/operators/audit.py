"""Checks of completeness, leakage and provenance as tables of results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectation:
    """A row-wise rule; a row for which it is not true (false or null) is a violation."""

    name: str
    rule: Column


def expect(facts: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """check, violations and passed for every rule, all in one pass over facts."""
    broken = [F.sum(F.when(F.coalesce(e.rule, F.lit(False)), 0).otherwise(1)).alias(f"v{k}") for k, e in enumerate(expectations)]
    one = facts.agg(*broken)
    pairs = F.explode(F.array(*[F.struct(F.lit(e.name).alias("check"), F.coalesce(F.col(f"v{k}"), F.lit(0)).cast("long").alias("violations")) for k, e in enumerate(expectations)]))
    return one.select(pairs.alias("r")).select("r.check", "r.violations", (F.col("r.violations") == 0).alias("passed"))


def duplicates(facts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return facts.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def missing(expected: DataFrame, observed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected keys without a row."""
    return expected.select(*key).distinct().join(observed.select(*key).distinct(), list(key), "left_anti")


def same_keys(expected: DataFrame, observed: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows, expected, missing, unexpected and duplicated keys, and whether the sets are equal."""
    both = expected.select(*key, F.lit(1).alias("_e"), F.lit(0).alias("_o")).unionByName(observed.select(*key, F.lit(0).alias("_e"), F.lit(1).alias("_o")))
    cell = both.groupBy(*key).agg(F.sum("_e").alias("_e"), F.sum("_o").alias("_o"))
    count = lambda c: F.count_if(c)
    return cell.agg(
        F.coalesce(F.sum("_o"), F.lit(0)).alias("observed_rows"), count(F.col("_e") > 0).alias("expected_keys"), count((F.col("_e") > 0) & (F.col("_o") == 0)).alias("missing_keys"),
        count((F.col("_e") == 0) & (F.col("_o") > 0)).alias("unexpected_keys"), count(F.col("_o") > 1).alias("duplicated_keys"),
    ).withColumn("complete", (F.col("missing_keys") == 0) & (F.col("unexpected_keys") == 0) & (F.col("duplicated_keys") == 0))


def leaks(manifest: DataFrame) -> DataFrame:
    """Hashes that occur in more than one split of a dataset, with their splits and files."""
    return manifest.groupBy("dataset", "sha256").agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("files")).where("splits > 1")


def differing(expected: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """key, expected and found value wherever two settings (such as versions of an environment) differ or one is absent."""
    a, b = expected.select(F.col(key), F.col(value).alias("expected")), found.select(F.col(key), F.col(value).alias("found"))
    return a.join(b, key, "full_outer").where(~F.col("expected").eqNullSafe(F.col("found")))


def agree(left: DataFrame, right: DataFrame, key: Sequence[str], values: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Key, value name and both numbers wherever two tables differ by more than a tolerance or lack a row."""
    a = left.select(*key, *[F.col(v).cast("double").alias(f"l_{v}") for v in values], F.lit(True).alias("_l"))
    b = right.select(*key, *[F.col(v).cast("double").alias(f"r_{v}") for v in values], F.lit(True).alias("_r"))
    pair = F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"l_{v}").alias("left"), F.col(f"r_{v}").alias("right")) for v in values]))
    joined = a.join(b, list(key), "full_outer")
    return joined.select(*key, pair.alias("p"), (F.col("_l") & F.col("_r")).alias("_both")).select(*key, "p.*", "_both").where(~F.coalesce(F.col("_both"), F.lit(False)) | ~F.coalesce((F.abs(F.col("left") - F.col("right")) <= tolerance) | (F.col("left").isNull() & F.col("right").isNull()), F.lit(False))).drop("_both")
