"""Configurations as rows, held against the ranges and orders that their parameters must keep."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INF = float("inf")
#: Kind, parameter, least and largest value, and whether each bound itself is allowed.
RANGES = [
    ("budget", "max_candidates", 1.0, 10.0, True, True), ("budget", "minimum_search_fraction", 0.0, 1.0, False, True), ("budget", "reliable_fraction", 0.0, 1.0, False, True), ("budget", "reliable_agreement", 0.0, 1.0, False, True),
    ("budget", "detection_fraction_threshold", 0.0, 1.0, False, True), ("budget", "identity_minimum_margin", 0.0, INF, True, False), ("budget", "stop_minimum_margin", 0.0, INF, True, False), ("budget", "minimum_score_improvement", 0.0, INF, True, False),
    ("adaptive", "minimum_strength", 0.0, INF, False, False), ("adaptive", "psnr_tolerance_db", 0.0, INF, False, False), ("adaptive", "quality_refinement_steps", 0.0, INF, True, False), ("adaptive", "robustness_steps", 2.0, INF, True, False),
    ("geometry", "fusion_top_k", 1.0, INF, True, False), ("geometry", "score_temperature", 0.0, INF, False, False), ("geometry", "minimum_score_improvement", 0.0, INF, True, False), ("geometry", "minimum_border_evidence", 0.0, INF, True, False),
    ("geometry", "rotation_correction", -45.0, 45.0, True, True), ("geometry", "perspective_correction", 0.0, 0.25, False, False),
    ("messages", "detection_threshold", 0.0, 1.0, False, False), ("messages", "bit_probability_temperature", 0.0, INF, False, False), ("messages", "maximum_messages", 1.0, INF, True, False), ("messages", "seed_hamming_radius", 0.0, 32.0, True, True),
    ("messages", "minimum_message_hamming_separation", 1.0, 32.0, True, True), ("messages", "minimum_cluster_pixels", 1.0, INF, True, False), ("messages", "minimum_cluster_fraction", 0.0, 1.0, True, True), ("messages", "maximum_soft_hamming", 0.0, 1.0, False, False),
    ("messages", "assignment_temperature", 0.0, INF, False, False), ("messages", "refinement_iterations", 1.0, INF, True, False), ("messages", "seed_prior_strength", 0.0, INF, True, False), ("messages", "localization_threshold", 0.0, 1.0, False, False),
]
#: Kind, the smaller and the larger parameter, and whether they may be equal.
ORDERS = [("budget", "minimum_search_fraction", "reliable_fraction", True), ("adaptive", "minimum_psnr_db", "target_psnr_db", False), ("adaptive", "minimum_strength", "maximum_strength", False), ("messages", "maximum_messages", "candidate_limit", True)]

#: Parameters that are counts.
WHOLE = ["max_candidates", "quality_refinement_steps", "robustness_steps", "fusion_top_k", "maximum_messages", "seed_hamming_radius", "minimum_message_hamming_separation", "minimum_cluster_pixels", "refinement_iterations", "candidate_limit"]


def require(kind: str, settings: Mapping[str, float]) -> None:
    """An error that names every value of one configuration outside its range, and every broken order."""
    rules = []
    for of, name, low, high, low_in, high_in in RANGES:
        if of == kind and name in settings:
            value = settings[name]
            above, below = value > low or (low_in and value == low), value < high or (high_in and value == high)
            if not (above and below) or (name in WHOLE and value != int(value)):
                rules.append(f"{name} is out of range")
    rules += [f"{a} is not below {b}" for of, a, b, equal in ORDERS if of == kind and a in settings and b in settings and not (settings[a] < settings[b] or (equal and settings[a] == settings[b]))]
    if rules:
        raise ValueError("; ".join(rules))


def violations(settings: DataFrame) -> DataFrame:
    """settings(config, kind, name, value) -> config, kind, rule for each value outside its range and each broken order.

    A parameter may have several values, each judged by itself. A null or a number that isn't one breaks its range.
    """
    spark = settings.sparkSession
    ranges = F.broadcast(spark.createDataFrame(RANGES, "kind string, name string, low double, high double, low_in boolean, high_in boolean"))  # a row for each parameter
    orders = F.broadcast(spark.createDataFrame(ORDERS, "kind string, smaller string, larger string, equal boolean"))
    v = F.col("value")
    inside = ((v > F.col("low")) | (F.col("low_in") & (v == F.col("low")))) & ((v < F.col("high")) | (F.col("high_in") & (v == F.col("high")))) & ~F.isnan(v)
    out = settings.join(ranges, ["kind", "name"]).where(~F.coalesce(inside, F.lit(False))).select("config", "kind", F.concat("name", F.lit(" is out of range")).alias("rule"))
    of = lambda name, alias: settings.where(F.col("name").isin([o[name] for o in ORDERS])).select("config", "kind", F.col("name").alias("smaller" if name == 1 else "larger"), F.col("value").alias(alias))
    pairs = of(1, "a").join(orders, ["kind", "smaller"]).join(of(2, "b"), ["config", "kind", "larger"])
    kept = (F.col("a") < F.col("b")) | (F.col("equal") & (F.col("a") == F.col("b")))
    return out.unionByName(pairs.where(~F.coalesce(kept, F.lit(False))).select("config", "kind", F.concat("smaller", F.lit(" is not below "), "larger").alias("rule")))
