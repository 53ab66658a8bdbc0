"""Evidence documents: JSON with nested parts, read into types and held against the rules that its numbers must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The document of one suite: methods with their records, pairs with how they changed.
SCHEMA = (
    "suite_id string, version int, images long, attack_cases long, methods array<struct<method:string,records:long,recovered:long,recovery:double>>, "
    "paired array<struct<baseline:string,candidate:string,pairs:long,rescued:long,regressed:long,both:long,neither:long,gain_pp:double>>"
)


def documents(suites: DataFrame) -> DataFrame:
    """suites with SCHEMA's columns -> suite_id, document as JSON text."""
    return suites.select("suite_id", F.to_json(F.struct(*[f.split()[0] for f in SCHEMA.split(", ")])).alias("document"))


def _rules() -> dict[str, Column]:
    d, every = F.col("d"), lambda items, rule: F.forall(items, rule)
    whole = d["images"] * d["attack_cases"]
    return {
        "suite_id or version is missing": d["suite_id"].isNotNull() & (d["version"] >= 1),
        "no methods": F.size(d["methods"]) > 0,
        "methods occur twice": F.size(F.array_distinct(F.col("d.methods.method"))) == F.size(d["methods"]),
        "a method lacks records": every(d["methods"], lambda m: m["records"] == whole),
        "a recovery is not its share": every(d["methods"], lambda m: F.abs(m["recovery"] * m["records"] - m["recovered"]) < 1e-6),
        "a pair names no method": every(d["paired"], lambda p: F.array_contains(F.col("d.methods.method"), p["baseline"]) & F.array_contains(F.col("d.methods.method"), p["candidate"])),
        "changes don't add up": every(d["paired"], lambda p: p["rescued"] + p["regressed"] + p["both"] + p["neither"] == p["pairs"]),
        "a gain is not its changes": every(d["paired"], lambda p: F.abs(p["gain_pp"] * p["pairs"] - 100 * (p["rescued"] - p["regressed"])) < 1e-6),
    }


def load(stored: DataFrame) -> DataFrame:
    """stored(suite_id, document) -> suite_id, d (typed, null if malformed), status (ready, malformed, invalid), broken rules.

    A rule that a missing field leaves open is broken.
    """
    typed = stored.select("suite_id", F.from_json("document", SCHEMA + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("d"))
    malformed = F.col("d").isNull() | F.col("d._broken").isNotNull()
    broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in _rules().items()]), lambda x: x.isNotNull())
    held = typed.withColumn("broken", F.when(malformed, F.array().cast("array<string>")).otherwise(broken))
    status = F.when(malformed, "malformed").when(F.size("broken") > 0, "invalid").otherwise("ready")
    return held.select("suite_id", F.when(~malformed, F.col("d").dropFields("_broken")).alias("d"), status.alias("status"), "broken")
