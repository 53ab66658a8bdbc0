"""Attack protocols and decoder traces as tables."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ProtocolError(ValueError):
    pass


def protocol_table(spark: SparkSession, protocol: Mapping, known: Collection[str]) -> DataFrame:
    """case_id, category, steps and position of a protocol {id, version, attacks: [{id, category, pipeline: [{name}]}]}.

    It needs an id, a version of 1 or more, unique case ids, and known steps in every case.
    """
    if not isinstance(protocol, Mapping) or not protocol.get("id"):
        raise ProtocolError("a protocol is a mapping with an id")
    if not isinstance(protocol.get("version"), int) or protocol["version"] < 1:
        raise ProtocolError("version must be 1 or more")
    rows, seen = [], set()
    for position, case in enumerate(protocol.get("attacks") or ()):
        steps = [s.get("name") for s in case.get("pipeline") or ()]
        if case.get("id") in seen or not case.get("id"):
            raise ProtocolError(f"case {position} has no id of its own")
        if not steps or set(steps) - set(known):
            raise ProtocolError(f"case {case['id']} has no steps or unknown ones: {steps}")
        seen.add(case["id"])
        rows.append((case["id"], case.get("category", "single"), steps, position))
    if not rows:
        raise ProtocolError("no cases")
    return spark.createDataFrame(rows, "case_id string, category string, steps array<string>, position int")


def select(protocol: DataFrame, categories: Collection[str] | None = None) -> DataFrame:
    """The cases of some categories; of all where none is named. A category without a case is an error."""
    if categories is None:
        return protocol
    lacking = set(categories) - {r.category for r in protocol.select("category").distinct().collect()}  # categories are few
    if lacking:
        raise ProtocolError(f"no case of {sorted(lacking)}")
    return protocol.where(F.col("category").isin(*categories))


TRACES = "status string, fingerprint string, image_id string, records array<struct<positive:boolean,attack:string,candidates:array<struct<name:string,score:double,selected_fraction:double>>>>"


def read_traces(spark: SparkSession, path: str, images: int, cells: DataFrame, candidates: int = 10) -> DataFrame:
    """One row for each image and cell of JSON trace files, after the checks that make them comparable.

    cells(positive, attack) are the cells that each image must hold, each once.
    """
    from ..operators.audit import same_keys

    runs = spark.read.schema(TRACES).option("multiLine", True).json(path)
    found = runs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("images"), F.count_distinct("fingerprint").alias("prints"), F.count_if(~(F.col("status") == "complete") | F.col("status").isNull()).alias("open")).first()
    if found.n != images or found.images != images or found.prints != 1 or found.open:
        raise ProtocolError(f"traces are not one complete run of {images} images: {found.asDict()}")
    rows = runs.select("image_id", F.explode("records").alias("r")).select("image_id", "r.*")
    expected = runs.select("image_id").crossJoin(F.broadcast(cells.select("positive", "attack")))  # a protocol's cells are few
    if not same_keys(expected, rows, ["image_id", "positive", "attack"]).first().complete:
        raise ProtocolError("images do not hold the expected cells")
    if not rows.where((F.size("candidates") != candidates) | F.col("candidates").isNull()).isEmpty():
        raise ProtocolError(f"a record has not {candidates} candidates")
    return rows
