"""Table functions for SQL: scopes of evidence, sets of messages and outcomes of pairs, over any table that is given.

    register(spark)
    SELECT scope, attack, avg(bit_accuracy) FROM evidence_scopes(TABLE(records), 'dataset,attack') GROUP BY ALL
    SELECT * FROM message_sets(TABLE(images), '2026', 'image_id', 3)
    SELECT outcome, count(*) FROM pair_outcomes(TABLE(records), 'dataset,image_id,attack', 'model', 'complete_recovery', 'base', 'repeat2') GROUP BY ALL

Each names its result's columns from the table that it gets; pair_outcomes asks Spark for the partitions that it needs,
so a pair meets in a task and no more than a pair is held. The DataFrame operators give the same rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def _names(text: AnalyzeArgument, table: AnalyzeArgument) -> list[str]:
    """A constant list of the table's columns."""
    if not table.isTable:
        raise ValueError("the first argument must be a table, as TABLE(...)")
    names = [x.strip() for x in (text.value or "").split(",") if x.strip()]
    missing = [x for x in names if x not in table.dataType.names]
    if not names or missing:
        raise ValueError(f"not columns of the table: {', '.join(missing) or 'none given'}")
    return names


class EvidenceScopes:
    """Every row once for each subset of the given columns, of which the others are null: rows of a cube before its sums.

    Columns: scope (the columns that are kept, joined by +, or overall), and all of the table's.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        names = _names(columns, rows)
        fields = [StructField(f.name, f.dataType, True if f.name in names else f.nullable) for f in rows.dataType.fields]
        return AnalyzeResult(StructType([StructField("scope", StringType(), False), *fields]))

    def eval(self, rows: Row, columns: str) -> Iterator[tuple]:
        names, values = [x.strip() for x in columns.split(",") if x.strip()], rows.asDict()
        for n in range(len(names) + 1):
            for kept in itertools.combinations(names, n):
                yield ("+".join(kept) or "overall", *(None if k in names and k not in kept else v for k, v in values.items()))


class MessageSets:
    """For each row count messages of 32 bits, drawn by hashes of a seed and the row's key, each least bits from those before.

    Columns: the table's, place (from 0), message, attempt (from 1).
    """

    ATTEMPTS, WIDTH = 10_000, 32

    @staticmethod
    def analyze(rows: AnalyzeArgument, seed: AnalyzeArgument, key: AnalyzeArgument, count: AnalyzeArgument, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        _names(key, rows)
        return AnalyzeResult(StructType([*rows.dataType.fields, StructField("place", IntegerType(), False), StructField("message", LongType(), False), StructField("attempt", IntegerType(), False)]))

    def eval(self, rows: Row, seed: str, key: str, count: int, least: int = 12) -> Iterator[tuple]:
        taken: list[int] = []
        for attempt in range(self.ATTEMPTS):
            if len(taken) == count:
                return
            drawn = int(hashlib.sha256(f"{seed}:{rows[key]}:{attempt}".encode()).hexdigest()[: self.WIDTH // 4], 16)
            if all((drawn ^ x).bit_count() >= least for x in taken):
                taken.append(drawn)
                yield (*rows, len(taken) - 1, drawn, attempt + 1)
        if len(taken) < count:
            raise ValueError("no separated messages were found")


class PairOutcomes:
    """Each pair of a baseline's and a candidate's row with one key: rescued, regressed, both or neither.

    A key of which one side lacks a row gives none; of several rows of a side any one passing is enough.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, method: AnalyzeArgument, flag: AnalyzeArgument, baseline: AnalyzeArgument, candidate: AnalyzeArgument) -> AnalyzeResult:
        names = _names(key, rows)
        _names(method, rows)
        _names(flag, rows)
        fields = [StructField(f.name, f.dataType, True) for name in names for f in rows.dataType.fields if f.name == name]
        schema = StructType([*fields, StructField("baseline", BooleanType()), StructField("candidate", BooleanType()), StructField("outcome", StringType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(n) for n in names], orderBy=[OrderingColumn(method.value)])

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.passed: dict[str, bool] = {}

    def eval(self, rows: Row, key: str, method: str, flag: str, baseline: str, candidate: str) -> None:
        self.key = tuple(rows[k.strip()] for k in key.split(","))
        if rows[method] in (baseline, candidate):
            side = rows[method] == candidate
            self.passed[side] = bool(self.passed.get(side) or rows[flag])

    def terminate(self) -> Iterator[tuple]:
        if len(self.passed) == 2:
            before, after = self.passed[False], self.passed[True]
            yield (*self.key, before, after, "both" if before and after else "rescued" if after else "regressed" if before else "neither")


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    for name, handler in (("evidence_scopes", EvidenceScopes), ("message_sets", MessageSets), ("pair_outcomes", PairOutcomes)):
        spark.udtf.register(name, udtf(handler))
