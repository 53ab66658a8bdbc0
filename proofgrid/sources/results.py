"""Result tables: sinks and sources, shards that are merged after checks, history with guarded export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import export_guard, finite_text
from ..operators.audit import duplicates, same_keys


class ResultError(ValueError):
    pass


def write_results(rows: DataFrame, path: str, by: Sequence[str] = (), form: str = "parquet") -> None:
    """Replace the partitions that rows touch, or the whole table without by. CSV has infinities as inf."""
    if form == "csv":
        rows = rows.select(*[finite_text(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in rows.dtypes])
    out = rows.write.mode("overwrite").format(form).option("header", True).option("escape", '"')
    if by:
        out = out.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    out.save(path)


def read_results(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """Results with a fixed schema; only the columns that a query needs are read."""
    return spark.read.schema(schema).format(form).options(header=True, positiveInf="inf", negativeInf="-inf", nanValue="nan", escape='"').load(path)


def complete(expected: DataFrame, observed: DataFrame, key: Sequence[str]) -> bool:
    """Whether a run holds exactly the expected keys, each once: then it need not run again."""
    return bool(same_keys(expected, observed, key).first().complete)


def merge_shards(shards: Sequence[DataFrame], key: Sequence[str], rows_each: int | None = None, datasets: Sequence[str] | None = None) -> DataFrame:
    """All shards as one table. Schemas must agree, each shard holds one dataset and the expected number of rows, and no key occurs twice."""
    if not shards:
        raise ResultError("no shards")
    merged = shards[0].withColumn("_shard", F.lit(0))
    for k, shard in enumerate(shards[1:], 1):
        if shard.schema.simpleString() != shards[0].schema.simpleString():
            raise ResultError(f"shard {k} has another schema")
        merged = merged.unionByName(shard.withColumn("_shard", F.lit(k)))
    seen = merged.groupBy("_shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dataset").alias("datasets"), F.min("dataset").alias("dataset")).collect()  # a row for each shard
    wrong = [r._shard for r in seen if r.datasets != 1 or rows_each is not None and r.n != rows_each]
    if wrong or len(seen) != len(shards):
        raise ResultError(f"shards {wrong} hold other rows or datasets than expected, or none")
    if datasets is not None and sorted(r.dataset for r in seen) != sorted(datasets):
        raise ResultError("datasets are unknown or missing")
    if not duplicates(merged, key).isEmpty():
        raise ResultError("keys occur in more than one row")
    return merged.drop("_shard")


def read_partials(spark: SparkSession, path: str, schema: str, form: str = "csv") -> DataFrame:
    """The rows of all files below path, one for each image, with the file that each comes from in source_file."""
    rows = spark.read.schema(schema).format(form).options(header=True, positiveInf="inf", negativeInf="-inf", nanValue="nan", escape='"', recursiveFileLookup=True).load(path)
    return rows.select("*", F.col("_metadata.file_path").alias("source_file"))


def partial_status(rows: DataFrame, expected: DataFrame, image: str, cell: Sequence[str]) -> DataFrame:
    """read_partials' rows and the expected cells of every image -> source_file, images, n_rows, n_cells, complete.

    A file is complete if it holds one image and each expected cell of it once, and no other.
    """
    wanted = expected.select(*cell).distinct().withColumn("_wanted", F.lit(1))  # the protocol
    marked = rows.join(F.broadcast(wanted), list(cell), "left")
    counted = marked.groupBy("source_file").agg(
        F.count_distinct(image).alias("images"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.when(F.col("_wanted") == 1, F.struct(*cell))).alias("n_cells"),
    )
    planned = wanted.count()
    return counted.withColumn("complete", (F.col("images") == 1) & (F.col("n_rows") == planned) & (F.col("n_cells") == planned))


def combine_partials(spark: SparkSession, path: str, schema: str, expected: DataFrame, image: str, cell: Sequence[str], form: str = "csv") -> DataFrame:
    """All files below path as one table, after each is found complete and no image is in two."""
    rows = read_partials(spark, path, schema, form)
    broken = partial_status(rows, expected, image, cell).where("not complete").select("source_file").orderBy("source_file").limit(3).collect()
    if broken:
        raise ResultError(f"incomplete files: {[r.source_file for r in broken]}")
    if not duplicates(rows, [image, *cell]).isEmpty():
        raise ResultError("an image is in more than one file")
    return rows.drop("source_file")


class History:
    """An append-only table of analysis records with a timestamp and a name."""

    def __init__(self, spark: SparkSession, path: str, schema: str, time: str = "created_at", name: str = "record_id"):
        self.spark, self.path, self.schema, self.time, self.name = spark, path, schema, time, name

    def append(self, rows: DataFrame) -> None:
        rows.select(*[f.split()[0] for f in self.schema.split(", ")]).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def latest(self, n: int = 50, **equal: object) -> DataFrame:
        return latest(self.table(), self.time, self.name, n, **equal)

    def get(self, name: str) -> DataFrame:
        return self.table().where(F.col(self.name) == name)

    def export(self, path: str) -> None:
        guarded(self.table()).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def latest(rows: DataFrame, time: str, name: str, n: int, **equal: object) -> DataFrame:
    """The newest 1 to 500 rows that fit, newest first: each task keeps n rows, nothing is sorted as a whole."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc(time), F.desc(name)).limit(min(max(n, 1), 500))


def guarded(rows: DataFrame) -> DataFrame:
    return rows.select(*[export_guard(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes])
