"""Shared-folder tables that cut lineage, and table reading."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts whose results are held at once.
PART = 500
#: Row numbers up to which pick() sends them to all tasks (about 100 bytes each in the hash table of a join).
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset: on one machine (local mode) a temporary folder, set
    once; on a cluster an error, as a folder of one machine would be missing on the others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="proofgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, fold: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: every executor can reread it, none holds the only copy.

    fold: a table that is small beside its input is written by one task for eight shuffle partitions (by two a
    core at least), so that it isn't strewn over many small files; a task takes its partitions one after the other.
    """
    path = fresh_path(df.sparkSession, name)
    if fold:
        spark = df.sparkSession
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more: all that was made of them is written."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def pick(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the materialized ids, a table of one column of that name without repeats.

    Where the ids are at most BROADCAST_ROWS, all tasks get them and rows stay where they are; else both are
    shuffled by the key, of which no value has more rows than in rows.
    """
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("shuffle_hash"), key, "left_semi")


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving freed memory back to the system at its end: Spark keeps idle Python workers, which would hold it."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim:
            trim(0)

    return wrapped


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def map_texts(docs: DataFrame, judge: Callable[[str | None], tuple], fields: str, *keep: Column) -> DataFrame:
    """doc_id, keep and judge(text) for every row of docs(doc_id, text): fields names the results, like "n long, x double".

    Rows stay in their tasks and doc_id passes untouched, null or not. Results are built for PART texts at a time.
    """
    names, kinds = zip(*(f.split() for f in fields.split(", ")), strict=True)
    head = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *keep)
    schema = ", ".join([*(f"{n} {k}" for n, k in head.dtypes[1:]), fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                rows = list(zip(*map(judge, part.column(0).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *(pa.array(values, _ARROW[kind]) for values, kind in zip(rows, kinds, strict=True))], names=[*part.schema.names[1:], *names]
                )

    return head.mapInArrow(lean(run), schema)
