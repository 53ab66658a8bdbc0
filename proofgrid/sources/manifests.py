"""Dataset manifests: build from files, read with checks, verify against files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import inside
from ..operators.audit import duplicates

SCHEMA = "dataset string, split string, sample_id string, relative_path string, width int, height int, image_format string, sha256 string"
HEADER = [f.split()[0] for f in SCHEMA.split(", ")]


class ManifestError(ValueError):
    pass


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """relative_path, size and sha256 of every file below root; contents stay in their tasks."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    start = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    path = F.regexp_replace(F.url_decode(F.col("path")), "^file:/*", "/")
    return raw.select(F.substr(path, F.length(start) + 2).alias("relative_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def image_size(content: Column) -> tuple[Column, Column]:
    """Width and height in the header of a PNG, GIF, BMP, JPEG or extended WebP file; null for other or broken files."""

    def number(at: Column | int, n: int, little: bool = False) -> Column:
        raw = F.substring(content, at, n)
        raw = F.concat(*[F.substring(raw, k, 1) for k in range(n, 0, -1)]) if little else raw
        return F.conv(F.nullif(F.hex(raw), F.lit("")), 16, 10).cast("int")

    begins = lambda text, at=1: F.hex(F.substring(content, at, len(text) // 2)) == text
    # A JPEG is a chain of segments, each with its length; the first frame header has the size.
    marker = lambda at: F.hex(F.substring(content, at, 2))
    frame = lambda at: marker(at).rlike("^FFC[0-9A-F]$") & ~marker(at).isin("FFC4", "FFC8", "FFCC")
    step = lambda at, _: F.when(frame(at) | ~marker(at).startswith("FF"), at).otherwise(at + 2 + F.coalesce(number(at + 2, 2), F.lit(0)))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(256)), F.lit(3), step)
    jpeg = begins("FFD8") & frame(found)
    forms = [
        (begins("89504E470D0A1A0A"), number(17, 4), number(21, 4)), (begins("47494638"), number(7, 2, True), number(9, 2, True)), (begins("424D"), number(19, 4, True), _signed(content, 23)),
        (jpeg, number(found + 7, 2), number(found + 5, 2)), (begins("52494646") & begins("5745425056503858", 9), number(25, 3, True) + 1, number(28, 3, True) + 1),
    ]
    width = height = F.lit(None).cast("int")
    for fits, w, h in reversed(forms):
        width, height = F.when(fits, w).otherwise(width), F.when(fits, h).otherwise(height)
    return width, height


def _signed(content: Column, at: int) -> Column:
    """The size of a signed 32-bit number, low byte first: a BMP whose rows run downwards has a negative height."""
    value = F.conv(F.hex(F.concat(*[F.substring(content, at + k, 1) for k in (3, 2, 1, 0)])), 16, 10).cast("long")
    return F.abs(F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)).cast("int")


def build_manifest(spark: SparkSession, root: str, dataset: str, split: str, pattern: str = "*", limits: Sequence[int | None] = (), numeric: bool = False) -> DataFrame:
    """A manifest of the files below root, by path or by the number in the name; the least of the limits keeps the first so many."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    width, height = image_size(F.col("content"))
    start = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    path = F.substr(F.regexp_replace(F.url_decode(F.col("path")), "^file:/*", "/"), F.length(start) + 2)
    rows = raw.select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), path.alias("sample_id"), path.alias("relative_path"), width.alias("width"), height.alias("height"),
        F.upper(F.regexp_extract(path, r"\.([^.]+)$", 1)).alias("image_format"), F.sha2("content", 256).alias("sha256"),
    )
    stem = F.regexp_extract("relative_path", r"([0-9]+)\.[^./]+$", 1).try_cast("long")
    rows = rows.orderBy(stem, "relative_path") if numeric else rows.orderBy("relative_path")
    given = [n for n in limits if n is not None]
    return rows.limit(min(given)) if given else rows


def write_manifest(manifest: DataFrame, path: str) -> None:
    if manifest.isEmpty():
        raise ManifestError("an empty manifest is refused")
    manifest.select(*HEADER).write.mode("errorifexists").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with typed columns. The header must be exact, values well-formed, names unique, and there must be rows."""
    header = spark.read.option("header", True).csv(path).columns
    if [h.lstrip("﻿") for h in header] != HEADER:
        raise ManifestError(f"unexpected header {header}")
    text = spark.read.schema(SCHEMA.replace(" int", " string")).option("header", True).option("enforceSchema", True).csv(path)
    rows = text.withColumns({c: F.col(c).cast("int") for c in ("width", "height")})
    if rows.isEmpty():
        raise ManifestError("no rows")
    again = duplicates(rows, ["sample_id"]).limit(3).collect()
    if again:
        raise ManifestError(f"sample_id occurs more than once: {[r.sample_id for r in again]}")
    return rows


def verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Each manifest row with its status against found files: verified, escape, missing, mismatch or resized (where found tells sizes)."""
    sized = {"width", "height"} <= set(found.columns)
    nothing = F.lit(None).cast("int")
    seen = found.select("relative_path", F.col("sha256").alias("_sha"), (F.col("width") if sized else nothing).alias("_width"), (F.col("height") if sized else nothing).alias("_height"))
    resized = (F.col("_width") != F.col("width")) | (F.col("_height") != F.col("height"))
    status = F.when(~inside(F.col("relative_path")), "escape").when(F.col("_sha").isNull(), "missing").when(F.col("_sha") != F.col("sha256"), "mismatch").when(resized, "resized").otherwise("verified")
    return manifest.join(seen, "relative_path", "left").withColumn("status", status).drop("_sha", "_width", "_height")
