"""Documents that are frozen once they are written: chosen policies and thresholds, with the hashes of what they came from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import SparkSession


class FrozenError(RuntimeError):
    pass


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def freeze(spark: SparkSession, path: str, document: Mapping, started: str | None = None) -> None:
    """Write a document once. The same one again changes nothing; another one is refused, and so is any if started, a
    mark of the test that follows the selection, exists."""
    if started and _exists(spark, started):
        raise FrozenError("the test has started: selection is closed")
    text = json.dumps(document, sort_keys=True)
    if _exists(spark, f"{path}/_SUCCESS"):
        if load(spark, path) != json.loads(text):
            raise FrozenError(f"{path} holds another document")
        return
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, split: str | None = None, hashes: Mapping[str, str] | None = None) -> dict:
    """A frozen document, if it was selected on the split and its hashes are those of what is there now."""
    document = json.loads(spark.read.text(path, wholetext=True).first().value)
    if split is not None and document.get("selection_split") != split:
        raise FrozenError(f"selected on {document.get('selection_split')}, not on {split}")
    for name, now in (hashes or {}).items():
        if document.get(name) != now:
            raise FrozenError(f"{name} is no longer what the document was made with")
    return document
