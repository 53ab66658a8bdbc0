"""Token counts as delta-maintained rollups.

A change is an insert, a delete or a revised count of one document under one tokenizer version. Its signed delta
(documents and tokens) is added to totals by source, language and tokenizer version. Every batch of changes is
reduced to its deltas and written as one folder named by the batch, in one commit; a batch that was committed
before is not read again, and one that broke off leaves nothing that counts. The rollup is the sum of all
committed folders; compacting sums up those so far in one, so that later rollups read that and what came after it.

Defined cases: a null or empty text has 0 tokens and still counts as a document; null source or language is a group
of its own; a change without op, or a revision without an old count, is refused (the commit fails as a whole);
repeated rows count each; of the rows of one text, copies_of leaves one (the least doc_id, null last) whatever
their doc_ids, so repeated and null ones go too; a change may stand for times equal ones; an empty batch commits and changes nothing; an empty store gives an empty rollup; groups
whose documents and tokens are back at 0 are left out; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode
from .store import fresh_path, map_texts, materialize, read

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def count_tokens(docs: DataFrame, path: str, pattern: str, *keep: Column) -> DataFrame:
    """doc_id, source, lang, keep and n_tokens of every row of docs(doc_id, text, source, lang). No shuffle."""
    group = [F.col(c).cast("string").alias(c) for c in ("source", "lang")]
    return map_texts(docs, lambda text: (len(encode(text, path, pattern)),), "n_tokens long", *group, *keep)


def signed_deltas(changes: DataFrame) -> DataFrame:
    """changes(op, source, lang, tokenizer, n_tokens, old_tokens, and times if a row stands for several) -> deltas by KEYS.

    insert adds n_tokens, delete takes old_tokens away, revise adds the difference.
    """
    op, new, old = F.col("op"), F.col("n_tokens"), F.col("old_tokens")
    times = F.col("times") if "times" in changes.columns else F.lit(1)
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0)
    tokens = F.when(op == "insert", new).when(op == "delete", -old).when(op == "revise", new - old)
    wrong = F.concat(F.lit("a change of kind "), F.coalesce(op, F.lit("null")), F.lit(" lacks a count or isn't known"))
    return (
        changes.select(*KEYS, F.when(docs.isNull() | tokens.isNull(), F.raise_error(wrong).cast("int")).otherwise(docs * times).alias("docs"), (tokens * times).alias("tokens"))
        .groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    )


class RollupStore:
    """Committed batches below one folder of a shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/batch={batch_id}/_SUCCESS"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False if it had been committed, in which case changes is not run."""
        if self.committed(batch_id):
            return False
        # Overwriting clears what a broken attempt left; _SUCCESS is written last and is the commit.
        signed_deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return True

    def batches(self) -> list[str]:
        """The committed batches, by name."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(b for b in (n.removeprefix("batch=") for n in names if n.startswith("batch=")) if self.committed(b))

    def _bases(self) -> list[str]:
        """The finished sums, the latest first; the list of what a sum covers is written last."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return [n for n in sorted((n for n in names if n.startswith("base=")), reverse=True) if self._fs.exists(self._path(f"{self.path}/{n}/covers/_SUCCESS"))]

    def _totals(self, batches: list[str]) -> DataFrame:
        paths = [f"{self.path}/batch={b}" for b in batches]
        if base := next(iter(self._bases()), None):
            covered = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{base}/covers").collect()}  # names of batches
            paths = [f"{self.path}/{base}/totals", *(f"{self.path}/batch={b}" for b in batches if b not in covered)]
        deltas = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Sum up all batches committed so far. Their folders stay, as the record of what was committed."""
        batches = self.batches()
        at = f"{self.path}/base={len(batches):012d}"
        if not batches or at.rsplit("/", 1)[1] in self._bases():
            return
        self._totals(batches).write.mode("overwrite").parquet(f"{at}/totals")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").write.mode("overwrite").parquet(f"{at}/covers")

    def rollup(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        return self._totals(self.batches())


def changes_of(rows: DataFrame, op: str, tokenizer: str, new: str | None, old: str | None) -> DataFrame:
    """rows as changes of one kind: new and old name the columns of the counts; a column times is kept."""
    none = F.lit(None).cast("long")
    times = ["times"] if "times" in rows.columns else []
    return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), (F.col(new) if new else none).alias("n_tokens"), (F.col(old) if old else none).alias("old_tokens"), *times)


def copies_of(counted: DataFrame, counts: list[str]) -> DataFrame:
    """counted(print, source, lang, doc_id, counts) -> source, lang, counts, times: all rows of each print but one.

    Rows are summed up by print and group before they move, so a text of many copies is a few rows in its task.
    """
    group = ["print", "source", "lang"]
    groups = counted.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), *[F.max(c).alias(c) for c in counts])
    order = F.struct(F.col("least").isNull().alias("unnamed"), "least", "source", "lang")
    kept = groups.groupBy("print").agg(F.min(order).alias("kept"))
    times = F.col("n") - F.when(order == F.col("kept"), 1).otherwise(0)
    return groups.join(kept, "print").select("source", "lang", *counts, times.alias("times")).where("times > 0")


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The life of all documents in four batches, the last one delivered twice.

    1: every document is inserted, counted by the byte-level BPE and by words as a plain split tells them.
    2: the word counts are revised to words as runs of letters and digits.
    3: exact copies (all rows of a text but one) are deleted from both. 4 is 3 again, and changes nothing.
    """
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    split_words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("split_words")
    letter_runs = F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), 0)).cast("long").alias("letter_runs")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, F.unhex(F.sha2(text, 256)).alias("print"), split_words, letter_runs)
    counted = materialize(counted, "counts")

    store = RollupStore(spark, fresh_path(spark, "rollup"))
    store.commit("0001", changes_of(counted, "insert", "byte_bpe_50k", "n_tokens", None).unionByName(changes_of(counted, "insert", "words", "split_words", None)))
    store.commit("0002", changes_of(counted, "revise", "words", "letter_runs", "split_words"))
    copies = copies_of(counted, ["n_tokens", "letter_runs"])
    gone = changes_of(copies, "delete", "byte_bpe_50k", None, "n_tokens").unionByName(changes_of(copies, "delete", "words", None, "letter_runs"))
    store.commit("0003", gone)
    store.compact()
    store.commit("0003", gone)
    return store.rollup()
