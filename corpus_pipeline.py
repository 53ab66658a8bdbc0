"""A corpus in four stages: toxic texts go, repetitive texts go, one text of each near-duplicate class stays, the rest is packed.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame: the first three the rows of docs that stay, with all
their columns, the last one the places of token pieces in sequences. A null doc_id or text is judged like any
other row; an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from proofgrid.llm import near_dups, packing, quality_rules, toxicity
from proofgrid.llm.store import materialize, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, toxicity.train_rows(read(spark, sf_dir, "labels"))))


def drop_repetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.drop_repetitive(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_repetitive),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]
#: SQL can't express the stages; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
