"""Table functions in SQL against the DataFrame operators."""

import pytest
from pyspark.sql import functions as F

from proofgrid.functions import tables
from proofgrid.operators.messages import separated
from proofgrid.plans.standins import records


@pytest.fixture
def view(spark, small):
    tables.register(spark)
    records(spark, small).where("image_id < 60").createOrReplaceTempView("facts")
    return spark.table("facts")


def test_scopes_equal_a_cube(spark, view):
    got = spark.sql("SELECT dataset, attack, model, count(*) AS n, sum(complete_recovery) AS r FROM evidence_scopes(TABLE(facts), 'dataset, attack') GROUP BY dataset, attack, model").collect()
    one = spark.sql("SELECT DISTINCT scope FROM evidence_scopes(TABLE(facts), 'dataset')").collect()
    want = spark.sql("SELECT dataset, attack, model, count(*) AS n, sum(complete_recovery) AS r FROM facts GROUP BY model, CUBE (dataset, attack)").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r.scope for r in one} == {"overall", "dataset"}


def test_message_sets_equal_the_column_function(spark, view):
    images = spark.range(50).withColumnRenamed("id", "image_id")
    images.createOrReplaceTempView("images")
    want = images.select("image_id", separated(F.concat_ws(":", F.lit("s"), F.col("image_id").cast("string")), 3, least=14).alias("s")).collect()
    got = {}
    for r in spark.sql("SELECT * FROM message_sets(TABLE(images), 's', 'image_id', 3, 14)").orderBy("image_id", "place").collect():
        got.setdefault(r.image_id, []).append((r.message, r.attempt))
    assert {r.image_id: (r.s.messages, r.s.attempts) for r in want} == {k: ([m for m, _ in v], v[-1][1]) for k, v in got.items()}


def test_pairs_meet_whole_and_lonely_rows_give_none(spark, view):
    rows = [("a", "x", 1), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1), ("b", "y", 0), ("c", "x", 1), ("d", "z", 1), (None, "x", 1), (None, "y", 1)]
    spark.createDataFrame(rows, "k string, m string, ok int").repartition(7).createOrReplaceTempView("sides")
    got = spark.sql("SELECT k, outcome FROM pair_outcomes(TABLE(sides), 'k', 'm', 'ok', 'x', 'y')").collect()
    assert {(r.k, r.outcome) for r in got} == {("a", "regressed"), ("b", "rescued"), (None, "both")} and len(got) == 3


def test_wrong_columns_are_told(spark, view):
    with pytest.raises(Exception, match="not columns of the table: nothing"):
        spark.sql("SELECT * FROM evidence_scopes(TABLE(facts), 'nothing')").collect()
    with pytest.raises(Exception, match="first argument must be a table"):
        spark.sql("SELECT * FROM evidence_scopes('facts', 'dataset')").collect()


def test_many_attempts_find_messages_far_apart(spark):
    found = spark.range(40).select(separated(F.col("id").cast("string"), 4, least=17).alias("s")).collect()
    assert max(r.s.attempts for r in found) > 64
    for r in found:
        assert all((a ^ b).bit_count() >= 17 for k, a in enumerate(r.s.messages) for b in r.s.messages[k + 1 :])
