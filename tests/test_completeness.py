"""Live completeness over files that arrive one after the other, with restarts between them."""

import datetime as dt

import pytest

from proofgrid.streaming import completeness

SCHEMA = "image string, cell string, guard string, time timestamp"
CELLS = ["clean", "jpeg", "rotation"]
NOON = dt.datetime(2024, 5, 1, 12)


@pytest.fixture
def arrive(spark, tmp_path):
    """Write rows (image, cell, guard, minutes after noon) as a new file, run the stream until it is used up, and give what it adds."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    seen = []

    def send(*rows):
        frame = spark.createDataFrame([(i, c, g, NOON + dt.timedelta(minutes=m)) for i, c, g, m in rows], SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        # A new query each time: what it knows comes from the checkpoint.
        completeness.drain(completeness.live_completeness(stream, CELLS, "g1"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        found = [(r.image, r.status, r.cell, r.n_cells, tuple(r.missing)) for r in spark.read.schema(completeness.REPORT).parquet(f"{tmp_path}/out").collect()]
        new = list(found)
        for row in seen:
            new.remove(row)
        seen[:] = found
        return sorted(new, key=str)

    yield send
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_images_are_closed_over_restarts(arrive):
    assert arrive(("a", "clean", "g1", 0), ("a", "jpeg", "g1", 1), ("b", "clean", "g1", 0)) == []
    assert arrive(("a", "rotation", "g1", 2), ("b", "jpeg", "g1", 3)) == [("a", "complete", None, 3, ())]
    # Repeated, foreign and unexpected rows are told and don't count.
    assert arrive(("b", "jpeg", "g1", 4), ("b", "rotation", "g2", 4), ("b", "blur", "g1", 4), ("a", "clean", "g1", 5)) == [
        ("a", "repeated", "clean", 3, ()), ("b", "foreign", "rotation", 2, ()), ("b", "repeated", "jpeg", 2, ()), ("b", "unexpected", "blur", 2, ()),
    ]
    # Time passes by the rows of another image: b is overdue, a is closed and says nothing more.
    assert arrive(("c", "clean", "g1", 300)) == [("b", "overdue", None, 2, ("rotation",))]
    # A row of b that is later than the watermark is left out; c can still be closed.
    assert arrive(("b", "rotation", "g1", 5), ("c", "jpeg", "g1", 301), ("c", "rotation", "g1", 302)) == [("c", "complete", None, 3, ())]


def test_rows_of_another_run_open_no_image(arrive):
    assert arrive(("a", "clean", "g2", 0), ("a", "blur", "g1", 0)) == [("a", "foreign", "clean", 0, ()), ("a", "unexpected", "blur", 0, ())]
    assert arrive(("z", "clean", "g1", 600)) == []
    assert arrive(("a", "clean", "g1", 601), ("a", "jpeg", "g1", 601), ("a", "rotation", "g1", 601)) == [("a", "complete", None, 3, ())]
