"""Every registered query gives the rows of its SQL, run by DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from proofgrid.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return f"{number:.7g}" if math.isfinite(number) else str(number)
    return str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, small, oracle, name):
    found = registry.queries()[name](spark, small)
    got = rows(found.columns, found.collect())
    if name not in SQL:
        assert got
        return
    result = oracle.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(names)
    want = rows(names, result.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_entry_is_the_flagship(spark):
    import __spark_entry__

    flagship = __spark_entry__.entry(spark)
    assert flagship.columns == registry.queries()["paired_evidence_cube"](spark, "/root/testdata/sf0.001").columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
