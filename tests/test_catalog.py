"""Every catalogue query against its oracle SQL on the smallest tables, and the driver's contract."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from prismara.plans import catalog


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con(tiny):
    out = duckdb.connect()
    for f in sorted(Path(tiny).glob("*.parquet")):
        out.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return out


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_oracle(spark, tiny, con, name):
    df = catalog.queries()[name](spark, tiny)
    cursor = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert lines(df.columns, df.collect()) == lines(columns, cursor.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
