"""Queries of the training-data operators against their SQL, on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

from prismara.llm import queries


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(spark, tiny, name):
    con = duckdb.connect()
    for f in sorted(Path(tiny).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = sorted(d[0] for d in cursor.description)
    names = [d[0] for d in cursor.description]
    want = sorted("|".join(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    df = queries.queries()[name](spark, tiny)
    assert sorted(df.columns) == columns
    assert sorted("|".join(plain(r[c]) for c in columns) for r in df.collect()) == want
