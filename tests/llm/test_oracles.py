"""The SQL of the operators that have one against the queries, on the smallest tables."""

import duckdb
import pytest

from strandloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, name):
    with duckdb.connect() as db:
        for table in ("documents", "pages", "conversations"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        found = db.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        want = found.fetchall()
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == sorted(map(repr, want))
