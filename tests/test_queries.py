"""Every registered sequence query against its SQL in DuckDB, at the smallest size."""

import duckdb
import pytest

import __spark_entry__
from strandloom.plans.queries import ORACLES, QUERIES
from strandloom.plans.sequences import LENGTH, SQL_DRAFTS, SQL_READS, sql_edits

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def rows(frame, columns):
    return sorted(repr(tuple(v.item() if hasattr(v, "item") else v for v in r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


#: Whole rounds of exact steps: too slow in SQL for the larger sizes.
EXACT = f"""WITH RECURSIVE {SQL_READS}, {SQL_DRAFTS},
    f(tid, draft, polished, rounds) AS (
        SELECT tid, draft, draft, 0 FROM drafts
        UNION ALL
        SELECT tid, draft, edited, rounds + 1 FROM (
            WITH {sql_edits('f', 'polished', 0, 1, 2 * LENGTH)},
                scored AS (SELECT x.tid, edited, sum(levenshtein(edited, rd)) AS score FROM (SELECT DISTINCT tid, edited FROM edits) x JOIN reads r ON r.tid = x.tid GROUP BY ALL)
            SELECT f.tid, f.draft, f.rounds, pos, slot, e.edited, s.score, t.score AS total
            FROM f JOIN edits e ON e.tid = f.tid JOIN scored s ON s.tid = f.tid AND s.edited = e.edited JOIN scored t ON t.tid = f.tid AND t.edited = f.polished)
        WHERE score < total QUALIFY row_number() OVER (PARTITION BY tid ORDER BY pos, score, slot) = 1)
    SELECT tid, draft, arg_max(polished, rounds) AS polished, max(rounds)::INT AS rounds FROM f GROUP BY tid, draft"""


def test_polish_exact(spark, duck):
    got, want = QUERIES["polish_exact"](spark, SF).toPandas(), duck.sql(EXACT).df()
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["simulate_reads", "fit_model"])
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
