"""Every query against its SQL, on the smallest tables; the driver's contract."""

import duckdb
import pytest

from vellum.plans import content_queries, corpus_queries, document_queries, exchange_queries, layout_queries, organise_queries, record_queries, text_queries, validate_queries

SMALL = "/root/testdata/sf0.001"
MODULES = (text_queries, corpus_queries, layout_queries, organise_queries, record_queries, content_queries, validate_queries, exchange_queries, document_queries)
PAIRS = [(name, f, m.ORACLES.get(name)) for m in MODULES for name, f in m.QUERIES.items()]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name,query,sql", PAIRS, ids=[p[0] for p in PAIRS])
def test_query_equals_sql(spark, oracle, name, query, sql):
    df = query(spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got
    if sql is None:
        return
    found = oracle.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())


def test_contract():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert {n for n, _, _ in PAIRS} <= queries.keys() and sql.keys() <= queries.keys()
    assert "search_substring" in queries
