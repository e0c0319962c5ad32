"""The driver's entry points with this package in place."""

import re

import __spark_entry__ as entry

from larkspur.llm import queries


def test_one_query_for_each_operator_and_the_pipeline():
    names = entry.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert "pipeline" in names and set(queries.QUERIES) < set(names)
    assert set(entry.oracle_sql()) <= set(names) and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


def test_flagship(spark, sf_dir):
    rows = entry.entry(spark).collect()
    assert len(rows) == 11 and {r["slug"]: r["n_products"] for r in rows}["unknown-opening"] == 0


def test_queries_with_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf_dir)
        found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(found, key=repr)
