"""Every core query that has SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import duckdb
import pytest
from rubato.queries import ORACLE_SQL, QUERIES

TABLES = "documents events embeddings labels conversations".split()


def rows(pdf) -> list:
    return sorted(map(tuple, pdf.reindex(sorted(pdf.columns), axis=1).astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, small_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small_dir}/{t}.parquet'")
    found, want = QUERIES[name](spark, small_dir).toPandas(), con.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, small_dir, name):
    assert QUERIES[name](spark, small_dir).count() > 0
