"""The numbered queries that SQL can express, against that SQL on DuckDB over whole tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tallyforge.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    assert got == Counter(found.fetchall()) and got
