"""Queries over few rows whose keys are as large as a large table's, against their SQL."""

import duckdb
import pytest
from test_oracles import table_of

from tallyforge.plans import registry


@pytest.fixture
def against_sql(spark, tmp_path):
    """Runs a query and its SQL over line items (order, number, part, quantity, price) of named parts."""

    def run(name, items, parts):
        con = duckdb.connect()
        con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_returnflag VARCHAR)")
        con.executemany("INSERT INTO lineitem VALUES (?, ?, 1, ?, ?, ?, 0.05, 'A')", [(o, p, n, q, price) for o, n, p, q, price in items])
        con.execute("CREATE TABLE part (p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR)")
        con.executemany("INSERT INTO part VALUES (?, ?, 'Brand#11')", parts or [(1, "none")])
        for t in ("lineitem", "part"):
            con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
        df = registry.QUERIES[name](spark, str(tmp_path))
        got = table_of(df.columns, [tuple(r) for r in df.collect()])
        found = con.execute(registry.ORACLE_SQL[name])
        return got, table_of([d[0] for d in found.description], found.fetchall())

    return run


def test_product_merge_keeps_both_objects_that_share_a_number(against_sql):
    # item 1 of part 1,000,005 and item 2 of part 5 have one number
    items = [(1, 1, 1_000_005, 3, 30.0), (1, 2, 5, 7, 140.0), (1, 3, 6, 1, 11.0)]
    got, want = against_sql("product_merge", items, [(1_000_005, "much longer name"), (5, "short"), (6, "other")])
    assert got == want


def test_thorough_scan_of_dear_parts(against_sql):
    # a part's price is its number and more, beyond the 1,000,000 at which an answer's price ends
    items = [(1, n, p, q, 10.0) for n, p, q in ((1, 1_199_999, 45), (2, 499_999, 50), (3, 700_001, 1))]
    got, want = against_sql("thorough_scan", items, [])
    assert got == want


def test_thorough_scan_of_equal_prices(against_sql):
    # 2 * 101 = 1 * 202: equal in resale and retail, the dearer part first though it comes later
    got, want = against_sql("thorough_scan", [(1, 1, 100, 2, 10.0), (1, 2, 201, 1, 10.0)], [])
    assert got == want


def test_thorough_scan_reads_all_photographs(against_sql):
    # position 7 and beyond, each a part of its own; 9 and 18 show one picture
    items = [(1, n, p, 1, 10.0) for n, p in enumerate((9, 2, 4, 5, 7, 8, 10, 18, 11, 13, 14, 16, 17, 19), start=1)]
    got, want = against_sql("thorough_scan", items, [])
    assert got == want and sum(got[1].values()) == 13
