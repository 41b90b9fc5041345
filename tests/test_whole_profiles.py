"""Queries of profiles take all customers where no search limits them to a query set."""

import duckdb

from concord.plans.registry import ORACLES, QUERIES
from tests.oracle import rows_of, rows_of_sql


def test_totals_are_those_of_every_customer(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT CASE WHEN i < 120 THEN i END AS c_custkey FROM range(122) t(i) UNION ALL SELECT 7) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT i AS p_partkey, CASE WHEN i % 4 <> 1 THEN 'part ' || i END AS p_name, i % 5 - 1 AS p_size FROM range(40) t(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    got = rows_of(QUERIES["j9_profile_pairs"](spark, str(tmp_path)))
    assert {r[0] for r in got} == {None, *range(120)}
    assert got == rows_of_sql(ORACLES["j9_profile_pairs"], str(tmp_path))
