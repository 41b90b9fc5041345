"""Queries whose SQL held on small tables only: events with larger ids, and more of them."""

import duckdb
import pytest

from concord.plans.registry import ORACLES, QUERIES
from tests.oracle import norm, rows_of

#: Ids whose instants lie in years with summer time in China, and more rows than a store keeps processed keys.
EVENTS = {
    "t7_epoch_to_ts": "SELECT 500000 + 37 * i AS event_id FROM range(6000) t(i)",
    "g4_article_rounds": "SELECT i AS event_id, TIMESTAMP '2024-01-09' - INTERVAL 1 HOUR * (i % 40) AS ts, ['view', 'click', 'error'][1 + i % 3] AS event_type FROM range(15000) t(i)",
}


@pytest.mark.parametrize("name", sorted(EVENTS))
def test_larger_events(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'").fetchall()
    con.execute(f"COPY ({EVENTS[name]}) TO '{tmp_path}/events.parquet' (FORMAT parquet)").fetchall()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'").fetchall()
    got = QUERIES[name](spark, str(tmp_path))
    sql = con.execute(f"SELECT {', '.join(sorted(got.columns))} FROM ({ORACLES[name]})").fetchall()
    assert rows_of(got) == sorted((tuple(norm(v) for v in r) for r in sql), key=repr)
