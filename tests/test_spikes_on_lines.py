"""Spikes that lie on the line between their neighbours already are spikes all the same, as in the SQL."""

import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__
from tracewright.queries.views import TRC


def test_spike_fill_returns_every_spike(spark, tmp_path):
    rng, n = np.random.default_rng(0), 20_000
    value = np.where(rng.random(n) < 0.7, 50.0, np.floor(rng.uniform(0, 10, n)) * 10)
    ts = [datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i) for i in range(n)]
    pq.write_table(pa.table({"event_id": list(range(n)), "ts": pa.array(ts, pa.timestamp("us")), "event_type": ["a"] * n, "value": value}), tmp_path / "events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    sql = c.execute(__spark_entry__.oracle_sql()["spike_fill"])
    columns = [d[0] for d in sql.description]
    rows = __spark_entry__.queries()["spike_fill"](spark, str(tmp_path)).select(*columns).collect()
    expected = sorted(sql.fetchall())
    unmoved = c.execute(f"WITH {TRC}, q AS ({__spark_entry__.oracle_sql()['spike_fill']}) SELECT count(*) FROM q JOIN trc USING (trace_id, idx) WHERE w = v").fetchall()
    assert unmoved[0][0] > 0
    assert sorted(tuple(r) for r in rows) == expected
