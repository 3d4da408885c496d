"""Averages and their ties against the SQL in one thread, which goes through the stored rows in order: no digit may depend on files and tasks."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Units whose methods have 20 to 50 rows each, scattered over four files; every third unit's methods have the same values in another order."""
    rng, rows = np.random.default_rng(5), []
    for unit in range(240):
        n = int(rng.choice([20, 40, 50]))
        values = rng.integers(0, 11, n)
        for method in "ANR":
            own = rng.permutation(values) if unit % 3 == 0 else rng.integers(0, 11, int(rng.choice([20, 40, 50])))
            rows += [(unit, method, int(v) / 100, int(v) % 9 / 100, float(v + 1)) for v in own]
    rng.shuffle(rows)
    folder = tmp_path_factory.mktemp("tables")
    (folder / "lineitem.parquet").mkdir()
    names = ["l_suppkey", "l_returnflag", "l_discount", "l_tax", "l_quantity"]
    for k in range(4):
        unit, *rest = zip(*rows[k::4], strict=True)
        pq.write_table(pa.table(dict(zip(names, [[int(u) for u in unit], list(rest[0]), *([float(x) for x in c] for c in rest[1:])], strict=True))), folder / "lineitem.parquet" / f"part-{k}.parquet")
    return folder


@pytest.mark.parametrize("name", ["dispersion", "ordinal_ranks", "improvements", "sign_flip_test", "signed_ranks"])
def test_equal_averages_and_ties_are_those_of_the_sql(spark, tables, name):
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tables}/lineitem.parquet/*.parquet'")
    sql = c.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    rows = __spark_entry__.queries()[name](spark, str(tables)).select(*columns).collect()
    assert sorted(tuple(r) for r in rows) == sorted(sql.fetchall())


@pytest.mark.parametrize("name", ["ordinal_ranks", "signed_ranks", "sign_flip_test"])
def test_differences_are_rounded_as_in_the_sql(spark, tmp_path, name):
    """Differences of k + 0.5 ten-thousandths: some times 10,000 are a little less than that, and go down."""
    unit = np.arange(400)
    d = [float(f"0.{k:04d}5") * (-1) ** (k % 3) for k in range(200)]
    value = [x for pair in zip(d + [0.0001 * k for k in range(200)], [0.0] * 400, strict=True) for x in pair]
    columns = {"l_suppkey": np.repeat(unit, 2), "l_returnflag": ["A", "N"] * 400, "l_discount": value, "l_tax": value, "l_quantity": value}
    pq.write_table(pa.table(columns), tmp_path / "lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    sql = c.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    rows = __spark_entry__.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(tuple(r) for r in rows) == sorted(sql.fetchall())
