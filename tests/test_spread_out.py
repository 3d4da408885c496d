"""Work that multiplies small tables is spread over many tasks, and gives what the plain form gives."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import stats, windows


def test_poisson_weights_by_text_are_those_by_number(spark):
    rows = spark.range(3000).select((F.col("id") % 60).alias("draw"), F.floor(F.col("id") / 60).alias("unit"))
    u = stats.uniform(F.lit(7), F.col("draw"), F.col("unit"))
    plain = sum((F.when(u >= b, 1).otherwise(0) for b in stats.POISSON), F.lit(0))
    both = rows.select(plain.alias("a"), stats.poisson_weight(7, F.col("draw"), F.col("unit")).alias("b"))
    assert both.where("a <> b OR b IS NULL").isEmpty() and both.agg(F.max("b")).first()[0] >= 4


def test_bootstrap_of_a_small_table_is_many_tasks(spark):
    df = spark.createDataFrame([("g", u, float(u % 7)) for u in range(200)] + [("h", u, 1.0) for u in range(0, 200, 2)] + [("h", 1, None)], "g string, unit long, v double")
    out = stats.bootstrap_mean(df, ["g"], "unit", "v", draws=40)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_unit" in plan and "REPARTITION_BY_NUM" in plan
    means = {}
    weight = {(r.d, r.u): r.w for r in spark.range(8000).select((F.col("id") % 40 + 1).alias("d"), F.floor(F.col("id") / 40).alias("u")).withColumn("w", stats.poisson_weight(7, F.col("d"), F.col("u"))).collect()}
    for g, units in (("g", range(200)), ("h", range(0, 200, 2))):
        value = (lambda u: float(u % 7)) if g == "g" else (lambda u: 1.0)
        means[g] = [sum(value(u) * weight[d, u] for u in units) / sum(weight[d, u] for u in units) for d in range(1, 41)]
    for r in out.collect():
        assert (r.low, r.high) == pytest.approx(tuple(np.quantile(means[r.g], (0.025, 0.975))))


@pytest.mark.parametrize("levels", [0, 3])
def test_quantiles_of_pairs_are_exact(spark, levels):
    rng = np.random.default_rng(5)
    traces = {"a": rng.normal(size=260), "b": np.round(rng.normal(size=93) * levels), "c": np.full(40, 2.0), "d": rng.normal(size=10)}
    rows = [(t, i, float(v)) for t, x in traces.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "trace_id string, idx long, v double")
    wanted = {"m50": ("d_mean", 0.5), "m95": ("d_mean", 0.95), "s95": ("d_std", 0.95), "s0": ("d_std", 0.0), "m100": ("d_mean", 1.0)}
    found = {r.trace_id: r for r in windows.healthy_quantiles(df, 10, "v", wanted, block=4, parts=16).collect()}
    assert "d" not in found  # a single window has no pair
    for t in "abc":
        w = traces[t][: len(traces[t]) // 10 * 10].reshape(-1, 10)
        d = {"d_mean": [abs(p.mean() - q.mean()) for p, q in itertools.combinations(w, 2)], "d_std": [abs(p.std() - q.std()) for p, q in itertools.combinations(w, 2)]}
        assert found[t].n_pairs == len(d["d_mean"])
        assert [found[t][k] for k in wanted] == pytest.approx([np.quantile(d[of], q) for of, q in wanted.values()], abs=1e-9)


def test_pairs_of_a_trace_are_dealt_by_blocks(spark):
    w = spark.createDataFrame([("t", i, 100, float(i), 0.0) for i in range(100)], "trace_id string, i long, n long, m double, d double")
    pairs = windows._paired_in_blocks(w, 10)
    assert pairs.count() == 4950 and pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 20
