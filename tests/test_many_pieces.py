"""Steps whose cost was one call, one task or one sorted list for each of many small pieces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import outliers, triggers
from tracewright.sources.store import SampleStore


def test_local_outliers_are_found_by_chunks_of_values(spark):
    rng = np.random.default_rng(3)
    x = [None if i % 90 == 7 else float(v) for i, v in enumerate(rng.integers(0, 40, size=400) + rng.normal(size=400).round(1))]
    df = spark.createDataFrame([("t", i, "kept", v) for i, v in enumerate(x)], "trace_id string, idx long, name string, v double")
    found = outliers.local_outlier_factor(df, "v", 6, chunk=70)
    assert "collect_list" not in found._jdf.queryExecution().toString() and found.columns == [*df.columns, "lof"]
    order = sorted(range(400), key=lambda i: (x[i] is not None, x[i] or 0.0, i))
    d = lambda i, j: -1.0 if x[i] is None or x[j] is None else abs(x[i] - x[j])
    near = {i: sorted((j for j in order[max(0, p - 6) : p + 7] if j != i), key=lambda j: (d(i, j), j))[:6] for p, i in enumerate(order)}
    far = {i: max(0.0, d(i, near[i][-1])) for i in order}
    density = {i: 1 / max(sum(max(far[j], d(i, j)) for j in near[i]) / 6, 1e-10) for i in order}
    rows = found.collect()
    assert {r.name for r in rows} == {"kept"} and {r.idx: r.lof for r in rows} == pytest.approx({i: sum(density[j] for j in near[i]) / 6 / density[i] for i in order}, rel=1e-12)


def test_stretches_are_matched_many_in_a_call(spark, monkeypatch):
    found = spark.range(400).select(F.lit("t").alias("trace_id"), (F.col("id") * 50 + F.col("id") % 3).alias("s"), (F.col("id") * 50 + 4).alias("e"))
    centres = spark.range(800).select(F.lit("t").alias("trace_id"), (F.col("id") * 25).alias("c"))
    got = []
    for n in (1, 7, 1024):
        monkeypatch.setattr(triggers, "STRETCHES", n)
        got.append({(r.c, r.s, r.e) for r in triggers.matched(found, centres, 5).collect()})
    assert got[0] == got[1] == got[2] == {(c, *((c + c // 50 % 3, c + 4) if c % 50 == 0 else (None, None))) for c in range(0, 20_000, 25)}


def test_folders_are_not_listed_by_a_task_each(spark, tmp_path):
    df = spark.range(200).select(F.lit("t").alias("trace_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("v"))
    store = SampleStore(spark, str(tmp_path / "store"), block=2)
    store.append(df)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        store.read(), store.read()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    tasks = [i.numTasks for s in stages if (i := tracker.getStageInfo(s))]
    assert tasks and max(tasks) <= spark.sparkContext.defaultParallelism and store.samples().count() == 200


def test_only_rows_near_an_end_look_for_images(spark):
    from tracewright.operators import rolling

    assert "CASE WHEN" in str(rolling._images("reflect", 3, 2))
    for n in (1, 2, 5, 40):
        df = spark.range(n).select(F.lit("t").alias("trace_id"), F.col("id").alias("idx"), F.lit(n).cast("long").alias("_n"))
        got = {r.idx: sorted(r.places) for r in df.select("idx", rolling._images("reflect", 3, 2).alias("places")).collect()}
        assert got == {i: [p for p in range(-3, n + 2) if i == min(p % (2 * n), 2 * n - 1 - p % (2 * n))] for i in range(n)}
