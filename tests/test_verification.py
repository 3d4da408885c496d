"""Rebuilt segments and their verification by arrays of blocks, against samples as rows and against definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import ranges, verification
from tracewright.operators.storage import settled
from tracewright.plans.replace import replaced

SR = 6.625
MEASURES = ("spectral", "envelope", "level", "autocorrelation", "energy", "passed", "issues")


def rows_of(spark, x):
    return settled(spark.createDataFrame([("t", i, None if v is None else float(v)) for i, v in enumerate(x)], "trace_id string, idx long, w double"))


def segments_of(spark, spans, n, reach=100, gap=6):
    rows = [("t", s, e, max(0, s - gap - reach), s - gap - 1, e + 1 + gap, min(n - 1, e + gap + reach)) for s, e in spans]
    return spark.createDataFrame(rows, "trace_id string, s long, e long, b_s long, b_e long, a_s long, a_e long")


def test_arrays_of_blocks_are_the_samples_of_the_parts(spark):
    x = [None if i % 13 == 4 else i * 1.5 for i in range(300)]
    for places in (range(300), [i for i in range(300) if i % 7 != 3]):
        df = rows_of(spark, x).where(F.col("idx").isin(list(places)))
        spans = {s: ((s - 40, s - 1), (s, s + 25)) for s in (0, 20, 64, 270)}
        segs = spark.createDataFrame([("t", s, *a, *b) for s, (a, b) in spans.items()], "trace_id string, s long, p long, q long, u long, v long")
        found = ranges.arrays_in(df, segs, {"one": (F.col("p"), F.col("q")), "two": (F.col("u"), F.col("v"))}, "w", ("s",), bucket=16).collect()
        assert {r.s: [list(r.one), list(r.two)] for r in found} == {s: [[x[i] for i in places if a <= i <= b] for a, b in parts] for s, parts in spans.items()}


def test_segments_verified_by_arrays_and_by_rows_are_the_same(spark):
    rng = np.random.default_rng(4)
    n = 3000
    x = list(450 + 20 * np.sin(np.arange(n) / 5) + rng.normal(0, 5, n))
    x[700], x[1210] = None, float("nan")  # within a reference; within a segment
    x[2000:2100] = [-v for v in x[2000:2100]]
    spans = [(0, 30), (3, 60), (800, 830), (1200, 1300), (2000, 2099), (2500, 2501), (2960, 2999)]
    df, segs = rows_of(spark, x), segments_of(spark, spans, n)
    by_arrays = {r.s: r for r in verification.verified(df, segs, SR).collect()}
    for whole in (0, 200):  # all by rows; some of them
        by_rows = {r.s: r for r in verification.verified(df, segs, SR, whole=whole).collect()}
        assert sorted(by_rows) == sorted(by_arrays) == [s for s, _ in spans]
        for s, r in by_rows.items():
            assert [getattr(by_arrays[s], m) for m in MEASURES] == [v if isinstance(v, (str, bool)) else pytest.approx(v, abs=1e-9, nan_ok=True) for v in (getattr(r, m) for m in MEASURES)]


def test_rounding_makes_no_lag_negative(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(400, 900, 1000).astype(float)
    x[430:494] = 0  # the last lags of the reference before are sums of zeros
    df, segs = rows_of(spark, x), segments_of(spark, [(500, 530)], 1000, reach=400)
    for whole in (1 << 16, 0):
        assert verification.verified(df, segs, SR, whole=whole).first().autocorrelation == pytest.approx((400 - 31) / 400)


def test_a_segment_is_rebuilt_once_and_verified_without_rows_of_samples(spark):
    df = spark.range(6000).select(F.lit("t").alias("trace_id"), F.col("id").alias("idx"), (400 + F.col("id") % 90).cast("double").alias("v"), (F.col("id") % 500).between(100, 130).alias("bad"))
    segs = segments_of(spark, [(s, s + 30) for s in range(100, 6000, 500)], 6000)
    values, report = replaced(df, segs.select("trace_id", "s", "e", F.lit("core").alias("method")), SR)
    assert all("MapInPandas" not in x._jdf.queryExecution().toString() for x in (values, report)) and report.count() == 12
    spark.sparkContext.setJobGroup("verified", "verified")
    try:
        verification.verified(df.withColumnRenamed("v", "w"), segs, SR).collect()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("verified")) < 12
