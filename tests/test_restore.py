"""Restoration, spikes, levels and checks on hand-made traces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.config import Detection, Repair
from tracewright.functions import kernels
from tracewright.operators import masks, metrics, ranges, restore, runs, segments, spikes, stats, triggers
from tracewright.plans.composite import composite
from tracewright.plans.pipeline import repaired

from .test_core import trace

SR = 6.625


def segs(spark, *rows, kind=None):
    return spark.createDataFrame([("t", s, e, kind or "core") for s, e in rows], "trace_id string, s long, e long, kind string")


def flagged(spark, values):
    return trace(spark, values).withColumn("bad", masks.missing_counts(F.col("v")))


def quiet(n, seed=0, level=450.0):
    return np.rint(level + np.random.default_rng(seed).normal(0, 2, n))


def test_spike_verdicts(spark):
    x = quiet(400)
    x[50] = 520  # stands alone
    x[100:104] = 1023  # clips for four samples
    x[200] = 1023  # clips once
    x[300:310] = np.array([500, 540, 470, 560, 430, 980, 440, 550, 480, 530])  # an active stretch with one extreme peak
    x[399] = 700  # its own repetition beyond the end is the median there
    x[350] = -1
    got = {(r.s, r.e): r.verdict for r in spikes.judged(trace(spark, x), "v", SR).collect()}
    assert got[(50, 50)] == "accepted" and got[(100, 103)] == "short_saturation_plateau" and got[(200, 200)] in ("accepted", "short_saturation_plateau")
    assert got[(305, 305)] == "extreme_isolated_peak" and not any(s <= 399 <= e for s, e in got) and not any(s <= 350 <= e for s, e in got)
    out = {r.idx: r.w for r in spikes.replaced(trace(spark, x), "v", "w", SR).collect()}
    for s, e in ((50, 50), (100, 103), (305, 305)):
        at = [s - 2, s - 1, e + 1, e + 2]
        assert [out[i] for i in range(s, e + 1)] == pytest.approx(list(kernels.pchip(np.array(at, float), x[at], np.arange(s, e + 1, dtype=float))))
    assert out[399] == 700 and out[350] == -1 and out[304] == x[304] and len(out) == 400


def test_spikes_of_short_constant_and_empty_traces(spark):
    assert spikes.judged(trace(spark, [1.0, 2.0]), "v", SR).count() == 0
    assert spikes.judged(trace(spark, [5.0] * 30), "v", SR).count() == 0
    assert spikes.judged(trace(spark, [None, -1.0, float("nan")]), "v", SR).count() == 0
    assert spikes.replaced(trace(spark, [1.0]).where("idx < 0"), "v", "w", SR).count() == 0


def test_fewer_supports_lie_on_a_line(spark):
    x = quiet(60)
    x[1], x[30], x[28:30] = 900, 900, -1
    out = {r.idx: r.w for r in spikes.replaced(trace(spark, x), "v", "w", SR).collect()}
    assert out[1] == pytest.approx((x[0] + x[2]) / 2) and out[30] == pytest.approx(x[31])


def test_bounds_follow_a_tail_and_stop_at_walls(spark):
    x = quiet(6000, 1)
    x[3000:3400] += 60  # found only up to 3099
    found = segs(spark, (3000, 3099))
    none = segs(spark, (0, 0)).where("s > 0")
    row = restore.refined(found, flagged(spark, x), "v", "bad", none, SR).first()
    assert row.s == 3000 and 3400 <= row.e <= 3400 + 53 + 99 and row.kind == "core"
    walled = restore.refined(found, flagged(spark, x), "v", "bad", segs(spark, (3180, 3190)), SR).first()
    assert 3100 <= walled.e < 3180
    assert restore.refined(found, flagged(spark, np.full(6000, -1.0)), "v", "bad", none, SR).first().e == 3099


def test_low_edges(spark):
    x = quiet(500, 2)
    x[100:110], x[98:100], x[110:120] = -1, 31, 40
    row = restore.low_edges(segs(spark, (100, 109)), flagged(spark, x), "v", "bad").first()
    assert (row.new_s, row.new_e) == (98, 114)  # five at most


def test_references_are_masked(spark):
    x = quiet(900, 3)
    x[300:340], x[500:540] = 5000, -1
    rows = restore.masked_references(segs(spark, (200, 250)), segs(spark, (200, 250), (300, 339), (500, 539), (880, 890)), flagged(spark, x), "v", 300, "bad").collect()
    assert {(r.a, r.b) for r in rows} == {(300, 339), (500, 539)} and all(abs(r.level - 450) < 2 for r in rows)


def test_guard(spark):
    x, w = quiet(4000, 4), quiet(4000, 5)
    x[1000:1200] += 200 * np.sin(np.arange(200))
    w[2000:2200] += 300 * np.sin(np.arange(200))
    df = flagged(spark, x).join(trace(spark, w).select("trace_id", "idx", F.col("v").alias("w")), ["trace_id", "idx"])
    got = {r.s: r.verdict for r in restore.guard(segs(spark, (1000, 1199), (2000, 2199), (3000, 3199)), df, "v", "w", "bad", SR).collect()}
    assert got == {1000: "kept", 2000: "energy", 3000: "alive"}


def test_edges_fade(spark):
    x = np.arange(1000, dtype=float) + 10
    df = flagged(spark, x).withColumn("w", F.lit(0.0))
    got = {r.idx: r.w for r in restore.crossfaded(segs(spark, (400, 599)), df, "v", "w", "bad", SR).collect()}
    assert got[400] == pytest.approx(410) and got[599] == pytest.approx(609) and got[449] == 0 and got[500] == 0 and len(got) == 200
    assert got[405] == pytest.approx(415 * (1 - 5 / 49))
    tiny = {r.idx: r.w for r in restore.crossfaded(segs(spark, (5, 9)), df, "v", "w", "bad", SR).collect()}
    assert set(tiny.values()) == {0.0}


def test_longest_run_across_buckets(spark):
    rows = segments.longest_run(segs(spark, (0, 9000), (20000, 20001)), segs(spark, (4000, 4200), (8990, 9100)).drop("kind"))
    assert {r.s: r.max_run for r in rows.collect()} == {0: 201, 20000: 0}


def test_composite_repairs_by_kind(spark):
    x = quiet(12000, 6)
    x[2000:2002] = -1
    x[3000:3010] = 0
    x[5000:5600] = -1
    x[8000] = 900
    x[10500:10800] = x[10500]
    x[10600:10605] = -1
    out, catalog = composite(trace(spark, x), Detection(), Repair())
    rows = sorted(out.collect(), key=lambda r: r.idx)
    w = np.array([r.w for r in rows])
    assert len(rows) == 12000 and w.min() >= 1 and abs(w[3005] - 450) < 10 and abs(w[2000] - 450) < 10 and abs(w[8000] - 450) < 20
    assert abs(w[5000:5600].mean() - 450) < 15 and w[5000:5600].std() < 12
    assert set(w[10500:10800]) == {x[10500]}  # what is frozen stays, and only what is missing in it is filled
    assert all(r.v == r.w or r.how for r in rows) and {r.how for r in rows} == {None, "repair"}
    listed = {i for r in catalog.collect() for i in range(r.s, r.e + 1)}
    assert len(set(np.flatnonzero(w != x).tolist()) - listed) <= 3  # single spikes of the noise
    assert {r.method for r in catalog.collect()} >= {"core", "missing_runs"} and catalog.where("role = 'repair'").count() >= 3


def test_only_the_catalog_makes_events(spark):
    from tracewright.plans.composite import found_segments

    x = quiet(9000, 3)
    n = np.arange(2000)
    x[3000:5000] += np.round(150 * np.exp(-n / 500) * np.sin(n / 4))
    x[7000:7040] = -1
    ts = F.timestamp_seconds(F.lit(1_000_000) + F.col("idx") / SR)
    df = trace(spark, x).withColumn("ts", ts).cache()
    _, alone = found_segments(df, Detection())
    at = spark.range(1).select(F.timestamp_seconds(F.lit(1_000_000 + 3000 / SR)).alias("event_ts"))
    _, seen = found_segments(df, Detection(), at)
    _, unseen = found_segments(df, Detection(), at.select((F.col("event_ts") + F.expr("INTERVAL 9 HOURS")).alias("event_ts")))
    roles = lambda found: {(r.role, r.kind) for r in found.where("s < 5000 AND e > 3000").collect()}
    assert roles(alone) and "event" not in {role for role, _ in roles(unseen)} and roles(seen) <= {("event", "event"), ("repair", "spike")}
    assert (("event", "event") in roles(seen)) == bool({kind for _, kind in roles(alone)} - {"spike"})
    rest = lambda found: {tuple(r) for r in found.where("e < 2900").collect()}
    assert rest(seen) == rest(unseen) == rest(alone)


def test_spikes_are_told(spark):
    x = quiet(1500, 7)
    x[700], x[300:304] = 900, -1
    out = {r.idx: r for r in repaired(trace(spark, x))[0].collect()}
    assert out[700].spike and not out[301].spike and all(r.v == r.w or r.spike or 300 <= i < 304 for i, r in out.items())


def test_levels_and_cluster_bootstrap(spark):
    rows = [(u, u % 4, float(u % 7), float(u % 5)) for u in range(40)]
    df = spark.createDataFrame(rows, "unit int, record int, one double, other double")
    got = {r.level: r for r in stats.levels(df, {"unit": ["unit"], "record": ["record"]}).collect()}
    d = np.array([a - b for _, _, a, b in rows])
    assert got["unit"].n == 40 and got["unit"].share_better == pytest.approx((d < 0).mean()) and got["record"].n == 4 and got["record"].floor == 2 / 16
    few = stats.cluster_bootstrap(df.where("record < 2").withColumn("g", F.lit(1)), ["g"], "record", "one", 50).first()
    assert few.low is None and few.clusters == 2
    four = stats.cluster_bootstrap(df.withColumn("g", F.lit(1)), ["g"], "record", "one", 500).first()
    middles = sorted(np.median([a for u, r, a, b in rows if r == k]) for k in range(4))
    assert middles[0] <= four.low <= four.high <= middles[-1]


def test_sizes_known_changes_and_retention(spark):
    a = trace(spark, [1, 2, 3])
    assert [(r.n_raw, r.n_repaired, r.same) for r in metrics.sizes(a, a.where("idx < 2")).collect()] == [(3, 2, False)]
    df = a.withColumn("w", F.when(F.col("idx") == 1, 9.0).otherwise(F.col("v")))
    known = spark.createDataFrame([("t", 0, 2, 1), ("t", 7, 9, 0), ("u", 0, 1, 4)], "trace_id string, s long, e long, expected long")
    assert {(r.trace_id, r.s): (r.changed, r.as_expected) for r in metrics.against_known(df, known, "v", "w").collect()} == {("t", 0): (1, True), ("t", 7): (0, True), ("u", 0): (0, False)}
    x = quiet(2000, 8, 0.0)
    x[1000:1040] += 80
    rows = trace(spark, x).withColumn("flat", F.lit(0.0))
    found = triggers.onsets(rows, ["v", "flat"], [5.0], 0.6, 6, 198)
    out = {r.series: r for r in triggers.retention(found, segs(spark, (900, 1100)), "v", ["v", "flat"], [5.0]).collect()}
    assert out["v"].mean == 1 and out["v"].retained_pct == 100 and out["flat"].mean == 0 and out["flat"].retained_pct == 0


def test_interval_helpers(spark):
    assert ranges.overlapping(segs(spark, (0, 5)), segs(spark, (5, 6)), "left_semi").count() == 1
    assert [(r.s, r.e) for r in runs.merged_overlapping(segs(spark, (0, 5), (5, 9), (11, 12))).orderBy("s").collect()] == [(0, 9), (11, 12)]
