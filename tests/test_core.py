"""Operators on hand-made traces, edge cases, and the registered queries against their SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tracewright.config import Detection, Repair
from tracewright.functions import kernels
from tracewright.operators import fill, masks, metrics, ranges, rolling, runs, segments, stats, triggers
from tracewright.plans.pipeline import repaired
from tracewright.plans.replace import replaced, written_back
from tracewright.sources import catalogs, names
from tracewright.streaming import monitor

SF = "/root/testdata/sf0.001"


def trace(spark, values, trace_id="t"):
    return spark.createDataFrame([(trace_id, i, None if v is None else float(v)) for i, v in enumerate(values)], "trace_id string, idx long, v double")


def spans(df):
    return sorted((r.s, r.e) for r in df.collect())


def test_runs_across_chunks_and_edges(spark):
    rng = np.random.default_rng(0)
    flags = rng.random(500) < 0.6
    flags[:3], flags[-2:], flags[100:200] = True, True, True
    df = trace(spark, flags).withColumn("f", F.col("v") == 1)
    expected, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            expected.append((start, i - 1))
            start = None
    assert spans(runs.state_runs(df, "f", chunk=16).where("state")) == expected == spans(runs.runs(df, "f"))
    assert spans(runs.runs(df.where("idx < 0"), "f")) == [] and spans(runs.runs(df.withColumn("f", F.lit(None).cast("boolean")), "f")) == []


@pytest.mark.parametrize(("width", "n"), [(5, 40), (13, 7), (6, 3), (60, 90), (61, 20)])
def test_rolling_edges(spark, width, n):
    rng = np.random.default_rng(width)
    x = rng.normal(size=n)
    before, after = width // 2, (width - 1) // 2
    df = trace(spark, x)
    wide = np.pad(x, (before, after), mode="symmetric") if n >= before else np.array([x[(k if (k // n) % 2 == 0 else -1 - k) % n] for k in range(-before, n + after)])
    mean = [r.m for r in rolling.rolling_mean(df, "v", width, "m").orderBy("idx").collect()]
    assert mean == pytest.approx([wide[i : i + width].mean() for i in range(n)])
    box = [r.m for r in rolling.boxcar(df, "v", width, "m").orderBy("idx").collect()]
    zeros = np.pad(x, (before, after))
    assert box == pytest.approx([zeros[i : i + width].mean() for i in range(n)])
    if width % 2:
        edge = np.pad(x, width // 2, mode="edge")
        med = [r.m for r in rolling.rolling_median(df, "v", width, "m", "edge").orderBy("idx").collect()]
        assert med == pytest.approx([np.median(edge[i : i + width]) for i in range(n)])
    short = rolling.rolling_sum(df, "v", before, after, "m", "reflect", chunk=8).orderBy("idx").collect()
    assert [r.m / width for r in short] == pytest.approx(mean)


def test_merges_and_pads(spark):
    segs = spark.createDataFrame([("t", 0, 4, "a"), ("t", 4, 9, "b"), ("t", 15, 20, "c"), ("t", 25, 26, "d")], "trace_id string, s long, e long, kind string")
    assert spans(runs.merged(segs, 5)) == [(0, 9), (15, 26)] and spans(runs.merged(segs, 6)) == [(0, 26)]
    assert {(r.s, r.e, r.kind) for r in runs.merged_overlapping(segs).collect()} == {(0, 9, "a"), (15, 20, "c"), (25, 26, "d")}
    n = spark.createDataFrame([("t", 30)], "trace_id string, n long")
    assert spans(runs.padded(segs, n, 1.0, 10.0, 2, 6)) == [(0, 6), (2, 11), (13, 22), (23, 28)]
    assert spans(ranges.covered(segs, segs.where("kind = 'a'").withColumn("e", F.lit(10)), "left_anti")) == [(15, 20), (25, 26)]


def test_interval_relations_by_brute_force(spark):
    rng = np.random.default_rng(21)
    make = lambda n: [(str(rng.integers(3)), int(a), int(a + rng.integers(0, 12))) for a in rng.integers(0, 80, n)]
    left, right = [*make(120), (None, 1, 2)], [*make(15), (None, 0, 9)]
    table = lambda rows: spark.createDataFrame(rows, "trace_id string, s long, e long").repartition(3)
    for f, meets in ((ranges.overlapping, lambda x, y: x[1] <= y[2] and y[1] <= x[2]), (ranges.covered, lambda x, y: y[1] <= x[1] and x[2] <= y[2])):
        for how in ("left_semi", "left_anti"):
            expected = [x for x in left if any(x[0] is not None and x[0] == y[0] and meets(x, y) for y in right) == (how == "left_semi")]
            assert sorted(map(str, map(tuple, f(table(left), table(right), how).collect()))) == sorted(map(str, expected))


def test_oscillation_is_livelier_than_its_surroundings(spark):
    from tracewright.operators import windows

    rng = np.random.default_rng(22)
    x = np.concatenate([rng.normal(0, 1, 200), rng.normal(0, 9, 100), rng.normal(0, 1, 200), [0] * 40, [500] * 40, [0] * 40, rng.normal(0, 1, 200)])
    segs = spark.createDataFrame([("t", 200, 249), ("t", 252, 299), ("t", 540, 579), ("t", 700, 710), ("t", 720, 760)], "trace_id string, s long, e long")
    out = {(r.s, r.e, r.total): r.swings for r in windows.oscillation_clusters(segs, trace(spark, x).withColumnRenamed("v", "x"), 11, 35, 150).collect()}
    assert out == {(200, 299, 98): True, (540, 579, 40): False, (700, 760, 52): False}


def test_masks(spark):
    assert [r.m for r in trace(spark, [-1, 0, 5, float("nan"), float("inf"), None]).select(masks.missing_counts(F.col("v")).alias("m")).collect()] == [True, True, False, True, True, True]
    flat = [7.0] * 40 + [1.0, 2.0] * 5 + [9.0] * 10
    assert spans(masks.freeze_runs(trace(spark, flat), Detection(sr=1.0))) == [(0, 39)]
    x = np.random.default_rng(1).normal(size=200)
    x[77] += 50
    assert [r.idx for r in masks.spike(trace(spark, x), Detection(), "v").where("spike").collect()] == [77]
    y = np.concatenate([np.zeros(50), np.full(50, 100.0)]) + np.random.default_rng(2).normal(size=100)
    assert sorted(r.idx for r in masks.step(trace(spark, y), Detection(), "v").where("step").collect()) == [49, 50]
    assert masks.mad_outliers(trace(spark, [3.0] * 10), "v", 3, "o").where("o").count() == 0


def test_fills(spark):
    df = trace(spark, [0, 0, 4, 6, 0, 0, 12, 0]).withColumn("bad", F.col("v") == 0)
    assert [r.w for r in fill.clamped_fill(df, "bad", "v", "w").orderBy("idx").collect()] == [4, 4, 4, 6, 8, 10, 12, 12]
    seg = fill.segment_fill(df.withColumn("seg_id", F.lit(1)), "bad", "v", "w").orderBy("idx").collect()
    assert [r.w for r in seg] == pytest.approx([0, 2, 4, 6, 8, 10, 12, 14])
    none = fill.clamped_fill(df.withColumn("bad", F.lit(True)), "bad", "v", "w")
    assert none.where("w IS NOT NULL").count() == 0


def test_grading(spark):
    rows = spark.createDataFrame([("freeze", 0.0, 0), ("zero", 0.4, 5), ("zero", 0.9, 2), ("zero", 0.9, 20), ("zero", 0.9, 21), ("spike", 0.1, 0), ("step", 0.1, 0)], "kind string, missing_share double, max_run long")
    assert [r.g for r in rows.select(segments.graded(Repair()).alias("g")).collect()] == ["freeze_missing", "missing_runs", "linear", "zscore", "core", "spike", "core"]


def test_metrics(spark):
    a, b = spark.createDataFrame([(1, float(v)) for v in (0, 1, 3)], "k int, v double"), spark.createDataFrame([(1, float(v)) for v in (5, 6, 8)], "k int, v double")
    assert metrics.wasserstein(a, b, ["k"]).first().wasserstein == pytest.approx(5)
    x = np.random.default_rng(3).normal(size=60)
    acf = {r.lag: r.acf for r in metrics.autocorrelation(trace(spark, x), "v", 5).collect()}
    z = x - x.mean()
    assert [acf[k] for k in range(5)] == pytest.approx([(z[k:] @ z[: 60 - k]) / (z @ z) for k in range(5)])


def test_statistics(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, -2.0, 2.0, 3.0, 0.0, -0.5, 4.0])], "g int, unit int, d double")
    r = stats.signed_ranks(d, ["g"]).first()
    assert (r.w_plus, r.w_minus, r.n) == (2 + 3.5 + 5 + 6, 3.5 + 1, 6) and r.rank_biserial == pytest.approx(12 / 21)
    p = spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.04), (1, "c", 0.03), (1, "d", None)], "g int, u string, p double")
    assert {x.u: x.holm for x in stats.holm(p, ["g"], "p", ["u"]).collect()} == {"a": pytest.approx(0.03), "c": pytest.approx(0.06), "b": pytest.approx(0.06), "d": None}
    flips = [abs(sum(x * (1 if m >> i & 1 else -1) for i, x in enumerate([1.0, -2.0, 2.0, 3.0, -0.5, 4.0]))) for m in range(64)]
    exact = (sum(t >= 7.5 - 1e-12 for t in flips) + 1) / 65
    assert stats.sign_flips(d, ["g"], "unit").first().p == pytest.approx(exact)
    assert stats.sign_flips(d, ["g"], "unit", draws=20_000, exact_up_to=0).first().p == pytest.approx(exact, abs=0.02)
    assert stats.sign_flips(d.where("unit < 5"), ["g"], "unit").first().p is None
    row = stats.signed_ranks(d.withColumn("d", F.col("d") * (1 + F.col("unit") / 100)), ["g"]).select(stats.wilcoxon_p("w_plus", "n", "ties").alias("p"), stats.wilcoxon_p_less("w_plus", "n", "ties").alias("less"), "w_plus").first()
    sums = [sum(k + 1 for k in range(6) if m >> k & 1) for m in range(64)]
    assert row.p == pytest.approx(2 * min(sum(x >= row.w_plus for x in sums), sum(x <= row.w_plus for x in sums)) / 64) and row.less == pytest.approx(sum(x <= row.w_plus for x in sums) / 64)
    assert stats._wilcoxon(600.0, 60, 0.0, False) == pytest.approx(math.erfc(abs(600 - 915) / math.sqrt(60 * 61 * 121 / 24) / math.sqrt(2)))
    few = stats.bootstrap_mean(d.where("unit < 2"), ["g"], "unit", "d", draws=20).first()
    assert few.low is None and stats.bootstrap_mean(d, ["g"], "unit", "d", draws=500).first().low < 1.07 and stats.POISSON[6] == pytest.approx(0.9999167588507119) and len(stats.POISSON) > 12


def test_triggers(spark):
    r = [0, 2, 6, 4, 2, 6, 1, 0, 7, 7]
    assert spans(triggers.hysteresis(trace(spark, r), "v", 5, 3)) == [(2, 3), (5, 5), (8, 9)]
    found = spark.createDataFrame([("t", 8, 12), ("t", 30, 30)], "trace_id string, s long, e long")
    centres = spark.createDataFrame([("t", 9), ("t", 11), ("t", 50)], "trace_id string, c long")
    assert {(x.c, x.s) for x in triggers.matched(found, centres, 5).collect()} == {(9, 8), (11, None), (50, None)}
    # the first one within reach, not the nearest; each is taken once
    found = spark.createDataFrame([("t", 6, 6), ("t", 10, 10), ("t", 14, 14), ("u", 100, 100)], "trace_id string, s long, e long")
    centres = spark.createDataFrame([("t", 10), ("t", 11), ("t", 12), ("t", 13), ("u", 10), ("v", 10)], "trace_id string, c long")
    assert {(x.trace_id, x.c, x.s) for x in triggers.matched(found, centres, 5).collect()} == {("t", 10, 6), ("t", 11, 10), ("t", 12, 14), ("t", 13, None), ("u", 10, None), ("v", 10, None)}
    assert {(x.trace_id, x.keep_rate, x.false_rate) for x in triggers.rates(found, centres, 5).collect()} == {("t", 0.75, 0.0), ("u", 0.0, 1.0), ("v", 0.0, None)}


def test_names(spark):
    rows = [("XA.S12.19760113.mseed",), ("XA.S12.01.MHZ.19760113_070152-19760113_190149.MSEED",), ("XA.S12.01.MHZ.mseed",), ("XA.S12.1976011.mseed",), ("XA..19760113.mseed",), ("a.txt",), (None,)]
    out = names.parsed(spark.createDataFrame(rows, "name string")).collect()
    assert [(r.sta, r["loc"], r.cha, r.day) for r in out[:2]] == [("S12", "", "", "19760113"), ("S12", "01", "MHZ", "19760113")] and all(r.day is None for r in out[2:])


def test_counterparts(spark):
    df = lambda rows: names.parsed(spark.createDataFrame(rows, "path string, rel string, name string"))
    n = "XA.S12.19760113.mseed"
    left = df([("/r/a/" + n, "a/" + n, n), ("/r/b/XA.S13.19760201.mseed", "b/XA.S13.19760201.mseed", "XA.S13.19760201.mseed")])
    right = df([("/f/a/" + n, "a/" + n, n), ("/f/z/XA.S13.00.MHZ.19760201-x.mseed", "z/XA.S13.00.MHZ.19760201-x.mseed", "XA.S13.00.MHZ.19760201-x.mseed")])
    assert {r.path: r.counterpart for r in names.counterparts(left, right).collect()} == {"/r/a/" + n: "/f/a/" + n, "/r/b/XA.S13.19760201.mseed": "/f/z/XA.S13.00.MHZ.19760201-x.mseed"}


def test_event_times(spark):
    rows = [("6911202217",), ("7601130705",), ("7613010000",), ("x",), (None,), ("7601130705",)]
    assert sorted(str(r.event_ts) for r in catalogs.event_times(spark.createDataFrame(rows, "Date string")).collect()) == ["1976-01-13 07:05:00", "2069-11-20 22:17:00"]


def test_day_replacement(spark):
    cols = "station string, day string, s long, e long, kind string, method string, note string"
    old = spark.createDataFrame([("S1", "d1", 0, 5, "repair", "core", ""), ("S1", "d2", 0, 5, "repair", "core", "")], cols)
    new = spark.createDataFrame([("S1", "d1", 3, 9, "repair", "linear", "a"), ("S1", "d1", 50, 60, "repair", "core", "b")], cols)
    manual = spark.createDataFrame([("S1", "d1", 9, 12)], "station string, day string, s long, e long")
    assert {(r.day, r.s, r.method, r.note) for r in catalogs.day_replaced(old, new, manual).collect()} == {("d2", 0, "core", ""), ("d1", 3, "manual_apply", "a | manual apply"), ("d1", 50, "core", "b")}


def test_kernels():
    x = np.random.default_rng(4).normal(size=1024)
    psd = kernels.welch(x, 10.0, 1024)
    assert psd.sum() * 10 / 1024 == pytest.approx(x.var(), rel=0.15)
    t = np.arange(400)
    assert np.abs(kernels.analytic(np.cos(2 * np.pi * t / 20)))[50:350] == pytest.approx(np.ones(300), abs=1e-6)
    k = np.array([0.0, 1, 2, 5, 6])
    assert kernels.pchip(k, 2 * k + 1, np.array([0.5, 3, 7])) == pytest.approx([2, 7, 15]) and kernels.cubic_spline(k, 2 * k + 1, np.array([0.5, 3])) == pytest.approx([2, 7])
    wave = np.sin(t / 9)
    assert np.abs(kernels.autoregressive(wave[100:200], wave[220:320], 20) - wave[200:220]).max() < 0.1
    hole = np.zeros(400, bool)
    hole[200:230] = True
    assert np.abs(kernels.singular_spectrum(wave, hole, 60, 4, 100) - wave)[hole].max() < 0.3


def test_replacement_changes_only_its_segment(spark):
    rng = np.random.default_rng(5)
    x = np.round(500 + 20 * np.sin(np.arange(6000) / 15) + rng.normal(size=6000))
    x[2500:3100] = 0
    df = trace(spark, x).withColumn("bad", F.col("v") == 0)
    segs = spark.createDataFrame([("t", 2500, 3099, "core")], "trace_id string, s long, e long, method string")
    values, report = replaced(df, segs, 6.625, quantize=True)
    out = written_back(df, values).orderBy("idx").collect()
    w = np.array([r.w for r in out])
    assert (np.delete(w, np.s_[2500:3100]) == np.delete(x, np.s_[2500:3100])).all() and (w[2500:3100] == np.rint(w[2500:3100])).all()
    seg = w[2500:3100]
    assert abs(seg.mean() - 500) < 5 and 0.5 < seg.std() / x[:2500].std() < 1.5 and abs(seg[0] - x[2499]) < 15
    assert report.first().method == "core" and sorted(values.collect()) == sorted(replaced(df, segs, 6.625, quantize=True)[0].collect())


def test_pipeline_protects_and_repairs(spark):
    rng = np.random.default_rng(6)
    x = np.round(450 + 3 * rng.normal(size=3000))
    x[100:102], x[300:310], x[1000:1200], x[2000:2010] = 0, -1, 0, 0
    safe = spark.createDataFrame([("t", 1990, 2030)], "trace_id string, s long, e long")
    out, catalog = repaired(trace(spark, x), protected=safe)
    w = np.array([r.w for r in out.orderBy("idx").collect()])
    assert (w[1990:2031] == x[1990:2031]).all() and (np.delete(w, np.s_[1990:2031]) > 0).all()
    assert {(r.s, r.e, r.method) for r in catalog.collect()} == {(100, 101, "linear"), (300, 309, "zscore"), (1000, 1199, "core"), (1990, 2030, "catalog_protect")}


def test_stream_finds_the_runs_of_the_batch(spark, tmp_path):
    rows = [("t", i, 10 <= i < 20 or 55 <= i < 61) for i in range(100)]
    for k in range(4):
        spark.createDataFrame(rows[25 * k : 25 * k + 25], "trace_id string, idx long, missing boolean").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("trace_id string, idx long, missing boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = monitor.missing_runs(stream).writeStream.format("memory").queryName("found_runs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spans(spark.table("found_runs")) == [(10, 19), (55, 60)]


NAMES = [n for n in __spark_entry__.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "orders lineitem events embeddings part supplier".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.5f}" if isinstance(v, float) else f"{float(v):.5f}" if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v).replace("-0.00000", "0.00000") for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    sql = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(tuple(r) for r in df.select(*columns).collect()) == canonical(sql.fetchall())


def test_settings():
    from tracewright.config import settings

    s = settings({"zscore": "100", "linear_max": "3.7", "quantize": "no", "spike_k": "x", "unknown": 1, "missing_share": float("nan")})
    assert (s.zscore, s.linear_max, s.quantize, s.spike_k, s.missing_share) == (20.0, 3, False, 8.0, 0.30)


def test_local_outlier_factor(spark):
    from tracewright.operators import outliers

    x, k = np.random.default_rng(8).normal(size=60), 5
    d = np.abs(np.subtract.outer(x, x))
    near = [np.argsort(d[i], kind="stable")[1 : k + 1] for i in range(60)]
    far = np.array([d[i][near[i][-1]] for i in range(60)])
    density = np.array([1 / np.mean([max(far[j], d[i, j]) for j in near[i]]) for i in range(60)])
    expected = [np.mean(density[near[i]]) / density[i] for i in range(60)]
    got = [r.lof for r in outliers.local_outlier_factor(trace(spark, x), "v", k).orderBy("idx").collect()]
    assert got == pytest.approx(expected)
    assert outliers.local_outlier_factor(trace(spark, [1.0]), "v", k).first().lof == 1


def test_isolation(spark):
    from tracewright.operators import outliers

    x = np.random.default_rng(9).normal(size=400)
    x[123] = 40
    out = outliers.isolated(trace(spark, x), "v", 0.005)
    assert [r.idx for r in out.where("isolated").collect()][0:1] and 123 in {r.idx for r in out.where("isolated").collect()} and out.count() == 400


def test_outliers_over_whole_traces(spark):
    from tracewright.operators import outliers

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=300), np.full(200, 0.5), rng.normal(5, 0.1, size=7)]) + np.arange(507) * 1e-7
    rows = trace(spark, x)
    ranks = [r["rank"] for r in outliers.value_ranks(rows, "v", "rank", buckets=8, chunk=50).orderBy("idx").collect()]
    assert ranks == np.argsort(np.argsort(x, kind="stable")).tolist()
    flat = outliers.value_ranks(trace(spark, [1.0, 2.0, 1.0, 1.0, 0.0] * 40), "v", "rank", buckets=8, chunk=30).orderBy("v", "idx").collect()
    assert [r["rank"] for r in flat] == list(range(200))
    whole, cut = ([r.lof for r in outliers.local_outlier_factor(rows, "v", 5, chunk).orderBy("idx").collect()] for chunk in (3000, 40))
    assert len(cut) == 507 and cut == pytest.approx(whole, rel=1e-9)
    y = rng.normal(size=400)
    y[:4] = [40, -45, 50, -55]
    found = outliers.isolated(trace(spark, y), "v", 0.01, chunk=100).where("isolated").collect()
    assert {0, 1, 2, 3} == {r.idx for r in found}


def test_constant_and_missing_sides(spark):
    flat = spark.createDataFrame([("t", 0, 5.0, 5.0), ("t", 1, 5.0, 6.0)], "trace_id string, idx long, a double, b double")
    r = flat.agg(*(c.alias(n) for n, c in metrics.errors("a", "b").items())).first()
    assert r.energy_ratio is None and r.std_ratio is None and r.rmse == pytest.approx(math.sqrt(0.5))
    a, b = spark.createDataFrame([(1, 0.0), (2, 1.0)], "k int, v double"), spark.createDataFrame([(1, 2.0)], "k int, v double")
    assert {x.k: x.wasserstein for x in metrics.wasserstein(a, b, ["k"]).collect()} == {1: 2.0, 2: None}
    base = spark.createDataFrame([(1, "n", 0.0), (1, "a", 2.0)], "u int, m string, v double")
    assert {x.change_pct for x in stats.against_baseline(base, ["u"], "m", "v", "n").collect()} == {None}
