"""Repairs in an order, anomaly runs, ordered merges, stores and catalogs: against plain versions on made traces."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import anomalies, restore, runs
from tracewright.operators.storage import cleanup, fresh_path, settled
from tracewright.plans import rounds
from tracewright.sources import catalogs, names
from tracewright.sources.store import CatalogStore, SampleStore

SR = 1.0


def samples(spark, traces: dict, bad: dict):
    rows = [(t, i, float(v), i in bad.get(t, ())) for t, x in traces.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "trace_id string, idx long, v double, bad boolean").repartition(3)


def test_levels_are_places_in_islands(spark):
    tasks = [("a", 0, 9, 0), ("a", 15, 20, 0), ("a", 29, 30, 0), ("a", 60, 61, 0), ("a", 5, 6, 1), ("b", 15, 20, 0)]
    got = rounds.leveled(spark.createDataFrame(tasks, "trace_id string, s long, e long, round int"), 10).collect()
    assert {(r.trace_id, r.s, r.round): r.level for r in got} == {("a", 0, 0): 0, ("a", 15, 0): 1, ("a", 29, 0): 2, ("a", 60, 0): 0, ("a", 5, 1): 0, ("b", 15, 0): 0}


def plain_rounds(x, bad, tasks, events, gap, least, most):
    """One task after the other: the median of both references, in which later tasks and events stand at the level of their surroundings."""
    v, bad = np.array(x, float), np.array(bad)
    reach, whole, out = int(most) + gap, float(np.median(np.array(x, float)[~bad])), {}
    for k, (s, e) in enumerate(tasks):
        shown, there = v.copy(), ~bad
        for a, b in [*tasks[k + 1 :], *events]:
            a, b = max(a, s - reach, 0), min(b, e + reach)
            if a > b:
                continue
            near = np.r_[max(a - reach, 0) : a, b + 1 : min(b + reach + 1, len(v))]
            near = v[near][~bad[near]]
            shown[a : b + 1] = np.median(near) if len(near) >= 8 else whole
            there[a : b + 1] = True
        ref = int(np.rint(min(max((e - s + 1) * 0.5, least), most)))
        at = np.r_[max(0, s - gap - ref) : max(0, s - gap), min(len(v), e + 1 + gap) : min(len(v), e + gap + ref + 1)]
        seen = shown[at][there[at]]
        if len(seen):
            v[s : e + 1], bad[s : e + 1] = np.median(seen), False
            out[s] = float(np.median(seen))
    return out


def test_later_repairs_see_earlier_ones(spark):
    rng = np.random.default_rng(2)
    traces = {t: np.round(rng.normal(500, 9, 6000) + np.arange(6000) / 40) for t in "ab"}
    chains = {"a": [(1000, 1059), (1150, 1249), (1300, 1399), (4000, 4100)], "b": [(0, 40), (130, 180), (5900, 5999)]}
    missing = {"a": set(range(1000, 1060)) | set(range(1170, 1230)) | set(range(1300, 1400)), "b": set(range(0, 41)) | set(range(5900, 6000))}
    walls = {"a": [(1420, 1500)], "b": []}
    df = settled(samples(spark, traces, missing))
    tasks = spark.createDataFrame([(t, s, e, 0) for t, c in chains.items() for s, e in c], "trace_id string, s long, e long, round int")
    events = spark.createDataFrame([(t, s, e) for t, c in walls.items() for s, e in c], "trace_id string, s long, e long")
    values, _ = rounds.in_rounds(df, tasks, events, rounds.at_reference_level, SR)
    got = {(r.trace_id, r.s): r.w for r in values.groupBy("trace_id", "s").agg(F.max("w").alias("w")).collect()}
    for t in traces:
        bad = np.zeros(6000, bool)
        bad[list(missing[t])] = True
        want = plain_rounds(traces[t], bad, chains[t], walls[t], 1, 120.0, 600.0)
        assert {s: got[t, s] for s, _ in chains[t]} == pytest.approx(want)
        alone = {c[0]: plain_rounds(traces[t], bad, [c], walls[t], 1, 120.0, 600.0)[c[0]] for c in chains[t]}
        assert alone != pytest.approx(want)  # the order matters here
    assert values.select("step").distinct().count() == 3  # islands of both traces go forward together
    done = rounds.applied(df, values)
    held = {(t, i) for t, c in chains.items() for s, e in c for i in range(s, e + 1)}
    assert {(r.trace_id, r.idx) for r in done.where("w <> v").collect()} <= held and done.count() == 12_000
    none, _ = rounds.in_rounds(df, tasks.limit(0), events, rounds.at_reference_level, SR)
    assert none.count() == 0


def test_realigned_segments(spark):
    x = np.r_[np.full(300, 100.0) + np.tile([0, 1], 150), np.linspace(180, 260, 100) + np.tile([5, -5], 50), np.full(300, 104.0) + np.tile([0, 1], 150)]
    df = samples(spark, {"t": x}, {}).withColumn("w", F.col("v"))
    seg = spark.createDataFrame([("t", 300, 399, 1.5, 3.0)], "trace_id string, s long, e long, around_std double, most_std double")
    got = np.array([r.w for r in restore.realigned(seg, df, "v", "w", "bad", 1.0).orderBy("idx").collect()])
    t, y = np.arange(100) / 99, x[300:400]
    left, right = np.median(x[255:300]), np.median(x[435:480])
    line = left + (right - left if abs(right - left) < 3.0 else 0) * t
    z = y - np.polyval(np.polyfit(t, y, 1), t) + line
    z = line + (z - line) * min(1, 3.0 / z.std())
    assert got == pytest.approx(z)
    assert abs(got.std() - 3.0) < 0.1 and abs(np.median(got) - 100.5) < 1


def plain_anomalies(v, bad, s, e, sr):
    seg, ok = v[s : e + 1], ~bad[s : e + 1]
    if ok.sum() < 10:
        return []
    med = float(np.median(seg[ok]))
    thr, w = max(med * 0.08, 15.0), max(3, int(sr))
    off = np.flatnonzero(ok & (np.abs(seg - med) > thr))
    found = []
    for i in off:
        if found and i - found[-1][1] <= 30:
            found[-1][1] = i
        else:
            found.append([i, i])

    def alive(a, b):
        x = seg[a : b + 1][ok[a : b + 1]]
        return len(x) >= 2 and (x.max() - x.min() > 12 or abs(np.median(x) - med) > max(thr / 2, 8))

    for r in found:
        while r[0] > 0 and alive(max(0, r[0] - w), r[0] - 1):
            r[0] = max(0, r[0] - w)
        while r[1] < len(seg) - 1 and alive(r[1] + 1, min(len(seg) - 1, r[1] + w)):
            r[1] = min(len(seg) - 1, r[1] + w)
    for gap in (1, int(8 * sr) + 1):
        out = []
        for a, b in found:
            if out and a <= out[-1][1] + gap:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        found = out
    return [(s + int(a), s + int(b)) for a, b in found]


@pytest.mark.parametrize("first", [1, 16])
def test_anomaly_runs_with_tails_over_blocks(spark, first):
    rng = np.random.default_rng(4)
    x = np.round(480 + rng.normal(0, 2, 9000))
    for at, size, decay in ((700, 300, 200), (2500, 90, 15), (2600, -120, 60), (5000, 60, 4000), (8990, 200, 10)):
        n = np.arange(9000 - at)
        x[at:] += np.round(size * np.exp(-n / decay) * np.cos(n / 3))
    bad = np.zeros(9000, bool)
    bad[rng.integers(0, 9000, 900)] = True
    bad[8000:8300] = True
    segs = [(0, 2399), (2400, 4500), (4501, 4505), (4600, 8500), (8600, 8999)]
    df = samples(spark, {"t": x}, {"t": set(np.flatnonzero(bad).tolist())})
    got = anomalies.anomaly_runs(df, spark.createDataFrame([("t", s, e) for s, e in segs], "trace_id string, s long, e long"), 6.625, first=first).collect()
    want = {(s, r) for s, e in segs for r in plain_anomalies(x, bad, s, e, 6.625)}
    assert {(r.seg_s, (r.s, r.e)) for r in got} == want and max(b - a for _, (a, b) in want) > 600


def plain_merge(segs, joins):
    out = []
    for s, e in sorted(segs):
        if out and joins(out[-1], (s, e)):
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


@pytest.mark.parametrize("chunk", [50, 1000, 1 << 13])
def test_ordered_merges_don_t_depend_on_chunks(spark, chunk):
    rng = random.Random(chunk)
    segs, at = {}, 0
    for t in ("a", "b"):
        segs[t], at = [], 0
        for _ in range(120):
            at += rng.choice([3, 8, 15, 40, 70, 200])
            segs[t].append((at, at + rng.choice([0, 5, 30])))
            at = segs[t][-1][1] + 1
    df = spark.createDataFrame([(t, s, e) for t, x in segs.items() for s, e in x], "trace_id string, s long, e long").repartition(3)
    ref = lambda n: min(max(n * 0.5, 6.0), 30.0)
    by_need = lambda a, b: b[0] - a[1] - 1 < ref(a[1] - a[0] + 1) + ref(b[1] - b[0] + 1) + 2
    got = runs.merged_by_need(df, 1.0, 6.0, 30.0, chunk=chunk).collect()
    for t, x in segs.items():
        units = plain_merge(x, by_need)
        assert sorted((r.s, r.e) for r in got if r.trace_id == t) == x
        assert {(r.m_s, r.m_e) for r in got if r.trace_id == t} == set(units) and len(units) < len(x)
        assert all(r.m_s <= r.s and r.e <= r.m_e for r in got)
    by_ref = lambda a, b: b[0] - a[1] <= int(ref(a[1] - a[0] + 1)) and max(a[1], b[1]) - a[0] + 1 <= 90
    merged = runs.merged_by_reference(df, 1.0, 6.0, 30.0, 0.5, 90.0, chunk).collect()
    assert {t: sorted((r.s, r.e) for r in merged if r.trace_id == t) for t in segs} == {t: plain_merge(x, by_ref) for t, x in segs.items()}


def parts(path):
    return {os.path.join(d, f) for d, _, names_ in os.walk(path) for f in names_ if f.endswith(".parquet")}


def test_write_back_leaves_untouched_files_alone(spark, tmp_path):
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "01").otherwise("b c").alias("trace_id"), F.floor(F.col("id") / 2).alias("idx"), (F.col("id") * 1.5).alias("v"))
    store = SampleStore(spark, str(tmp_path / "store"), block=100)
    store.append(df)
    before = parts(store.path)
    ranges = spark.createDataFrame([("01", 95, 104)], "trace_id string, s long, e long")
    store.write_back(df.select("trace_id", "idx", F.lit(-1.0).alias("w")), ranges)
    after = parts(store.path)
    assert len(before) == 10 and len(before & after) == 8 and all("trace_id=01" in f for f in before ^ after)
    rows = store.samples().collect()
    assert len(rows) == 1000 and {(r.trace_id, r.idx) for r in rows if r.v == -1} == {("01", i) for i in range(95, 105)}
    store.write_back(df.limit(0).select("trace_id", "idx", F.lit(0.0).alias("w")), ranges.limit(0))
    assert parts(store.path) == after


def test_days_are_replaced_in_place(spark, tmp_path):
    schema = "station string, day string, s long, e long, kind string, method string, note string"
    store = CatalogStore(spark, str(tmp_path / "catalog"))
    store.append(spark.createDataFrame([("S1", "0101", 0, 9, "repair", "core", "x"), ("S1", "0102", 0, 9, "event", "keep", ""), ("S2", "0101", 5, 9, "repair", "core", "")], schema))
    before = parts(store.path)
    new = [("S1", "0101", 0, 4, "repair", "core", "a"), ("S1", "0101", 5, 9000, "repair", "core", ""), ("S1", "0101", 8000, 8001, "event", "keep", None), ("S1", "0103", 1, 2, "repair", "core", None)]
    manual = spark.createDataFrame([("S1", "0101", 8500, 12000), ("S1", "0103", 3, 4)], "station string, day string, s long, e long")
    store.replace_days(spark.createDataFrame(new, schema), manual)
    assert len(before & parts(store.path)) == 2
    assert {tuple(r) for r in store.read().select("station", "day", "s", "e", "kind", "method", "note").collect()} == {
        ("S1", "0102", 0, 9, "event", "keep", ""), ("S2", "0101", 5, 9, "repair", "core", ""), ("S1", "0101", 0, 4, "repair", "core", "a"),
        ("S1", "0101", 5, 9000, "repair", "manual_apply", "manual apply"), ("S1", "0101", 8000, 8001, "event", "keep", None), ("S1", "0103", 1, 2, "repair", "core", None),
    }


def library(spark, root: str, files: list[str]):
    rows = [(f"{root}/{f}", f.rpartition("/")[2], f) for f in files]
    return names.parsed(spark.createDataFrame(rows, "path string, name string, rel string"))


DAY, FRAGMENT = "XA.S12.19760113.mseed", "XA.S12.01.MHZ.19760113_070152-19760113_190149.mseed"


@pytest.mark.parametrize(("raw", "fix", "stream", "indexed", "want"), [
    ([FRAGMENT], [f"1976/01/{FRAGMENT}"], "XA.S12.01.MHZ", True, (f"raw/{FRAGMENT}", f"fix/1976/01/{FRAGMENT}", None)),
    ([f"1976/01/{DAY}"], [f"1976/01/{DAY}"], "XA.S12", True, (f"raw/1976/01/{DAY}", f"fix/1976/01/{DAY}", None)),
    ([DAY], [f"deep/nested/dir/{DAY}"], "XA.S12", True, (f"raw/{DAY}", f"fix/deep/nested/dir/{DAY}", None)),
    ([DAY], ["XA.S12.19760114.mseed"], "S12", True, (f"raw/{DAY}", DAY, "FIX_MISSING")),
    (["XA.S14.19760113.mseed"], [], "S12", True, (None, None, "RAW_MISSING")),
    ([DAY], [DAY], "XA.S12", False, (f"raw/{DAY}", f"fix/{DAY}", None)),
    ([f"x/{FRAGMENT}"], [DAY], "S12", False, (f"raw/x/{FRAGMENT}", None, "RAW_SEGMENT")),
])
def test_paths(spark, raw, fix, stream, indexed, want):
    r, f = library(spark, "raw", raw), library(spark, "fix", fix or ["none"])
    index = names.first_per_label(r if indexed else r.limit(0))
    got = names.resolved(spark.createDataFrame([(stream, "19760113")], "stream string, day string"), index, r, f).collect()
    assert [(x.raw_path, x.fix_path, x.error) for x in got] == [want]


def test_a_file_is_not_its_own_counterpart(spark):
    same = library(spark, "db", [DAY])
    assert [r.counterpart for r in names.counterparts(same, same).collect()] == [None]


def test_event_catalogs_in_order(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("user.json", "packaged.json", "a.csv", "b.csv", "absent.json")}
    with open(paths["a.csv"], "w", encoding="utf-8-sig") as f:
        f.write("Date,n\n7601130705,1\n7704712332,2\n6901010000,3\r\n76,4\n")
    with open(paths["b.csv"], "w") as f:
        f.write("n,Date\n1,7601130705\n2, 7601130706 \n")
    every = [paths["absent.json"], paths["user.json"], paths["packaged.json"], paths["a.csv"], paths["b.csv"]]
    times = lambda: sorted(str(r.event_ts) for r in catalogs.events_of(catalogs.event_documents(spark, every)).collect())
    assert times() == ["1976-01-13 07:05:00", "1976-01-13 07:06:00", "2069-01-01 00:00:00"]
    with open(paths["packaged.json"], "w") as f:
        json.dump({"events": ["1976-01-02T03:04:05", "nonsense", "1976-01-02T03:04:05"]}, f, indent=1)
    assert times() == ["1976-01-02 03:04:05"]
    for text, want in (("{broken", "03:04:05"), ('{"events": []}', "03:04:05"), ('{"events": ["1976-01-02T23:59:58"]}', "23:59:58")):
        with open(paths["user.json"], "w") as f:
            f.write(text)
        assert times() == [f"1976-01-02 {want}"]
    events = catalogs.events_of(catalogs.event_documents(spark, every))
    assert [tuple(r) for r in catalogs.seconds_of_day(events).collect()] == [("19760102", 86398)]
    files = spark.createDataFrame([("z/cat_1.csv", "cat_1.csv", 1), ("a/cat_1.csv", "cat_1.csv", 0), ("z/cat_2.csv", "cat_2.csv", 1), ("a/dog.csv", "dog.csv", 0)], "path string, name string, priority int")
    assert sorted(r.path for r in catalogs.first_by_name(files, "cat_").collect()) == ["a/cat_1.csv", "z/cat_2.csv"]


def test_intermediate_tables_can_be_deleted(spark):
    session = spark.newSession()
    path = fresh_path(session, "gone")
    session.range(3).write.parquet(path)
    cleanup(session)
    assert not os.path.exists(path.removeprefix("file:"))
