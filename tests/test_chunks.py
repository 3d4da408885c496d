"""Repairs in an order by chunks of islands: their number of jobs, and the array rules against the relational ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_rounds import plain_rounds, samples
from tracewright.functions.edges import Chunk
from tracewright.operators import restore, rolling
from tracewright.operators.storage import settled
from tracewright.plans import rounds


@pytest.mark.parametrize("size", [1 << 16, 2500])
def test_jobs_follow_chunks_and_not_tasks(spark, monkeypatch, size):
    monkeypatch.setattr(rolling, "CHUNK", size)
    rng = np.random.default_rng(5)
    x, chain = np.round(rng.normal(500, 9, 6000) + np.arange(6000) / 40), [(s, s + 39) for s in range(100, 5900, 145)]
    df = settled(samples(spark, {"a": x}, {"a": set(range(100, 140)) | set(range(2000, 2050))}))
    tasks = spark.createDataFrame([("a", s, e, 0) for s, e in chain], "trace_id string, s long, e long, round int")
    spark.sparkContext.setJobGroup(f"rounds-{size}", "rounds")
    values, _ = rounds.in_rounds(df, tasks, tasks.select("trace_id", "s", "e").limit(0), rounds.at_reference_level, 1.0)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{size}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {r.s: r.w for r in values.groupBy("s").agg(F.max("w").alias("w")).collect()}
    bad = np.isin(np.arange(6000), [*range(100, 140), *range(2000, 2050)])
    assert got == pytest.approx(plain_rounds(x, bad, chain, [], 1, 120.0, 600.0))
    assert len(chain) == 40 and jobs < 40  # one job and more for each task before


def test_array_rules_are_the_relational_ones(spark):
    rng = np.random.default_rng(8)
    n, sr, keys = 6000, 6.625, ["trace_id", "s", "e"]
    x = np.round(450 + rng.normal(0, 4, n) + np.r_[np.zeros(3000), np.full(3000, 6)])
    bad, w = rng.random(n) < 0.05, x + rng.normal(0, 3, n)
    spans = [(2, 9), (500, 560), (1000, 1900), (2950, 3100), (4000, 4003), (5000, 5090), (5900, 5999)]
    for s, e in spans[1::2]:
        bad[s : e + 1] |= rng.random(e - s + 1) < 0.8
    w[5000:5091] += 90 * np.sin(np.arange(91))
    x[bad] = 0
    rows = [("t", i, float(x[i]), float(w[i]), bool(bad[i])) for i in range(n)]
    df = settled(spark.createDataFrame(rows, "trace_id string, idx long, v double, w double, bad boolean"))
    segs = settled(spark.createDataFrame([("t", s, e) for s, e in spans], "trace_id string, s long, e long"))
    judged = settled(restore.guard(segs, df, "v", "w", "bad", sr))
    lined = settled(restore.realigned(judged, df, "v", "w", "bad", sr))
    faded = settled(restore.crossfaded(segs, df, "v", "w", "bad", sr))
    of = lambda table: {k: np.array([r.w for r in sorted(g, key=lambda r: r.idx)]) for k in spans for g in [[r for r in table if (r.s, r.e) == k]]}
    verdicts, lines, fades = {(r.s, r.e): r for r in judged.collect()}, of(lined.collect()), of(faded.collect())
    chunk = Chunk(0, n, x.copy(), bad.copy(), x, bad)
    for s, e in spans:
        verdict, around = chunk.guard(s, e, w[s : e + 1], int(300 * sr))
        assert verdict == verdicts[s, e].verdict and around == pytest.approx(verdicts[s, e].around_std)
        skip = int((35.0 if e - s + 1 > int(60.0 * sr) else 10.0) * sr)
        assert chunk.realigned(s, e, w[s : e + 1], around, int(45.0 * sr), skip) == pytest.approx(lines[s, e])
        assert chunk.crossfaded(s, e, w[s : e + 1], int(10.0 * sr), int(30.0 * sr)) == pytest.approx(fades[s, e])
    assert {r.verdict for r in verdicts.values()} == {"kept", "energy", "alive"}
