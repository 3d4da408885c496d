"""Stretches of good samples away from their segment's level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomalies
from ..operators.storage import settled
from .registry import query
from .views import MISSING, SR, TRC, trc

#: A calm trace with missing runs, in which an oscillation dies away from place 300 of every thousand, and a spike stands at 700; segments are the first 900 of each thousand.
CALM = "CASE WHEN v <= -1 OR v = 0 THEN v ELSE 480 + floor((clean - 400) / 40) + CASE WHEN idx % 1000 >= 300 THEN (CASE WHEN idx % 2 = 0 THEN 1 ELSE -1 END) * floor(2400.0 / (10 + idx % 1000 - 300)) ELSE 0 END + CASE WHEN idx % 1000 = 700 THEN 90 ELSE 0 END END"
CALM_CTE = f"{TRC}, cm AS (SELECT trace_id, idx, CAST({CALM} AS DOUBLE) AS v, {MISSING} AS bad FROM trc), gd AS (SELECT * FROM cm WHERE NOT bad), sg AS (SELECT trace_id, min(idx) AS s, max(idx) AS e FROM cm WHERE idx % 1000 < 900 GROUP BY trace_id, idx // 1000)"


def calm(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = trc(spark, sf_dir)
    df = settled(df.select("trace_id", "idx", F.expr(CALM).cast("double").alias("v"), F.expr(MISSING).alias("bad")), "calm")
    segs = df.where("idx % 1000 < 900").groupBy("trace_id", F.floor(F.col("idx") / 1000).alias("k")).agg(F.min("idx").alias("s"), F.max("idx").alias("e"))
    return df, settled(segs.select("trace_id", "s", "e"), "segments")


def _grown(name: str, left: bool) -> str:
    """One window more as long as the last one passed."""
    a, b = ("greatest(g.seg_s, g.pt - 6)", "g.pt - 1") if left else ("g.pt + 1", "least(g.seg_e, g.pt + 6)")
    room = "g.pt > g.seg_s" if left else "g.pt < g.seg_e"
    edge = "s" if left else "e"
    to = a if left else b
    return f"""{name} AS (SELECT trace_id, seg_s, seg_e, med, thr, s AS first_s, {edge} AS pt FROM st
        UNION ALL SELECT g.trace_id, g.seg_s, g.seg_e, g.med, g.thr, g.first_s, {to} FROM {name} g, LATERAL (SELECT count(*) AS n, max(v) - min(v) AS span, median(v) AS middle FROM gd WHERE gd.trace_id = g.trace_id AND gd.idx BETWEEN {a} AND {b}) w
        WHERE {room} AND n >= 2 AND (span > 12 OR abs(middle - g.med) > greatest(g.thr * 0.5, 8)))"""


@query(f"""WITH RECURSIVE {CALM_CTE},
    lv AS (SELECT sg.trace_id, sg.s AS seg_s, sg.e AS seg_e, median(v) AS med, greatest(median(v) * 0.08, 15) AS thr FROM sg JOIN gd ON gd.trace_id = sg.trace_id AND gd.idx BETWEEN sg.s AND sg.e GROUP BY ALL HAVING count(*) >= 10),
    off AS (SELECT lv.*, gd.idx FROM lv JOIN gd ON gd.trace_id = lv.trace_id AND gd.idx BETWEEN seg_s AND seg_e WHERE abs(v - med) > thr),
    st AS (SELECT trace_id, seg_s, seg_e, med, thr, min(idx) AS s, max(idx) AS e FROM (SELECT *, sum(CASE WHEN p IS NULL OR idx - p > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, seg_s ORDER BY idx) AS g FROM (SELECT *, lag(idx) OVER (PARTITION BY trace_id, seg_s ORDER BY idx) AS p FROM off)) GROUP BY ALL EXCLUDE (g)),
    {_grown('lf', True)}, {_grown('rt', False)},
    wide AS (SELECT trace_id, seg_s, seg_e, first_s, s, e FROM (SELECT trace_id, seg_s, seg_e, first_s, min(pt) AS s FROM lf GROUP BY ALL) JOIN (SELECT trace_id, seg_s, first_s, max(pt) AS e FROM rt GROUP BY ALL) USING (trace_id, seg_s, first_s)),
    touch AS (SELECT trace_id, seg_s, seg_e, arg_min(s, first_s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, seg_s ORDER BY first_s) AS g FROM (SELECT *, max(e) OVER (PARTITION BY trace_id, seg_s ORDER BY first_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM wide)) GROUP BY trace_id, seg_s, seg_e, g)
SELECT trace_id, seg_s, seg_e, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN p IS NULL OR s - p > 54 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, seg_s ORDER BY s, e) AS g FROM (SELECT *, max(e) OVER (PARTITION BY trace_id, seg_s ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM touch)) GROUP BY trace_id, seg_s, seg_e, g""".replace("GROUP BY ALL EXCLUDE (g)", "GROUP BY trace_id, seg_s, seg_e, med, thr, g"))
def anomaly_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oscillations and steps of good samples within segments, with their tails."""
    df, segs = calm(spark, sf_dir)
    return anomalies.anomaly_runs(df, segs, SR)
