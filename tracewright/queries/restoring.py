"""Bounds, references, guards and edges of rebuilt segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fill, masks, ranges, restore, runs
from ..operators.storage import settled
from .quality import CLAMP, FLAGGED, filled, flagged
from .registry import query
from .views import RUNS, SR, TRC, r, rolling_sql, trc

#: Windows of 50 samples around the longer missing runs, and walls.
BLOCKS = "bk AS (SELECT trace_id, k * 500 + 90 AS s, k * 500 + 139 AS e FROM (SELECT trace_id, idx // 500 AS k FROM trc WHERE idx % 500 BETWEEN 90 AND 139 GROUP BY ALL HAVING count(*) = 50))"
WALLS = f"wl AS ({RUNS.format(table='trc', cond='idx % 997 < 40')})"


def blocks(df: DataFrame) -> DataFrame:
    k = F.floor(F.col("idx") / 500)
    rows = df.where((F.col("idx") % 500).between(90, 139)).groupBy("trace_id", k.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n = 50")
    return settled(rows.select("trace_id", (F.col("k") * 500 + 90).alias("s"), (F.col("k") * 500 + 139).alias("e")), "blocks")


def walls(df: DataFrame) -> DataFrame:
    return settled(runs.runs(df.withColumn("_w", F.col("idx") % 997 < 40), "_w"), "walls")


def _side(out: str, source: str, right: bool) -> str:
    """One end of segments moved, as CTEs named after `out`."""
    a, b = ("e + 1 + (i - 1) * 53", "e + i * 53") if right else ("s - i * 53", "s - 1 - (i - 1) * 53")
    s, e = ("g.s", "coalesce(x.b, g.e)") if right else ("coalesce(x.a, g.s)", "g.e")
    rest, c0, c1 = ("n - 1 - e", "e + 1", "e + room") if right else ("s", "s - room", "s - 1")
    end = "s, CASE WHEN hit THEN e ELSE e + room END AS e" if right else "CASE WHEN hit THEN s ELSE s - room END AS s, e"
    return f"""{out}w AS (SELECT * FROM (SELECT g.*, i, greatest({a}, 0) AS a, least({b}, n - 1) AS b FROM {source} g, range(1, 31) t(i) WHERE base IS NOT NULL AND e - s + 1 + (i - 1) * 53 < 11925) WHERE a <= b),
    {out}m AS (SELECT w.trace_id, w.s, w.e, i, base, a, b, median(v) AS m, count(*) AS k FROM {out}w w JOIN gd ON gd.trace_id = w.trace_id AND gd.idx BETWEEN a AND b WHERE NOT EXISTS (SELECT 1 FROM wl WHERE wl.trace_id = w.trace_id AND wl.s <= b AND wl.e >= a) GROUP BY ALL),
    {out}o AS (SELECT m.trace_id, m.s, m.e, i, a, b FROM {out}m m JOIN gd ON gd.trace_id = m.trace_id AND gd.idx BETWEEN a AND b WHERE k >= 4 GROUP BY m.trace_id, m.s, m.e, i, base, a, b, m HAVING abs(m - base) > 2.5 * greatest(1.4826 * median(abs(v - m)), 0.5)),
    {out}x AS (SELECT trace_id, s, e, min(a) AS a, max(b) AS b FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, s, e ORDER BY i) AS r FROM {out}o) WHERE r = i GROUP BY ALL),
    {out}y AS (SELECT g.trace_id, g.n, g.base, {s} AS s, {e} AS e, x.a IS NOT NULL AS moved FROM {source} g LEFT JOIN {out}x x USING (trace_id, s, e)),
    {out}z AS (SELECT *, {c0} AS c0, {c1} AS c1 FROM (SELECT *, CASE WHEN moved THEN greatest(least(99, 11925 - (e - s + 1), {rest}), 0) ELSE 0 END AS room FROM {out}y)),
    {out} AS (SELECT trace_id, n, base, {end} FROM (SELECT *, EXISTS (SELECT 1 FROM wl WHERE wl.trace_id = z.trace_id AND wl.s <= c1 AND wl.e >= c0) AS hit FROM {out}z z))"""


REFINED = f"""{FLAGGED}, gd AS (SELECT trace_id, idx, v FROM fl WHERE NOT bad), {WALLS}, nn AS (SELECT trace_id, max(idx) + 1 AS n FROM trc GROUP BY trace_id), sg AS (SELECT trace_id, s, e, n FROM miss JOIN nn USING (trace_id) WHERE e - s + 1 > 20),
    lm AS (SELECT sg.trace_id, s, e, idx < s AS lf, median(v) AS m, count(*) AS k FROM sg JOIN gd ON gd.trace_id = sg.trace_id AND (idx BETWEEN s - 596 - 231 AND s - 231 - 1 OR idx BETWEEN e + 1 + 231 AND e + 231 + 596) GROUP BY ALL HAVING count(*) >= 26),
    lc AS (SELECT lm.trace_id, lm.s, lm.e, lf, m, 1.4826 * median(abs(v - m)) AS c FROM lm JOIN gd ON gd.trace_id = lm.trace_id AND ((lf AND idx BETWEEN s - 827 AND s - 232) OR (NOT lf AND idx BETWEEN e + 232 AND e + 827)) GROUP BY ALL),
    g0 AS (SELECT sg.*, CASE WHEN l.m IS NULL THEN r.m WHEN r.m IS NULL THEN l.m WHEN abs(l.m - r.m) > 2 * greatest(least(l.c, r.c), 0.5) THEN CASE WHEN l.c <= r.c THEN l.m ELSE r.m END ELSE (l.m + r.m) / 2 END AS base FROM sg LEFT JOIN lc l ON l.trace_id = sg.trace_id AND l.s = sg.s AND l.lf LEFT JOIN lc r ON r.trace_id = sg.trace_id AND r.s = sg.s AND NOT r.lf),
    {_side('g1', 'g0', True)}, {_side('g2', 'g1', False)}"""


@query(f"WITH {REFINED} SELECT trace_id, min(s) AS s, max(e) AS e, 'core' AS kind FROM (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY s, e) AS g FROM (SELECT *, max(e) OVER (PARTITION BY trace_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM g2)) GROUP BY trace_id, g")
def refined_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long missing runs widened to where the trace is back at its level, but not into walls."""
    df = flagged(spark, sf_dir)
    segs = settled(runs.runs(df, "bad").where(runs.length() > 20).withColumn("kind", F.lit("core")), "runs")
    return restore.refined(segs, df, "v", "bad", walls(df), SR)


LOW = f"""{TRC}, lw AS (SELECT trace_id, idx, CASE WHEN v <= -1 OR v = 0 THEN v WHEN idx % 500 IN (98, 99, 131) THEN 30 ELSE v END AS v FROM trc), fl AS (SELECT *, {{missing}} AS bad FROM lw), rn AS ({RUNS.format(table='fl', cond='bad')}),
    gd AS (SELECT trace_id, idx, v, row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS g FROM fl WHERE NOT bad),
    pl AS (SELECT rn.*, d, i, fl.v, fl.bad, gd.g FROM rn, range(1, 6) t(i), (VALUES (-1), (1)) q(d) JOIN fl ON fl.trace_id = rn.trace_id AND fl.idx = CASE WHEN d < 0 THEN s - i ELSE e + i END LEFT JOIN gd ON gd.trace_id = fl.trace_id AND gd.idx = fl.idx),
    lo AS (SELECT pl.trace_id, s, e, d, i FROM pl JOIN gd ON gd.trace_id = pl.trace_id AND (CASE WHEN d < 0 THEN gd.g BETWEEN pl.g - 199 AND pl.g ELSE gd.g BETWEEN pl.g AND pl.g + 199 END) WHERE NOT bad GROUP BY pl.trace_id, s, e, d, i, pl.v HAVING count(*) >= 10 AND pl.v < 0.25 * median(gd.v) UNION ALL SELECT trace_id, s, e, d, i FROM pl WHERE bad),
    gr AS (SELECT trace_id, s, e, d, max(i) AS k FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, s, e, d ORDER BY i) AS r FROM lo) WHERE r = i GROUP BY ALL)""".format(missing="(v <= -1 OR v = 0)")


@query(f"WITH {LOW} SELECT rn.trace_id, rn.s, rn.e, rn.s - coalesce(a.k, 0) AS new_s, rn.e + coalesce(b.k, 0) AS new_e FROM rn LEFT JOIN gr a ON a.trace_id = rn.trace_id AND a.s = rn.s AND a.d = -1 LEFT JOIN gr b ON b.trace_id = rn.trace_id AND b.s = rn.s AND b.d = 1")
def low_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing runs with the low samples beside them."""
    v = F.col("v")
    gone = masks.missing_counts(v)
    df = trc(spark, sf_dir).select("trace_id", "idx", F.when(gone, v).when((F.col("idx") % 500).isin(98, 99, 131), 30.0).otherwise(v).alias("v"))
    df = settled(df.withColumn("bad", masks.missing_counts(v)), "low")
    return restore.low_edges(settled(runs.runs(df, "bad"), "runs"), df, "v", "bad")


@query(f"WITH {FLAGGED}, {BLOCKS}, pr AS (SELECT DISTINCT bk.trace_id, bk.s, bk.e, greatest(o.s, bk.s - 120, 0) AS a, least(o.e, bk.e + 120) AS b FROM bk JOIN miss o ON o.trace_id = bk.trace_id AND o.s <= bk.e + 120 AND o.e >= bk.s - 120 WHERE NOT (o.s = bk.s AND o.e = bk.e)), lv AS (SELECT pr.trace_id, a, b, median(v) AS m, count(*) AS k FROM (SELECT DISTINCT trace_id, a, b FROM pr) pr JOIN fl ON fl.trace_id = pr.trace_id AND NOT bad AND idx BETWEEN a - 120 AND b + 120 AND (idx < a OR idx > b) GROUP BY ALL), wh AS (SELECT trace_id, median(v) AS m0 FROM fl WHERE NOT bad GROUP BY trace_id) SELECT pr.*, round(CASE WHEN k >= 8 THEN m ELSE m0 END, 6) AS level FROM pr LEFT JOIN lv USING (trace_id, a, b) LEFT JOIN wh USING (trace_id)")
def masked_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing runs in and around windows, and the levels that stand for them in a reference."""
    df = flagged(spark, sf_dir)
    return restore.masked_references(blocks(df), settled(runs.runs(df, "bad"), "runs"), df, "v", 120, "bad").withColumn("level", r("level"))


@query(f"WITH {CLAMP}, {BLOCKS}, nn AS (SELECT trace_id, max(idx) + 1 AS n FROM trc GROUP BY trace_id), st AS (SELECT bk.trace_id, s, e, count(*) FILTER (WHERE NOT bad) AS k, CASE WHEN count(*) FILTER (WHERE NOT bad) > 3 THEN stddev_pop(v) FILTER (WHERE NOT bad) END AS raw_std, CASE WHEN count(w) > 3 THEN stddev_pop(w) ELSE 0 END AS new_std, avg(bad::INT) AS gone, count(*) FILTER (WHERE idx <= n - 2) AS n1, max(v) FILTER (WHERE idx <= n - 2) > min(v) FILTER (WHERE idx <= n - 2) AS moves FROM bk JOIN filled f ON f.trace_id = bk.trace_id AND idx BETWEEN s AND e JOIN nn ON nn.trace_id = bk.trace_id GROUP BY bk.trace_id, s, e), ct AS (SELECT bk.trace_id, s, e, v FROM bk JOIN filled f ON f.trace_id = bk.trace_id AND NOT bad AND idx BETWEEN s - 1987 AND e + 1987 AND (idx < s OR idx > e)), cm AS (SELECT trace_id, s, e, median(v) AS m FROM ct GROUP BY ALL HAVING count(*) >= 30), cs AS (SELECT trace_id, s, e, 1.4826 * median(abs(v - m)) AS sc FROM ct JOIN cm USING (trace_id, s, e) GROUP BY ALL), al AS (SELECT *, greatest(coalesce(sc, raw_std), 0.5) AS ar FROM st LEFT JOIN cs USING (trace_id, s, e)) SELECT trace_id, s, e, round(raw_std, 6) AS raw_std, round(new_std, 6) AS new_std, round(ar, 6) AS around_std, CASE WHEN raw_std IS NOT NULL AND new_std > greatest(1.1 * raw_std, 2 * ar) THEN 'energy' WHEN k >= 30 AND n1 >= 8 AND moves AND gone <= 0.5 AND raw_std / ar BETWEEN 0.2 AND 4 THEN 'alive' ELSE 'kept' END AS verdict, round(2 * ar, 6) AS most_std FROM al")
def guard_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what was put in place of windows may stay."""
    df = filled(spark, sf_dir)
    out = restore.guard(blocks(df), df, "v", "w", "bad", SR)
    return out.select("trace_id", "s", "e", *(r(c).alias(c) for c in ("raw_std", "new_std", "around_std")), "verdict", r("most_std").alias("most_std"))


@query(f"WITH {CLAMP}, {BLOCKS}, nr AS (SELECT bk.trace_id, s, e, idx < s AS lf, v, CASE WHEN idx < s THEN -row_number() OVER (PARTITION BY bk.trace_id, s, idx < s ORDER BY idx DESC) ELSE row_number() OVER (PARTITION BY bk.trace_id, s, idx < s ORDER BY idx) - 1 END AS x FROM bk JOIN filled f ON f.trace_id = bk.trace_id AND NOT bad AND (idx BETWEEN s - 198 AND s - 1 OR idx BETWEEN e + 1 AND e + 198)), ln AS (SELECT trace_id, s, e, lf, regr_slope(v, x) AS b, regr_intercept(v, x) AS a FROM nr WHERE (lf AND x >= -36) OR (NOT lf AND x < 36) GROUP BY ALL HAVING count(*) >= 4) SELECT bk.trace_id, bk.s, bk.e, idx, round(CASE WHEN idx - bk.s < 12 THEN coalesce((l.a + l.b * (idx - bk.s)) * (1 - (idx - bk.s) / 11) + w * (idx - bk.s) / 11, w) WHEN bk.e - idx < 12 THEN coalesce((q.a - q.b * (bk.e - idx + 1)) * (1 - (bk.e - idx) / 11) + w * (bk.e - idx) / 11, w) ELSE w END, 6) AS w FROM bk JOIN filled f ON f.trace_id = bk.trace_id AND idx BETWEEN bk.s AND bk.e LEFT JOIN ln l ON l.trace_id = bk.trace_id AND l.s = bk.s AND l.lf LEFT JOIN ln q ON q.trace_id = bk.trace_id AND q.s = bk.s AND NOT q.lf")
def crossfaded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled windows whose edges fade into the lines of their surroundings."""
    df = filled(spark, sf_dir)
    return restore.crossfaded(blocks(df), df, "v", "w", "bad", SR).withColumn("w", r("w"))


ZONES = [(280, 479), (580, 679)]
ZONE_CTE = f"""{FLAGGED}, zr AS (SELECT trace_id, idx, CASE WHEN bad THEN 0 ELSE v END AS v, bad FROM fl), gm AS (SELECT trace_id, median(v) AS m FROM zr GROUP BY trace_id), gl AS (SELECT trace_id, 1.4826 * median(abs(v - m)) AS gscale FROM zr JOIN gm USING (trace_id) GROUP BY trace_id),
    zn AS (SELECT trace_id || ':' || z.s AS trace_id, trace_id AS t, idx - z.s AS idx, z.s, v, bad, z.e - z.s + 1 AS n FROM zr JOIN (VALUES {', '.join(str(z) for z in ZONES)}) z(s, e) ON idx BETWEEN z.s AND z.e),
    zb AS ({rolling_sql('zn', 'v', 3, 3, 'median({})', 'base')}), zx AS (SELECT zn.*, abs(v - base) AS res FROM zn JOIN zb USING (trace_id, idx)), zs AS ({rolling_sql('zx', 'res', 3, 3, 'median({})', 'scale')}),
    h AS (SELECT zx.*, bad OR res > 8.0 * greatest(1.4826 * scale + 1e-9, 0.5 * gscale) AS hit FROM zx JOIN zs USING (trace_id, idx) JOIN gl ON gl.trace_id = zx.t)"""


@query(f"""WITH {ZONE_CTE}, kn AS (SELECT trace_id, idx, v, row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS k FROM h WHERE NOT hit),
    w AS (SELECT *, count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY trace_id) AS c, count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY trace_id ORDER BY idx) AS ka FROM h), p AS (SELECT *, CASE WHEN ka = 0 THEN 1 WHEN ka = c THEN c - 1 ELSE ka END AS k FROM w WHERE hit)
SELECT p.t AS trace_id, p.idx + p.s AS idx, round(a.v + (b.v - a.v) * (p.idx - a.idx) / (b.idx - a.idx), 6) AS w FROM p JOIN kn a ON a.trace_id = p.trace_id AND a.k = p.k JOIN kn b ON b.trace_id = p.trace_id AND b.k = p.k + 1""")
def protected_zone_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes and missing samples within protected zones, and nothing else of them."""
    df = settled(flagged(spark, sf_dir), "flagged")
    zone = F.explode(F.array(*(F.struct(F.lit(s).cast("long").alias("s"), F.lit(e).cast("long").alias("e")) for s, e in ZONES)))
    zones = settled(df.select("trace_id").distinct().select("trace_id", zone.alias("z")).select("trace_id", "z.*"), "zones")
    out = fill.protected_fill(df, zones, "bad", "v", "x")
    inside = ranges.samples_in(out, zones)
    return inside.where("bad OR x <> v").select("trace_id", "idx", r("x").alias("w"))


@query(f"WITH {TRC}, s AS (SELECT trace_id, idx / {SR} AS s, idx / {SR} + CASE WHEN idx % 5 = 0 THEN -1 ELSE 4 + idx % 19 END AS e FROM trc WHERE idx % 97 = 0) SELECT trace_id, round(min(s), 6) AS s, round(max(e), 6) AS e FROM (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY s, e) AS g FROM (SELECT *, max(e) OVER (PARTITION BY trace_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s WHERE e > s)) GROUP BY trace_id, g")
def merged_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected ranges of seconds, joined where they overlap or touch."""
    t = F.col("idx") / SR
    picked = trc(spark, sf_dir).where("idx % 97 = 0").select("trace_id", t.alias("s"), (t + F.when(F.col("idx") % 5 == 0, -1).otherwise(4 + F.col("idx") % 19)).alias("e"))
    return runs.merged_selections(picked).select("trace_id", r("s").alias("s"), r("e").alias("e"))
