"""Continuity of rebuilt segments with their references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rolling, verification
from ..operators.storage import settled
from .quality import CLAMP, filled
from .registry import query
from .restoring import BLOCKS, blocks
from .spectral import PI2
from .views import SR, r

#: Blocks, with references of 100 samples beyond 6; the transform of 256 places by its definition.
PARTS = f"""{CLAMP}, {BLOCKS}, nn AS (SELECT trace_id, max(idx) + 1 AS n FROM filled GROUP BY trace_id), sg AS (SELECT bk.trace_id, s, e, greatest(0, s - 106) AS b_s, s - 7 AS b_e, e + 7 AS a_s, least(n - 1, e + 106) AS a_e FROM bk JOIN nn USING (trace_id)),
    pt AS (SELECT trace_id, s, side, lo, hi, hi - lo + 1 AS m FROM (SELECT trace_id, s, unnest(['b', 'x', 'a']) AS side, unnest([b_s, s, a_s]) AS lo, unnest([b_e, e, a_e]) AS hi FROM sg) WHERE lo <= hi),
    p AS (SELECT pt.trace_id, pt.s, side, m, f.idx - lo AS pos, f.w AS x, greatest(1, m // 4) AS q FROM pt JOIN filled f ON f.trace_id = pt.trace_id AND f.idx BETWEEN lo AND hi), mu AS (SELECT trace_id, s, side, avg(x) AS mean FROM p GROUP BY ALL)"""
_AT = f"{PI2} * ((pos * f) % {{n}}) / {{n}}"


@query(f"""WITH {PARTS},
    d AS (SELECT trace_id, s, side, f, (power(sum((x - mean) * cos({_AT.format(n=256)})), 2) + power(sum((x - mean) * sin({_AT.format(n=256)})), 2)) / 256 AS v FROM p JOIN mu USING (trace_id, s, side), range(19, 115) t(f) GROUP BY ALL EXCLUDE),
    c AS (SELECT trace_id, s, CASE WHEN least(sqrt(sum(b * b)), sqrt(sum(x * x)), sqrt(sum(a * a))) < 1e-15 THEN 0 ELSE least(sum(b * x) / sqrt(sum(b * b)) / sqrt(sum(x * x)), sum(a * x) / sqrt(sum(a * a)) / sqrt(sum(x * x))) END AS spectral FROM (SELECT trace_id, s, f, max(CASE WHEN side = 'b' THEN v END) AS b, max(CASE WHEN side = 'x' THEN v END) AS x, max(CASE WHEN side = 'a' THEN v END) AS a FROM d GROUP BY trace_id, s, f) GROUP BY trace_id, s),
    h AS (SELECT trace_id, s, side, m, f, CASE WHEN f = 0 OR 2 * f = m THEN 1 ELSE 2 END AS w, sum(x * cos({_AT.format(n='m')})) AS re, -sum(x * sin({_AT.format(n='m')})) AS im FROM p, range(51) t(f) WHERE 2 * f <= m GROUP BY trace_id, s, side, m, f),
    ev AS (SELECT trace_id, s, side, m, pos, sqrt(power(sum(w * (re * cos({_AT.format(n='m')}) - im * sin({_AT.format(n='m')}))), 2) + power(sum(w * (re * sin({_AT.format(n='m')}) + im * cos({_AT.format(n='m')}))), 2)) / m AS v FROM h, range(100) t(pos) WHERE pos < m GROUP BY trace_id, s, side, m, pos),
    e1 AS (SELECT trace_id, s, max(CASE WHEN side = 'b' AND pos = m - 1 THEN v END) AS b, max(CASE WHEN side = 'x' AND pos = 0 THEN v END) AS x0, max(CASE WHEN side = 'x' AND pos = m - 1 THEN v END) AS x1, max(CASE WHEN side = 'a' AND pos = 0 THEN v END) AS a,
        avg(CASE WHEN side = 'b' AND pos >= m - greatest(1, m // 4) THEN v END) AS bm, avg(CASE WHEN side = 'a' AND pos < greatest(1, m // 4) THEN v END) AS am FROM ev GROUP BY trace_id, s),
    l AS (SELECT trace_id, s, avg(CASE WHEN side = 'b' AND pos >= m - q THEN x END) AS b, avg(CASE WHEN side = 'x' AND pos < q THEN x END) AS x0, avg(CASE WHEN side = 'x' AND pos >= m - q THEN x END) AS x1, avg(CASE WHEN side = 'a' AND pos < q THEN x END) AS a,
        stddev_pop(CASE WHEN side = 'b' THEN x END) AS bs, stddev_pop(CASE WHEN side = 'a' THEN x END) AS sa, avg(CASE WHEN side = 'b' THEN x * x END) AS be, avg(CASE WHEN side = 'x' THEN x * x END) AS xe, avg(CASE WHEN side = 'a' THEN x * x END) AS ae FROM p GROUP BY trace_id, s),
    ac AS (SELECT a.trace_id, a.s, a.side, a.m, b.pos - a.pos AS lag, sum(a.x * b.x) AS v FROM p a JOIN p b ON a.trace_id = b.trace_id AND a.s = b.s AND a.side = b.side AND b.pos >= a.pos WHERE a.side <> 'a' GROUP BY ALL),
    lg AS (SELECT trace_id, s, side, coalesce(min(CASE WHEN v < 0 THEN lag END), any_value(m)) AS lag FROM ac GROUP BY trace_id, s, side),
    al AS (SELECT trace_id, s, abs(max(CASE WHEN side = 'b' THEN lag END) - max(CASE WHEN side = 'x' THEN lag END)) / max(CASE WHEN side = 'b' THEN lag END) AS autocorrelation FROM lg GROUP BY trace_id, s),
    every AS (SELECT sg.trace_id, sg.s, sg.e, spectral, greatest(abs(e1.b - e1.x0) / (bm + 1e-10), abs(e1.x1 - e1.a) / (am + 1e-10)) AS envelope, greatest(abs(l.b - l.x0) / (bs + 1e-10), abs(l.a - l.x1) / (sa + 1e-10)) AS level, autocorrelation, xe / ((be + ae) / 2) AS energy
        FROM sg JOIN c USING (trace_id, s) JOIN e1 USING (trace_id, s) JOIN l USING (trace_id, s) JOIN al USING (trace_id, s))
SELECT trace_id, s, e, round(spectral, 6) AS spectral, round(envelope, 6) AS envelope, round(level, 6) AS level, round(autocorrelation, 6) AS autocorrelation, round(energy, 6) AS energy,
    concat_ws(',', CASE WHEN spectral < 0.95 THEN 'spectral' END, CASE WHEN envelope > 0.15 THEN 'envelope' END, CASE WHEN level > 0.05 THEN 'level' END, CASE WHEN autocorrelation > 0.2 THEN 'autocorrelation' END, CASE WHEN energy NOT BETWEEN 0.7 AND 1.3 THEN 'energy' END) AS issues FROM every""".replace("GROUP BY ALL EXCLUDE", "GROUP BY trace_id, s, side, f"))
def verified_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled blocks against what stands around them."""
    df = settled(filled(spark, sf_dir).select("trace_id", "idx", "w"), "filled")
    segs = blocks(df).join(rolling.lengths(df), "trace_id")
    segs = segs.select("trace_id", "s", "e", F.greatest(F.lit(0), F.col("s") - 106).alias("b_s"), (F.col("s") - 7).alias("b_e"), (F.col("e") + 7).alias("a_s"), F.least(F.col("n") - 1, F.col("e") + 106).alias("a_e"))
    out = verification.verified(df, segs, SR)
    return out.select("trace_id", "s", "e", *(r(c).alias(c) for c in ("spectral", "envelope", "level", "autocorrelation", "energy")), "issues")
