"""Protected spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outliers, spikes
from ..operators.storage import settled
from .registry import query
from .views import SR, TRC, r, trc


def _edges(table: str, column: str, h: int) -> str:
    return f"(SELECT trace_id, idx, {column}, n FROM {table} UNION ALL SELECT trace_id, -k, {column}, n FROM {table}, range(1, {h + 1}) t(k) WHERE idx = 0 UNION ALL SELECT trace_id, n - 1 + k, {column}, n FROM {table}, range(1, {h + 1}) t(k) WHERE idx = n - 1)"


def _median(table: str, column: str, h: int, out: str) -> str:
    return f"SELECT trace_id, idx, {out} FROM (SELECT trace_id, idx, n, median({column}) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS {out} FROM {_edges(table, column, h)}) WHERE idx BETWEEN 0 AND n - 1"


#: The verdicts in stages: samples with missing ones on a line, residuals and scales, runs, peaks within them.
JUDGED = f"""{TRC}, t0 AS (SELECT trace_id, idx, v AS raw, v = -1 AS gone, max(idx) OVER (PARTITION BY trace_id) + 1 AS n, last_value(CASE WHEN v <> -1 THEN idx END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY idx) AS pi, first_value(CASE WHEN v <> -1 THEN idx END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM trc),
    t AS (SELECT t0.trace_id, t0.idx, t0.n, t0.gone, CASE WHEN NOT t0.gone THEN t0.raw ELSE coalesce(a.raw + (b.raw - a.raw) * (t0.idx - t0.pi) / (t0.ni - t0.pi), a.raw, b.raw) END AS v FROM t0 LEFT JOIN t0 a ON a.trace_id = t0.trace_id AND a.idx = t0.pi LEFT JOIN t0 b ON b.trace_id = t0.trace_id AND b.idx = t0.ni),
    b AS ({_median('t', 'v', 2, 'base')}), rs AS (SELECT t.*, abs(v - base) AS res FROM t JOIN b USING (trace_id, idx)), lc AS ({_median('rs', 'res', 13, 'loc')}),
    h AS (SELECT trace_id, max(v) FILTER (WHERE NOT gone) AS high, median(v) AS mid FROM t GROUP BY trace_id),
    g AS (SELECT trace_id, high, greatest(1.4826 * median(abs(v - mid)), pow(2, -52)) AS gl_, count(*) FILTER (WHERE NOT gone AND v = high) AS k, coalesce(quantile_cont(v, 0.995) FILTER (WHERE NOT gone AND v < high), high) AS below FROM t JOIN h USING (trace_id) GROUP BY trace_id, high),
    sc AS (SELECT rs.*, gl_, greatest(1.4826 * loc, 0.05 * gl_) AS scale, NOT gone AND v = high AND k >= 2 AND high - below >= greatest(4, 8 * gl_) AS sat FROM rs JOIN lc USING (trace_id, idx) JOIN g USING (trace_id)),
    w AS (SELECT *, lag(res) OVER o AS rp, lead(res) OVER o AS rx, lag(scale) OVER o AS sp, lead(scale) OVER o AS sx FROM sc WINDOW o AS (PARTITION BY trace_id ORDER BY idx)),
    f AS (SELECT *, sat OR (rp IS NOT NULL AND rx IS NOT NULL AND res >= 16 * scale AND res >= 6 * gl_ AND res >= 1.25 * greatest(rp, rx)) AS strong, idx - row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS k FROM w WHERE sat OR (NOT gone AND res > greatest(8 * scale, 4 * gl_))),
    rn AS (SELECT trace_id, k, min(idx) AS s, max(idx) AS e, any_value(n) AS n, max(res) AS peak, greatest(arg_min(rp, idx), arg_max(rx, idx)) AS near, greatest(arg_min(sp, idx), arg_max(sx, idx)) AS beside, bool_and(sat) AS flat, bool_or(strong) AS strong FROM f GROUP BY trace_id, k),
    ru AS (SELECT *, CASE WHEN e - s + 1 > 2 THEN 'run_too_long' WHEN s = 0 OR e = n - 1 THEN 'edge_run' WHEN near > greatest(0.35 * peak, 2 * beside) THEN 'neighbours_not_returned' END AS reason FROM rn),
    vd AS (SELECT *, CASE WHEN reason IS NULL THEN 'accepted' WHEN flat AND e - s + 1 <= 4 THEN 'short_saturation_plateau' WHEN strong THEN 'peaks' ELSE reason END AS verdict FROM ru),
    pk AS (SELECT trace_id, min(idx) AS s, max(idx) AS e, max(res) AS peak FROM (SELECT f.trace_id, f.idx, f.res, f.idx - row_number() OVER (PARTITION BY f.trace_id ORDER BY f.idx) AS q FROM f JOIN vd ON vd.trace_id = f.trace_id AND vd.k = f.k AND verdict = 'peaks' WHERE f.strong) GROUP BY trace_id, q HAVING count(*) <= 4),
    jd AS (SELECT trace_id, s, e, peak, verdict FROM vd WHERE verdict <> 'peaks' UNION ALL SELECT trace_id, s, e, peak, 'extreme_isolated_peak' FROM pk)"""


@query(f"WITH {JUDGED} SELECT trace_id, s, e, round(peak, 6) AS peak, verdict FROM jd")
def protected_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(trc(spark, sf_dir).select("trace_id", "idx", "v"), "raw")
    return spikes.judged(df, "v", SR).select("trace_id", "s", "e", r("peak").alias("peak"), "verdict")


SUPPORT = f"""{JUDGED}, sp AS (SELECT jd.trace_id, s, e, max(CASE WHEN idx = s - 2 THEN v END) AS a, max(CASE WHEN idx = s - 1 THEN v END) AS b, max(CASE WHEN idx = e + 1 THEN v END) AS c, max(CASE WHEN idx = e + 2 THEN v END) AS d, count(*) AS k FROM jd JOIN trc ON trc.trace_id = jd.trace_id AND v <> -1 AND (idx BETWEEN s - 2 AND s - 1 OR idx BETWEEN e + 1 AND e + 2) WHERE verdict IN ('accepted', 'short_saturation_plateau', 'extreme_isolated_peak') GROUP BY jd.trace_id, s, e HAVING count(*) >= 2),
    sl AS (SELECT *, e - s + 2 AS h, b - a AS p, (c - b) / (e - s + 2) AS q, d - c AS u FROM sp), tg AS (SELECT sl.*, CASE WHEN p * q <= 0 THEN 0 ELSE 3 * (h + 1) / ((2 * h + 1) / p + (h + 2) / q) END AS m0, CASE WHEN q * u <= 0 THEN 0 ELSE 3 * (h + 1) / ((h + 2) / q + (2 * h + 1) / u) END AS m1 FROM sl),
    nw AS (SELECT trc.trace_id, trc.idx, trc.v, tg.*, (trc.idx - s + 1) / h AS y, CASE WHEN b IS NULL THEN s - 2 ELSE s - 1 END AS i0, CASE WHEN c IS NULL THEN e + 2 ELSE e + 1 END AS i1 FROM tg JOIN trc ON trc.trace_id = tg.trace_id AND trc.idx BETWEEN s AND e),
    rw AS (SELECT trace_id, idx, v, CASE WHEN k = 4 THEN (2 * y * y * y - 3 * y * y + 1) * b + (y * y * y - 2 * y * y + y) * h * m0 + (3 * y * y - 2 * y * y * y) * c + (y * y * y - y * y) * h * m1 ELSE coalesce(coalesce(b, a) + (coalesce(c, d) - coalesce(b, a)) * (idx - i0) / (i1 - i0), b, a, c, d) END AS w FROM nw)"""


@query(f"WITH {SUPPORT} SELECT trace_id, idx, round(w, 6) AS w FROM rw WHERE round(v, 6) <> round(w, 6)")
def protected_spike_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(trc(spark, sf_dir).select("trace_id", "idx", "v"), "raw")
    out = spikes.replaced(df, "v", "w", SR)
    return out.where(r("v") != r("w")).select("trace_id", "idx", r("w").alias("w"))


@query()
def local_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in thin places of their trace's values."""
    df = trc(spark, sf_dir).select("trace_id", "idx", (F.col("v") + F.col("idx") * 1e-7).alias("v"))
    return outliers.local_outlier_factor(df, "v").where("lof > 1.5").select("trace_id", "idx", r("lof").alias("lof"))


@query()
def isolated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.isolated(trc(spark, sf_dir), "v").where("isolated").select("trace_id", "idx", r("score").alias("score"))
