"""Filling, verification, metrics, triggers, statistics and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fill, masks, metrics, ranges, runs, stats, triggers
from ..operators.storage import settled
from ..sources import catalogs, names
from .registry import query
from .views import EXP, MISS_RUNS, MISSING, SR, TR, TRC, X, exp, nearest, r, rolling_sql, table, trc

FLAGGED = f"{MISS_RUNS}, fl AS (SELECT *, {MISSING} AS bad FROM trc)"
CLAMP = f"{FLAGGED}, ar AS (SELECT miss.*, a.v AS lv, b.v AS rv FROM miss LEFT JOIN trc a ON a.trace_id = miss.trace_id AND a.idx = s - 1 LEFT JOIN trc b ON b.trace_id = miss.trace_id AND b.idx = e + 1), filled AS (SELECT fl.trace_id, fl.idx, fl.clean, fl.v, bad, CASE WHEN bad THEN coalesce(lv + (rv - lv) * (fl.idx - s + 1) / (e - s + 2), lv, rv) ELSE fl.v END AS w FROM fl LEFT JOIN ar ON ar.trace_id = fl.trace_id AND fl.idx BETWEEN s AND e)"


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(trc(spark, sf_dir).withColumn("bad", masks.missing_counts(F.col("v"))), "flagged")


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(fill.clamped_fill(flagged(spark, sf_dir), "bad", "v", "w"), "filled")


@query(f"WITH {CLAMP} SELECT trace_id, idx, round(w, 6) AS w FROM filled")
def clamped_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.clamped_fill(flagged(spark, sf_dir), "bad", "v", "w").select("trace_id", "idx", r("w").alias("w"))


@query(f"WITH {FLAGGED} SELECT trace_id, count(*) AS n, round(sum(CASE WHEN bad THEN m ELSE v END), 6) AS total FROM fl JOIN (SELECT trace_id, median(v) FILTER (WHERE NOT bad) AS m FROM fl GROUP BY trace_id) USING (trace_id) GROUP BY trace_id")
def median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.median_fill(flagged(spark, sf_dir), "bad", "v", "w").groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("w")).alias("total"))


@query(
    f"WITH {FLAGGED}, sg AS (SELECT *, idx // 40 AS seg_id FROM fl), g AS (SELECT * FROM sg WHERE NOT bad), k AS (SELECT trace_id, seg_id, count(*) AS n, list(idx ORDER BY idx) AS i, list(v ORDER BY idx) AS y FROM g GROUP BY ALL), md AS (SELECT trace_id, median(v) AS m FROM g GROUP BY trace_id),"
    " q AS (SELECT sg.*, n, i, y, m, len(list_filter(i, lambda z: z < sg.idx)) AS p FROM sg LEFT JOIN k USING (trace_id, seg_id) JOIN md USING (trace_id)),"
    " z AS (SELECT *, CASE WHEN p < 1 THEN 1 WHEN p >= n THEN n - 1 ELSE p END AS a FROM q)"
    " SELECT trace_id, idx, round(CASE WHEN NOT bad THEN v WHEN coalesce(n, 0) < 2 THEN m ELSE y[a] + (y[a + 1] - y[a]) * (idx - i[a]) / (i[a + 1] - i[a]) END, 6) AS w FROM z"
)
def segment_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 40 samples, each filled from its own good samples."""
    df = flagged(spark, sf_dir).withColumn("seg_id", F.floor(F.col("idx") / 40))
    return fill.segment_fill(df, "bad", "v", "w").select("trace_id", "idx", r("w").alias("w"))


@query(
    f"WITH {TRC}, gl AS (SELECT trace_id, 1.4826 * median(abs(v - m)) AS g, n FROM trc JOIN (SELECT trace_id, median(v) AS m, max(idx) + 1 AS n FROM trc GROUP BY trace_id) USING (trace_id) GROUP BY trace_id, n), t AS (SELECT trc.*, n FROM trc JOIN gl USING (trace_id)), b AS ({rolling_sql('t', 'v', 3, 3, 'median({})', 'base')}), rs AS (SELECT t.trace_id, t.idx, t.n, t.v, abs(t.v - base) AS res FROM t JOIN b USING (trace_id, idx)), sc AS ({rolling_sql('rs', 'res', 3, 3, 'median({})', 'sc')}),"
    " h AS (SELECT rs.trace_id, rs.idx, rs.v, res > 8.0 * greatest(1.4826 * sc + 1e-9, 0.5 * g) AS hit FROM rs JOIN sc USING (trace_id, idx) JOIN gl USING (trace_id)), i AS (SELECT trace_id, min(idx) AS s, max(idx) AS e FROM (SELECT trace_id, idx, idx - row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS k FROM h WHERE hit) GROUP BY trace_id, k)"
    " SELECT h.trace_id, h.idx, round(coalesce(a.v + (b.v - a.v) * (h.idx - s + 1) / (e - s + 2), a.v, b.v), 6) AS w FROM h JOIN i ON i.trace_id = h.trace_id AND h.idx BETWEEN s AND e LEFT JOIN trc a ON a.trace_id = h.trace_id AND a.idx = s - 1 LEFT JOIN trc b ON b.trace_id = h.trace_id AND b.idx = e + 1"
)
def spike_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(trc(spark, sf_dir).select("trace_id", "idx", "v"), "raw")
    out = fill.spike_fill(df, "v", "w", flag="hit")
    return out.where("hit").select("trace_id", "idx", r("w").alias("w"))


@query(f"""WITH {FLAGGED}, sg AS (SELECT trace_id, k * 500 + 90 AS s, k * 500 + 139 AS e FROM (SELECT trace_id, idx // 500 AS k FROM trc WHERE idx % 500 BETWEEN 90 AND 139 GROUP BY ALL HAVING count(*) = 50) UNION ALL SELECT trace_id, s, e FROM miss WHERE e - s + 1 BETWEEN 3 AND 20 AND s % 500 NOT BETWEEN 60 AND 150),
    nb AS (SELECT sg.trace_id, s, e, v, idx BETWEEN s - 198 AND e + 198 AS near FROM sg JOIN fl ON fl.trace_id = sg.trace_id AND NOT bad AND idx BETWEEN s - 594 AND e + 594 AND (idx < s OR idx > e)),
    lv AS (SELECT trace_id, s, e, CASE WHEN count(*) FILTER (WHERE near) >= 30 THEN 1 ELSE 2 END AS st, CASE WHEN count(*) FILTER (WHERE near) >= 30 THEN median(v) FILTER (WHERE near) ELSE median(v) END AS level FROM nb GROUP BY ALL HAVING count(*) >= 8),
    sc AS (SELECT trace_id, s, e, level, greatest(1.4826 * median(abs(v - level)), 0.5) AS spread FROM nb JOIN lv USING (trace_id, s, e) WHERE st = 2 OR near GROUP BY ALL),
    h AS (SELECT sc.*, idx, v, bad OR abs(v - level) > 4.0 * spread AS hit FROM sc JOIN fl ON fl.trace_id = sc.trace_id AND idx BETWEEN s AND e),
    kn AS (SELECT trace_id, s, idx, v, row_number() OVER (PARTITION BY trace_id, s ORDER BY idx) AS k FROM h WHERE NOT hit),
    w AS (SELECT *, count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY trace_id, s) AS c, count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY trace_id, s ORDER BY idx) AS ka FROM h),
    p AS (SELECT *, CASE WHEN ka = 0 THEN 1 WHEN ka = c THEN c - 1 ELSE ka END AS k FROM w WHERE hit)
SELECT trace_id, idx, w FROM (SELECT p.trace_id, p.idx, p.v AS v0, round(CASE WHEN c < 2 THEN level ELSE a.v + (b.v - a.v) * (p.idx - a.idx) / (b.idx - a.idx) END, 6) AS w FROM p LEFT JOIN kn a ON a.trace_id = p.trace_id AND a.s = p.s AND a.k = p.k LEFT JOIN kn b ON b.trace_id = p.trace_id AND b.s = p.s AND b.k = p.k + 1) WHERE v0 <> w""")
def zscore_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks around missing runs, and short runs by themselves: what is missing or stands out lies on the line of the block's other samples, or at the background's level."""
    df = settled(flagged(spark, sf_dir), "flagged")
    k = F.floor(F.col("idx") / 500)
    whole = df.where((F.col("idx") % 500).between(90, 139)).groupBy("trace_id", k.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n = 50")
    short = runs.runs(df, "bad").where(runs.length().between(3, 20) & ~(F.col("s") % 500).between(60, 150))
    segs = settled(whole.select("trace_id", (F.col("k") * 500 + 90).alias("s"), (F.col("k") * 500 + 139).alias("e")).unionByName(short), "segments")
    out = fill.zscore_fill(df, segs, "bad", "v", "w", SR)
    inside = ranges.samples_in(out, segs)
    return inside.where("v <> w").select("trace_id", "idx", r("w").alias("w"))


@query(f"WITH {FLAGGED}, sg AS (SELECT * FROM miss WHERE e - s + 1 BETWEEN 3 AND 20), nb AS (SELECT sg.trace_id, s, e, v, idx BETWEEN s - 198 AND e + 198 AS near FROM sg JOIN fl ON fl.trace_id = sg.trace_id AND NOT bad AND idx BETWEEN s - 594 AND e + 594 AND (idx < s OR idx > e)), lv AS (SELECT trace_id, s, e, count(*) FILTER (WHERE near) AS n1, median(v) FILTER (WHERE near) AS m1, count(*) AS n2, median(v) AS m2 FROM nb GROUP BY trace_id, s, e), wh AS (SELECT trace_id, median(v) AS m3 FROM fl WHERE NOT bad GROUP BY trace_id) SELECT sg.trace_id, sg.s, sg.e, round(CASE WHEN n1 >= 30 THEN m1 WHEN n2 >= 8 THEN m2 ELSE m3 END, 6) AS level FROM sg LEFT JOIN lv USING (trace_id, s, e) LEFT JOIN wh USING (trace_id)")
def background_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that a missing run of middle length is put at."""
    df = flagged(spark, sf_dir)
    segs = runs.runs(df, "bad").where(runs.length().between(3, 20))
    return fill.background(df, segs, "bad", "v", SR).select("trace_id", "s", "e", r("level").alias("level"))


@query(f"WITH {CLAMP} SELECT trace_id, count(*) AS n, round(sqrt(avg((w - clean) * (w - clean))), 6) AS rmse, round(avg(abs(w - clean)), 6) AS mae, round(10 * log10(sum(clean * clean) / sum((w - clean) * (w - clean) + 1e-12)), 6) AS snr_db, round(var_pop(w) / var_pop(clean), 6) AS energy_ratio, round(stddev_pop(w) / stddev_pop(clean), 6) AS std_ratio, bool_and(w IS NOT NULL AND NOT isnan(w)) AS valid FROM filled GROUP BY trace_id")
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.errors("clean", "w")
    return filled(spark, sf_dir).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), *((c if n == "valid" else r(c)).alias(n) for n, c in m.items()))


@query(f"WITH {CLAMP}, p AS (SELECT trace_id, clean AS v, 1 AS a, 0 AS b FROM filled UNION ALL SELECT trace_id, w, 0, 1 FROM filled), q AS (SELECT trace_id, v, sum(a) AS a, sum(b) AS b FROM p GROUP BY trace_id, v), c AS (SELECT trace_id, sum(a) OVER w / sum(a) OVER (PARTITION BY trace_id) AS f, sum(b) OVER w / sum(b) OVER (PARTITION BY trace_id) AS g, lead(v) OVER (PARTITION BY trace_id ORDER BY v) - v AS dx FROM q WINDOW w AS (PARTITION BY trace_id ORDER BY v ROWS UNBOUNDED PRECEDING)) SELECT trace_id, round(sum(abs(f - g) * coalesce(dx, 0)), 6) AS wasserstein FROM c GROUP BY trace_id")
def wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = filled(spark, sf_dir)
    out = metrics.wasserstein(df.select("trace_id", F.col("clean").alias("v")), df.select("trace_id", F.col("w").alias("v")), ["trace_id"])
    return out.select("trace_id", r("wasserstein").alias("wasserstein"))


@query(f"WITH {CLAMP}, d AS (SELECT trace_id, idx, clean - avg(clean) OVER (PARTITION BY trace_id) AS x, w - avg(w) OVER (PARTITION BY trace_id) AS y FROM filled), c AS (SELECT p.trace_id, p.idx - q.idx AS lag, sum(p.x * q.x) AS cx, sum(p.y * q.y) AS cy FROM d p JOIN d q ON p.trace_id = q.trace_id AND q.idx BETWEEN p.idx - 19 AND p.idx GROUP BY ALL), z AS (SELECT trace_id, cx AS x0, cy AS y0 FROM c WHERE lag = 0) SELECT trace_id, round(sqrt(avg((cx / x0 - cy / y0) * (cx / x0 - cy / y0))), 6) AS acf_l2 FROM c JOIN z USING (trace_id) GROUP BY trace_id")
def acf_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.acf_distance(filled(spark, sf_dir), "clean", "w", 20).select("trace_id", r("acf_l2").alias("acf_l2"))


@query(f"WITH {CLAMP}, t AS (SELECT *, stddev_pop(v) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING) AS sd FROM filled), i AS (SELECT trace_id, min(idx) AS s, max(idx) AS e FROM (SELECT trace_id, idx, idx - row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS k FROM t WHERE abs(v - w) > 1e-9) GROUP BY trace_id, k) SELECT i.trace_id, i.s, i.e, i.e - i.s + 1 AS length, round(abs(b.w - a.w) / greatest(a.sd, 1e-12), 6) AS jump_left, round(abs(d.w - c.w) / greatest(d.sd, 1e-12), 6) AS jump_right FROM i LEFT JOIN t a ON a.trace_id = i.trace_id AND a.idx = i.s - 1 LEFT JOIN t b ON b.trace_id = i.trace_id AND b.idx = i.s LEFT JOIN t c ON c.trace_id = i.trace_id AND c.idx = i.e LEFT JOIN t d ON d.trace_id = i.trace_id AND d.idx = i.e + 1")
def seam_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.seams(filled(spark, sf_dir), "v", "w", 33)
    return out.select("trace_id", "s", "e", "length", r("jump_left").alias("jump_left"), r("jump_right").alias("jump_right"))


@query(f"WITH {CLAMP}, safe AS (SELECT trace_id, s, e FROM miss WHERE e - s + 1 > 20), t AS (SELECT f.trace_id, f.idx, f.v, CASE WHEN EXISTS (SELECT 1 FROM safe WHERE safe.trace_id = f.trace_id AND f.idx BETWEEN s AND e) THEN f.v ELSE w END AS w, bad, EXISTS (SELECT 1 FROM safe WHERE safe.trace_id = f.trace_id AND f.idx BETWEEN s AND e) AS sf FROM filled f) SELECT trace_id, count(*) FILTER (WHERE (w <= -1 OR w = 0) AND NOT sf) AS missing_residual, count(*) FILTER (WHERE bad AND NOT sf AND w = 0) AS zero_holes, count(*) FILTER (WHERE NOT bad AND NOT sf AND v IS DISTINCT FROM w) AS untouched_leak, count(*) FILTER (WHERE v IS DISTINCT FROM w) AS changed, bool_and(NOT ((w <= -1 OR w = 0) AND NOT sf) AND NOT (bad AND NOT sf AND w = 0) AND NOT (NOT bad AND NOT sf AND v IS DISTINCT FROM w)) AS ok FROM t GROUP BY trace_id")
def file_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long runs are kept as they were, short ones are filled; then the file is checked against what was to be done."""
    from ..operators import ranges

    df = filled(spark, sf_dir)
    found = settled(runs.runs(df, "bad"), "runs")
    safe = found.where(runs.length() > 20)
    kept = ranges.samples_in(df.select("trace_id", "idx"), safe).select("trace_id", "idx", F.lit(True).alias("_k"))
    df = settled(df.join(kept, ["trace_id", "idx"], "left").withColumn("w", F.when(F.col("_k"), F.col("v")).otherwise(F.col("w"))).drop("_k"), "written")
    return metrics.file_checks(df, safe, "v", "w", F.col("bad"), masks.missing_counts(F.col("w")), found)


STA = f"{X}, a AS (SELECT trace_id, idx, sqrt(sum(x * x) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6) AS env FROM x), rt AS (SELECT trace_id, idx, env / greatest(sum(env) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN 198 PRECEDING AND 198 FOLLOWING) / 397, 1e-12) AS r FROM a)"


def sta_lta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.ratio(settled(masks.without_dc(trc(spark, sf_dir)).select("trace_id", "idx", "x"), "x"), "x", "r", 6, 397)


@query(f"WITH {STA} SELECT trace_id, idx, round(r, 6) AS r FROM rt")
def sta_lta_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sta_lta(spark, sf_dir).select("trace_id", "idx", r("r").alias("r"))


TRIGGER = f"{STA}, on_runs AS (SELECT trace_id, min(idx) AS s, max(idx) AS e FROM (SELECT trace_id, idx, idx - row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS k FROM rt WHERE r > 1.31) GROUP BY trace_id, k), tm AS (SELECT trace_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY s) AS g FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY trace_id ORDER BY s) <= 13 THEN 0 ELSE 1 END AS new FROM on_runs)) GROUP BY trace_id, g), trig AS (SELECT * FROM tm WHERE e - s + 1 >= 6)"


@query(f"WITH {TRIGGER} SELECT trace_id, s, e FROM trig")
def trigger_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.intervals(settled(sta_lta(spark, sf_dir), "ratio"), "r", 1.31, 13, 6)


@query(f"WITH {X}, q AS (SELECT trace_id, idx, CASE WHEN idx < 197 THEN 0 ELSE avg(x * x) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / greatest(avg(x * x) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN 197 PRECEDING AND CURRENT ROW), 1e-12) END AS r FROM x), h AS (SELECT trace_id, min(idx) AS f, max(idx) AS e FROM (SELECT trace_id, idx, idx - row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS k FROM q WHERE r >= 1.113) GROUP BY trace_id, k) SELECT h.trace_id, min(q.idx) AS s, h.e FROM h JOIN q ON q.trace_id = h.trace_id AND q.idx BETWEEN f AND e AND r > 2.217 GROUP BY h.trace_id, f, h.e")
def classic_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(masks.without_dc(trc(spark, sf_dir)).select("trace_id", "idx", "x"), "x")
    return triggers.hysteresis(settled(triggers.classic_ratio(df, "x", "r", 6, 198), "ratio"), "r", 2.217, 1.113)


CENTRES = f"{TRIGGER}, c AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY c) AS i FROM (SELECT DISTINCT trace_id, (idx // 400) * 400 + 200 AS c FROM x)), tj AS (SELECT *, (s + e) / 2.0 AS m, row_number() OVER (PARTITION BY trace_id ORDER BY s) AS j FROM trig), rec AS (SELECT DISTINCT trace_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS last, CAST(NULL AS BIGINT) AS hit FROM c UNION ALL SELECT c.trace_id, c.i, coalesce(min(tj.j), any_value(rec.last)), min(tj.j) FROM rec JOIN c ON c.trace_id = rec.trace_id AND c.i = rec.i + 1 LEFT JOIN tj ON tj.trace_id = c.trace_id AND tj.j > rec.last AND abs(tj.m - c.c) <= 120 GROUP BY c.trace_id, c.i), hits AS (SELECT c.trace_id, c.c, tj.s, tj.e, tj.m FROM c JOIN rec ON rec.trace_id = c.trace_id AND rec.i = c.i LEFT JOIN tj ON tj.trace_id = c.trace_id AND tj.j = rec.hit)"


@query(f"WITH RECURSIVE {CENTRES} SELECT trace_id, c, s, e FROM hits")
def trigger_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.matched(*found_and_centres(spark, sf_dir), 120)


def found_and_centres(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ratio = settled(sta_lta(spark, sf_dir), "ratio")
    found = settled(triggers.intervals(ratio, "r", 1.31, 13, 6), "triggers")
    return found, ratio.select("trace_id", (F.floor(F.col("idx") / 400) * 400 + 200).alias("c")).distinct()


@query(f"WITH RECURSIVE {CENTRES} SELECT h.trace_id, round(count(h.s) / count(*), 6) AS keep_rate, round(CASE WHEN any_value(t.n) > 0 THEN (any_value(t.n) - count(h.s)) / any_value(t.n) END, 6) AS false_rate, round(avg(abs(h.m - h.c)), 6) AS time_error FROM hits h LEFT JOIN (SELECT trace_id, count(*) AS n FROM trig GROUP BY trace_id) t ON t.trace_id = h.trace_id GROUP BY h.trace_id")
def trigger_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many known events are found again, and how many triggers are none."""
    out = triggers.rates(*found_and_centres(spark, sf_dir), 120)
    return out.select("trace_id", *(r(c).alias(c) for c in ("keep_rate", "false_rate", "time_error")))


@query(f"WITH {TRC}, m AS (SELECT trace_id, median(v) AS m FROM trc GROUP BY trace_id), d AS (SELECT trace_id, m, 1.4826 * median(abs(v - m)) AS sc FROM trc JOIN m USING (trace_id) GROUP BY trace_id, m), w AS (SELECT trace_id, (idx - o) // 128 * 128 + o AS s, abs(v - m) > 2.5 * sc AS f FROM trc JOIN d USING (trace_id), (VALUES (0), (64)) t(o) WHERE idx >= o) SELECT trace_id, s, round(avg(f::INT), 6) AS density FROM w GROUP BY trace_id, s HAVING count(*) = 128")
def anomaly_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of outliers in windows of 128 samples, half overlapping: two tumbling copies."""
    df = masks.mad_outliers(settled(trc(spark, sf_dir).select("trace_id", "idx", "v"), "raw"), "v", 2.5, "o")
    df = df.withColumn("off", F.explode(F.array(F.lit(0), F.lit(64)))).where("idx >= off")
    s = F.floor((F.col("idx") - F.col("off")) / 128) * 128 + F.col("off")
    return df.groupBy("trace_id", s.alias("s")).agg(r(F.avg(F.col("o").cast("double"))).alias("density"), F.count(F.lit(1)).alias("n")).where("n = 128").drop("n")


@query(f"WITH {EXP}, l AS (SELECT unit, method, record, 'rmse' AS metric, rmse AS value FROM ex UNION ALL SELECT unit, method, record, 'acf', acf FROM ex UNION ALL SELECT unit, method, record, 'std_ratio', abs(std_ratio - 1) FROM ex) SELECT method, metric, count(value) AS n, count(DISTINCT value) AS n_values, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM l GROUP BY method, metric")
def dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = stats.long_form(exp(spark, sf_dir), ["unit", "method", "record"], ["rmse", "acf", "std_ratio"]).withColumn("value", stats.oriented(F.col("metric"), F.col("value")))
    out = stats.dispersion(long.withColumn("value", F.col("value")), ["method", "metric"])
    return out.select("method", "metric", "n", "n_values", *(r(c).alias(c) for c in ("median", "q1", "q3", "mean", "sd")))


@query("SELECT l_suppkey AS unit, l_returnflag AS method, count(*) AS n, round(CASE WHEN count(*) >= 4 THEN (sum(l_quantity) - min(l_quantity) - max(l_quantity)) / (count(*) - 2) ELSE avg(l_quantity) END, 6) AS trimmed FROM lineitem GROUP BY l_suppkey, l_returnflag")
def trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("method"), "l_quantity")
    return stats.trimmed_mean(rows, ["unit", "method"], "l_quantity").withColumn("trimmed", r("trimmed"))


@query(f"WITH {EXP} SELECT record, round(quantile_cont(rmse, 0.5) FILTER (WHERE method = 'A'), 6) AS a, round(quantile_cont(rmse, 0.5) FILTER (WHERE method = 'N'), 6) AS n, round(quantile_cont(rmse, 0.5) FILTER (WHERE method = 'R'), 6) AS r, round(quantile_cont(rmse, 0.5) FILTER (WHERE method = 'A') - quantile_cont(rmse, 0.5) FILTER (WHERE method = 'N'), 6) AS a_vs_n FROM ex GROUP BY record")
def per_record_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = exp(spark, sf_dir).groupBy("record").pivot("method", ["A", "N", "R"]).agg(F.percentile("rmse", F.lit(0.5)))
    return wide.select("record", r("A").alias("a"), r("N").alias("n"), r("R").alias("r"), r(F.col("A") - F.col("N")).alias("a_vs_n"))


PAIRS = f"{EXP}, pr AS (SELECT unit, record, max(rmse) FILTER (WHERE method = 'A') AS one, max(rmse) FILTER (WHERE method = 'N') AS other FROM ex WHERE method IN ('A', 'N') GROUP BY unit, record), pd AS (SELECT *, round(one - other, 4) AS d FROM pr WHERE one IS NOT NULL AND other IS NOT NULL)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.paired(exp(spark, sf_dir), ["unit", "record"], "method", "rmse", "A", "N").withColumn("d", nearest(F.col("d"), 4))


@query(f"WITH {PAIRS} SELECT record, count(*) AS n_pairs, round(quantile_cont(d, 0.5), 6) AS median_diff, round(avg(d), 6) AS mean_diff, round(avg((d < 0)::INT), 6) AS share_better FROM pd GROUP BY record")
def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return pairs(spark, sf_dir).groupBy("record").agg(F.count(F.lit(1)).alias("n_pairs"), r(F.percentile(d, F.lit(0.5))).alias("median_diff"), r(F.avg(d)).alias("mean_diff"), r(F.avg((d < 0).cast("double"))).alias("share_better"))


@query(f"WITH {PAIRS}, k AS (SELECT record, d, rank() OVER (PARTITION BY record ORDER BY abs(d)) + (count(*) OVER (PARTITION BY record, abs(d)) - 1) / 2.0 AS rk FROM pd WHERE d <> 0) SELECT record, round(coalesce(sum(rk) FILTER (WHERE d > 0), 0), 6) AS w_plus, round(coalesce(sum(rk) FILTER (WHERE d < 0), 0), 6) AS w_minus, count(*) AS n, round((coalesce(sum(rk) FILTER (WHERE d > 0), 0) - coalesce(sum(rk) FILTER (WHERE d < 0), 0)) / sum(rk), 6) AS rank_biserial FROM k GROUP BY record")
def signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.signed_ranks(pairs(spark, sf_dir), ["record"])
    return out.select("record", r("w_plus").alias("w_plus"), r("w_minus").alias("w_minus"), "n", r("rank_biserial").alias("rank_biserial"))


@query("WITH p AS (SELECT l_suppkey % 7 AS family, l_suppkey AS unit, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE avg(l_tax) END AS p FROM lineitem GROUP BY l_suppkey), q AS (SELECT *, least(1, (count(p) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST, unit) + 1) * p) AS raw FROM p) SELECT family, unit, round(p, 9) AS p, round(CASE WHEN p IS NOT NULL THEN max(raw) OVER (PARTITION BY family ORDER BY p NULLS LAST, unit ROWS UNBOUNDED PRECEDING) END, 6) AS holm FROM q")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.avg("l_tax").alias("p"))
    p = p.select((F.col("unit") % 7).alias("family"), "unit", F.when(F.col("unit") % 11 != 0, F.col("p")).alias("p"))
    return stats.holm(p, ["family"], "p", ["unit"]).select("family", "unit", r("p", 9).alias("p"), r("holm").alias("holm"))


@query(f"WITH {EXP} SELECT ex.unit, ex.method, round(100 * (ex.acf - b.acf) / b.acf, 6) AS change_pct FROM ex JOIN ex b ON b.unit = ex.unit AND b.method = 'N'")
def degradation_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.against_baseline(exp(spark, sf_dir), ["unit"], "method", "acf", "N")
    return out.select("unit", "method", r("change_pct").alias("change_pct"))


FILES = "files AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'broken.' || o_orderkey || '.mseed' WHEN o_orderkey % 5 = 0 THEN 'XA.S' || (11 + o_custkey % 6) || '.01.MHZ.' || d || '_070152-' || d || '_190149.mseed' ELSE 'XA.S' || (11 + o_custkey % 6) || '.' || d || '.mseed' END AS name, o_orderkey AS length, o_orderkey % 17 = 0 AS broken, 'S' || (11 + o_custkey % 6) AS st, d, o_orderkey % 5 = 0 AS frag FROM (SELECT *, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS VARCHAR) AS d FROM orders))"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made of orders, every 17th malformed."""
    d = F.date_format("o_orderdate", "yyyyMMdd")
    sta = F.concat(F.lit("XA.S"), (11 + F.col("o_custkey") % 6).cast("string"), F.lit("."))
    name = F.when(F.col("o_orderkey") % 17 == 0, F.concat(F.lit("broken."), F.col("o_orderkey").cast("string"), F.lit(".mseed"))).when(F.col("o_orderkey") % 5 == 0, F.concat(sta, F.lit("01.MHZ."), d, F.lit("_070152-"), d, F.lit("_190149.mseed"))).otherwise(F.concat(sta, d, F.lit(".mseed")))
    return names.parsed(table(spark, sf_dir, "orders").select(name.alias("name"), F.col("o_orderkey").alias("length")))


@query(f"WITH {FILES} SELECT name, length, CASE WHEN NOT broken THEN 'XA' END AS net, CASE WHEN NOT broken THEN st END AS sta, CASE WHEN broken THEN NULL WHEN frag THEN '01' ELSE '' END AS loc, CASE WHEN broken THEN NULL WHEN frag THEN 'MHZ' ELSE '' END AS cha, CASE WHEN NOT broken THEN d END AS day FROM files")
def parsed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir)


@query(f"WITH {FILES} SELECT count(*) AS seen, count(*) FILTER (WHERE broken) AS bad_name, count(*) FILTER (WHERE NOT broken AND st NOT IN ('S12', 'S14')) AS bad_sta, count(*) FILTER (WHERE NOT broken AND st IN ('S12', 'S14') AND CAST(d AS INT) NOT BETWEEN 19940101 AND 19961231) AS bad_day, count(DISTINCT CASE WHEN NOT broken THEN st END) AS stations FROM files")
def diagnosed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.diagnosed(files(spark, sf_dir), ["S12", "S14"], 19940101, 19961231)


@query(f"WITH {FILES} SELECT substr(d, 1, 4) || '-' || substr(d, 5, 2) AS ym, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, round(CAST(count(*) * 0.9 AS DOUBLE), 6) AS est_sec FROM files WHERE NOT broken GROUP BY 1")
def quick_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.quick_scan(files(spark, sf_dir)).withColumn("est_sec", r("est_sec"))


@query(f"WITH {FILES}, l AS (SELECT unnest(CASE WHEN frag THEN ['XA.' || st || '.01.MHZ', st] ELSE ['XA.' || st, st] END) AS label, d AS day, name FROM files WHERE NOT broken) SELECT label, day, min(name) AS path FROM l GROUP BY label, day")
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.first_per_label(files(spark, sf_dir).withColumn("path", F.col("name")))


CATALOG = "ct AS (SELECT 'S' || (11 + l_suppkey % 6) AS station, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS VARCHAR) AS day, l_partkey % 500 AS s, l_partkey % 500 + CAST(l_quantity AS BIGINT) AS e, CASE WHEN l_linenumber % 5 = 0 THEN 'event' WHEN l_linenumber % 7 = 0 THEN 'gap' ELSE 'repair' END AS role, CASE WHEN l_quantity <= 2 THEN 'linear' WHEN l_quantity <= 20 THEN 'zscore' ELSE 'core' END AS method FROM lineitem)"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    s = F.col("l_partkey") % 500
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.concat(F.lit("S"), (11 + F.col("l_suppkey") % 6).cast("string")).alias("station"), F.date_format("l_shipdate", "yyyyMM").alias("day"), s.alias("s"), (s + q).alias("e"), F.when(F.col("l_linenumber") % 5 == 0, "event").when(F.col("l_linenumber") % 7 == 0, "gap").otherwise("repair").alias("role"), F.when(q <= 2, "linear").when(q <= 20, "zscore").otherwise("core").alias("method"))


@query(f"WITH {CATALOG} SELECT station, day, s, e, 'repair' AS kind, method, '' AS note, round((e - s + 1) / {SR}, 1) AS len_s FROM ct a WHERE role = 'repair' AND NOT EXISTS (SELECT 1 FROM ct b WHERE b.role = 'event' AND b.station = a.station AND b.day = a.day AND b.s <= a.s AND a.e <= b.e) UNION ALL SELECT station, day, s, e, role, CASE WHEN role = 'event' THEN 'catalog_protect' ELSE 'keep' END, CASE WHEN role = 'gap' THEN 'no data' ELSE '' END, round((e - s + 1) / {SR}, 1) FROM ct WHERE role <> 'repair'")
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.catalog_rows(catalog(spark, sf_dir), SR)


@query(f"WITH {CATALOG}, o AS (SELECT DISTINCT station, day, s, e, role AS kind, method FROM ct) SELECT station, day, s, e, kind, method, CASE WHEN s % 3 = 0 THEN 'new' ELSE 'old' END AS note FROM o")
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).withColumnRenamed("role", "kind")
    return catalogs.upserted(rows.withColumn("note", F.lit("old")), rows.where("s % 3 = 0").withColumn("note", F.lit("new")))


@query(f"WITH {CATALOG} SELECT station, substr(day, 1, 4) AS year, role AS kind, count(*) AS n, CAST(sum(e - s + 1) AS BIGINT) AS samples FROM ct GROUP BY 1, 2, 3")
def catalog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).groupBy("station", F.substring("day", 1, 4).alias("year"), F.col("role").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(runs.length()).alias("samples"))


@query(f"WITH {TR}, w AS (SELECT trace_id, idx // 100 AS k, regr_slope(v, idx) AS b, regr_intercept(v, idx) AS a, sqrt(avg(v * v)) AS rms FROM tr GROUP BY ALL HAVING count(*) = 100) SELECT trace_id, k, round(b, 6) AS slope, round(a, 3) AS intercept, round(rms, 6) AS rms FROM w")
def window_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares line and RMS of windows of 100 samples."""
    from .views import tr

    rows = tr(spark, sf_dir).groupBy("trace_id", F.floor(F.col("idx") / 100).alias("k"))
    out = rows.agg(F.regr_slope("v", "idx").alias("b"), F.regr_intercept("v", "idx").alias("a"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.count(F.lit(1)).alias("n")).where("n = 100")
    return out.select("trace_id", "k", r("b").alias("slope"), r("a", 3).alias("intercept"), r("rms").alias("rms"))



