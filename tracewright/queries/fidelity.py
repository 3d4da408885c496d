"""Repaired traces against natural steps, bands and triggers; statistics at several levels; known results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks, metrics, runs, stats, triggers
from ..operators.storage import settled
from .quality import CLAMP, FILES, PAIRS, files, filled, pairs
from .registry import query
from .repair import U
from .views import EXP, RUNS, TRC, exp, r, trc

CHANGED = f"{CLAMP}, ch AS (SELECT *, abs(v - w) > 1e-9 AS changed FROM filled), cr AS ({RUNS.format(table='ch', cond='changed')}), nn AS (SELECT trace_id, max(idx) + 1 AS n FROM filled GROUP BY trace_id)"
SEAMS = f"""{CHANGED}, lo AS (SELECT trace_id, idx, v, w, changed, stddev_pop(v) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 32 FOLLOWING) AS l FROM ch),
    wh AS (SELECT lo.trace_id, n, stddev_pop(v) AS whole, max(l) FILTER (WHERE idx = greatest(n - 33, 0)) AS last FROM lo JOIN nn USING (trace_id) GROUP BY lo.trace_id, n),
    sc AS (SELECT lo.trace_id, idx, v, w, changed, n, CASE WHEN idx <= n - 33 THEN l ELSE last END AS l, whole FROM lo JOIN wh USING (trace_id)), sk AS (SELECT *, CASE WHEN l > 1e-9 THEN l ELSE whole END AS scale FROM sc),
    jp AS (SELECT cr.trace_id, cr.s, cr.e - cr.s + 1 AS length, greatest(abs(b.w - a.v) / nullif(x.scale, 0), abs(c.w - d.v) / nullif(y.scale, 0)) AS most FROM cr JOIN nn ON nn.trace_id = cr.trace_id AND s > 0 AND e < n - 1 JOIN sk a ON a.trace_id = cr.trace_id AND a.idx = s - 1 JOIN sk b ON b.trace_id = cr.trace_id AND b.idx = s JOIN sk c ON c.trace_id = cr.trace_id AND c.idx = e JOIN sk d ON d.trace_id = cr.trace_id AND d.idx = e + 1 JOIN sk x ON x.trace_id = cr.trace_id AND x.idx = greatest(s - 33, 0) JOIN sk y ON y.trace_id = cr.trace_id AND y.idx = e + 1),
    js AS (SELECT trace_id, count(*) AS n_runs, arg_max(length, length * 1000000000 - s) AS longest, arg_max(most, length * 1000000000 - s) AS longest_jump, median(most) AS median_jump, max(most) AS greatest_jump FROM jp GROUP BY trace_id),
    ns AS (SELECT trace_id, step FROM (SELECT trace_id, changed, l, abs(lead(v) OVER o - v) / nullif(l, 0) AS step, lead(changed) OVER o AS c FROM sk WINDOW o AS (PARTITION BY trace_id ORDER BY idx)) WHERE NOT changed AND NOT c AND l > 1e-9)"""


@query(f"WITH {SEAMS} SELECT js.trace_id, n_runs, longest, round(longest_jump, 6) AS longest_jump, round(median_jump, 6) AS median_jump, round(greatest_jump, 6) AS greatest_jump, round(quantile_cont(step, 0.5), 6) AS p50, round(quantile_cont(step, 0.95), 6) AS p95, round(100 * avg((step < greatest_jump)::INT), 6) AS greatest_pct, round(100 * avg((step < longest_jump)::INT), 6) AS longest_pct FROM js JOIN ns USING (trace_id) GROUP BY js.trace_id, n_runs, longest, longest_jump, median_jump, greatest_jump")
def seam_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the jumps at seams lie among the steps that samples make by themselves."""
    out = metrics.seam_percentiles(filled(spark, sf_dir), "v", "w", 33)
    numbers = ("longest_jump", "median_jump", "greatest_jump", "p50", "p95", "greatest_pct", "longest_pct")
    return out.select("trace_id", "n_runs", "longest", *(r(c).alias(c) for c in numbers))


BAND = f"""{CHANGED}, dm AS (SELECT trace_id, s, e, n FROM (SELECT cr.*, n, row_number() OVER (PARTITION BY cr.trace_id ORDER BY e - s DESC, s) AS k FROM cr JOIN nn USING (trace_id)) WHERE k = 1),
    wn AS (SELECT trace_id, width, w0, w0 + width - 1 AS w1 FROM (SELECT trace_id, n, width, greatest((s + e) // 2 - width // 2, 0) AS w0 FROM dm, (VALUES (50), (100), (200)) t(width)) WHERE w0 + width - 1 < n),
    ow AS (SELECT wn.*, (SELECT avg(w) FROM filled f WHERE f.trace_id = wn.trace_id AND idx BETWEEN w0 AND w1) AS own FROM wn),
    hl AS (SELECT ow.trace_id, width, own, idx // width AS k, round(avg(v), 9) AS m FROM ow JOIN filled f ON f.trace_id = ow.trace_id GROUP BY ow.trace_id, width, own, w0, w1, idx // width HAVING count(*) = width AND ((idx // width) * width + width - 1 < w0 OR (idx // width) * width > w1)),
    nh AS (SELECT trace_id, width, count(*) AS windows, median(round(abs(m - own), 9)) AS t FROM hl GROUP BY trace_id, width)"""


@query(f"WITH {BAND}, pp AS (SELECT a.trace_id, a.width, count(*) AS n, count(*) FILTER (WHERE round(abs(a.m - b.m), 9) < t) AS c FROM hl a JOIN hl b ON a.trace_id = b.trace_id AND a.width = b.width AND a.k < b.k JOIN nh ON nh.trace_id = a.trace_id AND nh.width = a.width GROUP BY a.trace_id, a.width) SELECT nh.trace_id, nh.width, windows, round(t, 6) AS to_healthy, round(100.0 * c / n, 6) AS band_pct FROM nh LEFT JOIN pp USING (trace_id, width)")
def band_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the window around each trace's longest repair lies in the band of its healthy windows, for three widths."""
    from pyspark.sql import Window

    df = filled(spark, sf_dir)
    found = runs.runs(df.withColumn("_c", F.abs(F.col("v") - F.col("w")) > 1e-9), "_c")
    longest = found.withColumn("_k", F.row_number().over(Window.partitionBy("trace_id").orderBy(runs.length().desc(), "s"))).where("_k = 1").drop("_k")
    out = metrics.band_percentiles(df, "v", "w", settled(longest, "longest"), [50, 100, 200])
    return out.select("trace_id", "width", "windows", r("to_healthy").alias("to_healthy"), r("band_pct").alias("band_pct"))


THRESHOLDS = [1.5, 2.0, 3.0, 4.0]
ONSETS = f"""{CLAMP}, se AS (SELECT trace_id, idx, 'clean' AS series, clean - avg(clean) OVER (PARTITION BY trace_id) AS x FROM filled UNION ALL SELECT trace_id, idx, 'w', w - avg(w) OVER (PARTITION BY trace_id) FROM filled),
    cf AS (SELECT trace_id, series, idx, CASE WHEN idx < 197 THEN 0 ELSE (sum(x * x) OVER (PARTITION BY trace_id, series ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / 6) / greatest((sum(x * x) OVER (PARTITION BY trace_id, series ORDER BY idx ROWS BETWEEN 197 PRECEDING AND CURRENT ROW)) / 198, 1e-12) END AS r FROM se),
    th AS (SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES (1.5), (2.0), (3.0), (4.0)) v(t)), qq AS (SELECT *, r / threshold AS q FROM cf, th),
    hr AS (SELECT trace_id, series, threshold, min(idx) AS f, max(idx) AS e FROM (SELECT *, idx - row_number() OVER (PARTITION BY trace_id, series, threshold ORDER BY idx) AS k FROM qq WHERE q >= 0.6) GROUP BY trace_id, series, threshold, k),
    fo AS (SELECT hr.trace_id, hr.series, hr.threshold, min(idx) AS s, e FROM hr JOIN qq USING (trace_id, series, threshold) WHERE q > 1 AND idx BETWEEN f AND e GROUP BY hr.trace_id, hr.series, hr.threshold, f, e),
    wd AS (SELECT DISTINCT trace_id, greatest(idx // 500 * 500 + 100 - 50, 0) AS w0, idx // 500 * 500 + 130 + 50 AS w1 FROM filled)"""


@query(f"WITH {ONSETS}, ht AS (SELECT series, threshold, count(*) AS hits FROM fo JOIN wd ON wd.trace_id = fo.trace_id AND s BETWEEN w0 AND w1 GROUP BY ALL), gr AS (SELECT series, threshold, coalesce(hits, 0) / (SELECT count(*) FROM wd) AS mean FROM (VALUES ('clean'), ('w')) n(series) CROSS JOIN th LEFT JOIN ht USING (series, threshold)) SELECT gr.series, gr.threshold, round(gr.mean, 6) AS mean, round(100 * gr.mean / nullif(t.mean, 0), 6) AS retained_pct FROM gr JOIN gr t ON t.threshold = gr.threshold AND t.series = 'clean'")
def trigger_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers in and beside repaired windows at several thresholds, against those of the truth."""
    df = filled(spark, sf_dir)
    k = F.floor(F.col("idx") / 500) * 500
    windows = df.select("trace_id", F.greatest(k + 50, F.lit(0)).alias("s"), (k + 180).alias("e")).distinct()
    found = triggers.onsets(df.select("trace_id", "idx", "clean", "w"), ["clean", "w"], THRESHOLDS, 0.6, 6, 198)
    out = triggers.retention(found, windows, "clean", ["clean", "w"], THRESHOLDS)
    return out.select("series", "threshold", r("mean").alias("mean"), r("retained_pct").alias("retained_pct"))


@query(f"WITH {CLAMP} SELECT trace_id, count(*) AS n_raw, count(*) FILTER (WHERE idx % 1009 <> 5) AS n_repaired, count(*) FILTER (WHERE idx % 1009 = 5) AS unmatched, count(*) FILTER (WHERE idx % 1009 = 5) = 0 AS same FROM filled GROUP BY trace_id")
def paired_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of each trace, one of which lost samples."""
    df = filled(spark, sf_dir).select("trace_id", "idx")
    return metrics.sizes(df, df.where(F.col("idx") % 1009 != 5))


@query(f"WITH {CHANGED}, kn AS (SELECT trace_id, idx // 250 * 250 AS s, idx // 250 * 250 + 249 AS e, CAST(count(*) FILTER (WHERE clean <> v) AS BIGINT) AS expected FROM filled GROUP BY ALL) SELECT kn.trace_id, s, e, expected, count(*) FILTER (WHERE v IS DISTINCT FROM w) AS changed, count(*) FILTER (WHERE v IS DISTINCT FROM w) = expected AS as_expected FROM kn JOIN filled f ON f.trace_id = kn.trace_id AND idx BETWEEN s AND e GROUP BY kn.trace_id, s, e, expected")
def known_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 250 samples with the number of planted faults, against what was changed."""
    df = filled(spark, sf_dir)
    k = F.floor(F.col("idx") / 250) * 250
    known = df.groupBy("trace_id", k.alias("s"), (k + 249).alias("e")).agg(F.count_if(F.col("clean") != F.col("v")).alias("expected"))
    return metrics.against_known(df, known, "v", "w")


LEVELS = f"""{PAIRS}, lv AS (SELECT 'unit' AS level, round(one - other, 9) AS d FROM pd UNION ALL SELECT 'record', round(median(one) - median(other), 9) FROM pd GROUP BY record UNION ALL SELECT 'record_scenario', round(median(one) - median(other), 9) FROM pd GROUP BY record, unit // 6 % 4),
    rk AS (SELECT level, d, rank() OVER (PARTITION BY level ORDER BY abs(d)) + (count(*) OVER (PARTITION BY level, abs(d)) - 1) / 2.0 AS k FROM lv WHERE d <> 0), ws AS (SELECT level, coalesce(sum(k) FILTER (WHERE d > 0), 0) AS p, coalesce(sum(k) FILTER (WHERE d < 0), 0) AS m FROM rk GROUP BY level)"""


@query(f"WITH {LEVELS} SELECT lv.level, count(d) AS n, round(median(d), 6) AS median_diff, round(avg((d < 0)::INT), 6) AS share_better, round(any_value((p - m) / (p + m)), 6) AS rank_biserial, round(any_value(least(p, m)), 6) AS w, round(least(1, 2 / pow(2, count(d))), 9) AS floor FROM lv LEFT JOIN ws USING (level) GROUP BY lv.level")
def three_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods compared by units, by records, and by records and scenarios."""
    rows = pairs(spark, sf_dir).withColumn("scenario", F.floor(F.col("unit") / 6) % 4)
    out = stats.levels(rows, {"unit": ["unit", "record"], "record": ["record"], "record_scenario": ["record", "scenario"]})
    return out.select("level", "n", *(r(c).alias(c) for c in ("median_diff", "share_better", "rank_biserial", "w")), r("floor", 9).alias("floor"))


@query(f"WITH {PAIRS} SELECT unit, record, d, row_number() OVER (PARTITION BY record ORDER BY abs(d), unit) AS rank FROM pd")
def ordinal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select("unit", "record", "d", F.abs("d").alias("a"))
    return stats.ordinal_ranks(rows, ["record"], "a", ["unit"]).drop("a")


@query(f"WITH {EXP}, cm AS (SELECT method, record, median(rmse) AS m FROM ex GROUP BY method, record), cn AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY record) - 1 AS i, count(*) OVER (PARTITION BY method) AS k FROM cm), tk AS (SELECT method, k, draw, CAST(floor({U.format(draw='draw', unit='i')} * k) AS BIGINT) AS i FROM cn, range(1, 20001) t(draw)), md AS (SELECT tk.method, tk.k, draw, median(m) AS d FROM tk JOIN cn ON cn.method = tk.method AND cn.i = tk.i GROUP BY tk.method, tk.k, draw) SELECT method, k AS clusters, round(CASE WHEN k >= 3 THEN quantile_cont(d, 0.025) END, 6) AS low, round(CASE WHEN k >= 3 THEN quantile_cont(d, 0.975) END, 6) AS high FROM md GROUP BY method, k")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of each method's median over records, which are drawn whole."""
    out = stats.cluster_bootstrap(exp(spark, sf_dir), ["method"], "record", "rmse")
    return out.select("method", "clusters", r("low").alias("low"), r("high").alias("high"))


@query(f"WITH {EXP}, ln AS (SELECT method, 1.0 + unit % 9 AS length, acf FROM ex WHERE abs(1.0 + unit % 9 - 4) > 1e-6), tm AS (SELECT method, length, CASE WHEN count(acf) >= 4 THEN (sum(acf) - min(acf) - max(acf)) / (count(acf) - 2) ELSE avg(acf) END AS t FROM ln GROUP BY method, length) SELECT method, count(*) AS lengths, round(min(t), 6) AS least, round(max(t), 6) AS most, round(stddev_samp(t), 6) AS sd, round(regr_slope(t, log10(length)), 6) AS per_decade FROM tm GROUP BY method")
def length_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges and trends of a metric over lengths; one length is excluded, as a caller may ask."""
    rows = exp(spark, sf_dir).withColumn("length", 1.0 + F.col("unit") % 9)
    out = stats.length_effects(rows, ["method"], "length", "acf", (4.0,))
    return out.select("method", "lengths", *(r(c).alias(c) for c in ("least", "most", "sd", "per_decade")))


@query(f"WITH {FILES} SELECT substr(d, 1, 6) AS month, count(*) FILTER (WHERE NOT st IN ('S16')) AS n_files, count(*) FILTER (WHERE st IN ('S16')) AS n_skip, count(*) FILTER (WHERE st NOT IN ('S16') AND frag) AS n_fail, count(*) FILTER (WHERE NOT st IN ('S16')) > 0 AND count(*) FILTER (WHERE st NOT IN ('S16') AND frag) = 0 AS ok FROM files WHERE NOT broken GROUP BY 1")
def verified_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of files by month; a month fails if nothing was left to check."""
    rows = files(spark, sf_dir).where("sta IS NOT NULL").withColumns({"bad": F.coalesce(F.col("loc") != "", F.lit(False)), "skip": F.col("sta") == "S16"})
    n, failed = F.count_if(~F.col("skip")), F.count_if(~F.col("skip") & F.col("bad"))
    return rows.groupBy(F.substring("day", 1, 6).alias("month")).agg(n.alias("n_files"), F.count_if("skip").alias("n_skip"), failed.alias("n_fail"), ((n > 0) & (failed == 0)).alias("ok"))
