"""Scopes of files, labels, floors, segment outliers, summaries and checks of stored values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import fill, masks, rolling, runs, stats
from ..operators.storage import settled
from ..sources import names
from .quality import CLAMP, FILES, PAIRS, files, filled, pairs
from .registry import query
from .views import EXP, MISS_RUNS, MISSING, TRC, exp, r, trc


@query(f"WITH {FILES} SELECT name, st AS sta, d AS day FROM files WHERE NOT broken AND st IN ('S12', 'S14') AND CAST(d AS INT) BETWEEN 19940101 AND 19961231")
def scope_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of chosen stations within a range of days."""
    found = files(spark, sf_dir)
    return found.where(names.in_scope(found, ["S12", "S14"], 19940101, 19961231)).select("name", "sta", "day")


@query(f"WITH {FILES} SELECT string_agg(DISTINCT st, ',' ORDER BY st) AS stations, string_agg(DISTINCT substr(d, 1, 4), ',' ORDER BY substr(d, 1, 4)) AS years FROM files WHERE NOT broken")
def stations_and_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.stations_and_years(files(spark, sf_dir))


@query(f"WITH {FILES}, l AS (SELECT CASE WHEN frag THEN 'XA.' || st || '.01.MHZ' ELSE 'XA.' || st END AS label, st, frag FROM files WHERE NOT broken) SELECT label, 'XA' AS net, st AS sta, CASE WHEN frag THEN '01' ELSE '' END AS loc, CASE WHEN frag THEN 'MHZ' ELSE '' END AS cha, count(*) AS n FROM l GROUP BY label, st, frag")
def split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream labels taken apart again."""
    labels = files(spark, sf_dir).where("sta IS NOT NULL").select(names.stream_label().alias("label"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", names.split_stream_label(F.col("label")).alias("p"), "n").select("label", "p.*", "n")


@query(f"WITH {FILES}, t AS (SELECT st || d AS file, CASE WHEN frag THEN '01' ELSE '' END AS loc, CASE WHEN frag THEN 'MHZ' ELSE '' END AS cha, length AS pos, name FROM files WHERE NOT broken) SELECT file, name FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY CASE WHEN loc = '00' THEN 0 WHEN cha = 'MHZ' THEN 1 ELSE 2 END, pos) AS k FROM t) WHERE k = 1")
def trace_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace of each station and day: location 00, else channel MHZ, else the first."""
    found = files(spark, sf_dir).where("sta IS NOT NULL").withColumn("file", F.concat("sta", "day")).withColumn("pos", F.col("length"))
    return names.by_priority(found, "file", "00", None).select("file", "name")


@query(f"WITH {TRC} SELECT trace_id, count(*) FILTER (WHERE v IS NULL OR NOT isfinite(v) OR v = -1) AS sentinels FROM trc GROUP BY trace_id")
def sentinel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trc(spark, sf_dir).groupBy("trace_id").agg(F.count_if(masks.missing_sentinel(F.col("v"))).alias("sentinels"))


@query(f"WITH {TRC}, s AS (SELECT *, idx // 200 AS seg_id FROM trc WHERE NOT {MISSING}), m AS (SELECT trace_id, seg_id, median(v) AS med FROM s GROUP BY ALL HAVING count(*) >= 10), d AS (SELECT s.*, med, abs(v - med) AS dev FROM s JOIN m USING (trace_id, seg_id)), k AS (SELECT trace_id, seg_id, median(dev) AS mad FROM d GROUP BY ALL), o AS (SELECT d.*, CASE WHEN mad >= 1e-6 THEN 0.6745 * dev / mad > 4 ELSE dev > greatest(15, 0.05 * med) END AS outlier FROM d JOIN k USING (trace_id, seg_id)), g AS (SELECT trace_id, seg_id, min(idx) AS s, max(idx) AS e FROM (SELECT *, idx - row_number() OVER (PARTITION BY trace_id, seg_id ORDER BY idx) AS k FROM o WHERE outlier) GROUP BY trace_id, seg_id, k) SELECT trace_id, s, e FROM g WHERE e - s + 1 <= 20")
def segment_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at most 20 samples that stand out of their segment of 200."""
    df = trc(spark, sf_dir).select("trace_id", "idx", "v").withColumn("seg_id", F.floor(F.col("idx") / 200))
    marked = settled(masks.segment_outliers(df), "outliers").where("outlier")
    step = F.col("idx") - F.row_number().over(Window.partitionBy("trace_id", "seg_id").orderBy("idx"))
    found = marked.withColumn("k", step).groupBy("trace_id", "seg_id", "k").agg(F.min("idx").alias("s"), F.max("idx").alias("e"))
    return found.where(runs.length() <= 20).select("trace_id", "s", "e")


@query(f"WITH {TRC}, m AS (SELECT trace_id, avg(v) AS a, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS sd FROM trc GROUP BY trace_id) SELECT trace_id, idx, round(CASE WHEN abs(v - a) > 2 * sd THEN a ELSE v END, 6) AS w FROM trc JOIN m USING (trace_id)")
def outliers_to_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples further than two deviations from their trace's mean become the mean."""
    df = masks.zscore_outliers(trc(spark, sf_dir).select("trace_id", "idx", "v"), "v", 2.0, "far")
    df = rolling.per_trace(df, mean=F.avg("v"))
    return fill.replaced(df, F.col("far"), F.col("mean"), "v", "w").select("trace_id", "idx", r("w").alias("w"))


@query(f"WITH {TRC}, b AS (SELECT trace_id, idx, v, idx % 997 < 40 AS kept, NOT (idx % 997 < 40) AND v <= 0 AS bad FROM trc), g AS (SELECT trace_id, min(idx) AS s, max(idx) AS e FROM (SELECT *, idx - row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS k FROM b WHERE bad) GROUP BY trace_id, k), a AS (SELECT g.*, l.v AS lv, n.v AS rv FROM g LEFT JOIN b l ON l.trace_id = g.trace_id AND l.idx = s - 1 LEFT JOIN b n ON n.trace_id = g.trace_id AND n.idx = e + 1) SELECT b.trace_id, b.idx, CASE WHEN kept THEN b.v ELSE greatest(1, round_even(CASE WHEN bad THEN coalesce(lv + (rv - lv) * ((b.idx - s + 1) / (e - s + 2)), lv, rv) ELSE b.v END, 0)) END AS w FROM b LEFT JOIN a ON a.trace_id = b.trace_id AND b.idx BETWEEN s AND e")
def floored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't above 0 outside protected places goes on a line, and nothing there stays below 1."""
    df = settled(trc(spark, sf_dir).select("trace_id", "idx", "v").withColumn("kept", F.col("idx") % 997 < 40), "kept")
    return fill.floored(df, "v", "w", "kept").select("trace_id", "idx", "w")


@query(f"WITH {MISS_RUNS} SELECT trace_id, s, e, CAST(pow(2, ceil(log2(2 * (e - s + 1)))) AS BIGINT) AS n_fft FROM miss")
def transform_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of the transform for each missing run: the power of two from twice its length on."""
    df = settled(trc(spark, sf_dir).select("trace_id", "idx", masks.missing_counts(F.col("v")).alias("bad")), "missing")
    return runs.runs(df, "bad").select("trace_id", "s", "e", arrays.next_power_of_two(2 * runs.length()).alias("n_fft"))


@query(f"WITH {CLAMP} SELECT trace_id, count(*) FILTER (WHERE v <> w) AS changed, round(sqrt(avg((v - w) * (v - w))), 6) AS rms, round(max(abs(v - w)), 6) AS most FROM filled GROUP BY trace_id")
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a repair took away: raw less repaired."""
    d = F.col("v") - F.col("w")
    return filled(spark, sf_dir).groupBy("trace_id").agg(F.count_if(d != 0).alias("changed"), r(F.sqrt(F.avg(d * d))).alias("rms"), r(F.max(F.abs(d))).alias("most"))


@query(f"WITH {TRC}, c AS (SELECT DISTINCT trace_id, idx // 1000 * 1000 + 500 AS c FROM trc) SELECT c.trace_id, c.c, min(struct_pack(a := -abs(v - 450), i := idx)).i AS peak, round(max(abs(v - 450)), 6) AS height FROM c JOIN trc ON trc.trace_id = c.trace_id AND idx BETWEEN c - 199 AND c + 199 GROUP BY c.trace_id, c.c")
def peaks_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the greatest excursion within 30 seconds of each centre; the first of equal ones."""
    df = trc(spark, sf_dir).withColumn("c", F.floor(F.col("idx") / 1000) * 1000 + 500)
    height = F.abs(F.col("v") - 450)
    near = df.where(F.abs(F.col("idx") - F.col("c")) <= 199).groupBy("trace_id", "c").agg(F.min(F.struct((-height).alias("a"), F.col("idx").alias("i"))).alias("p"))
    return df.select("trace_id", "c").distinct().join(near, ["trace_id", "c"]).select("trace_id", "c", F.col("p.i").alias("peak"), r(-F.col("p.a")).alias("height"))


@query(f"WITH {PAIRS} SELECT record, count(*) AS n, round(least(1, 2 / pow(2, count(*))), 9) AS floor FROM pd GROUP BY record")
def p_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least p that each record's pairs can give."""
    counts = pairs(spark, sf_dir).groupBy("record").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("record", "n", r(stats.p_floor(F.col("n")), 9).alias("floor"))


@query(f"WITH {EXP}, f AS (SELECT record, method, CASE WHEN unit % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN unit % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE rmse END AS x FROM ex) SELECT record, method, round(avg(x) FILTER (WHERE isfinite(x)), 6) AS mean, round(stddev_pop(x) FILTER (WHERE isfinite(x)), 6) AS sd, round(quantile_cont(x, 0.5) FILTER (WHERE isfinite(x)), 6) AS median, count(*) FILTER (WHERE NOT isfinite(x)) AS excluded FROM f GROUP BY record, method")
def finite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and medians of experiments, some of which failed."""
    x = F.when(F.col("unit") % 7 == 0, float("nan")).when(F.col("unit") % 11 == 0, float("inf")).otherwise(F.col("rmse"))
    out = stats.finite_summary(exp(spark, sf_dir).withColumn("x", x), ["record", "method"], "x")
    return out.select("record", "method", *(r(c).alias(c) for c in ("mean", "sd", "median")), "excluded")


@query(f"WITH {EXP}, t AS (SELECT record, rmse, round(rmse, 2) + CASE WHEN unit % 13 = 0 THEN 0.02 ELSE 0 END AS stored FROM ex) SELECT record, count(*) FILTER (WHERE abs(stored - rmse) > 0.0051) AS off, round(max(abs(stored - rmse)), 6) AS most, count(*) AS n FROM t GROUP BY record")
def stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded values of a table, some of them wrong, against what they were made of."""
    stored = r("rmse", 2) + F.when(F.col("unit") % 13 == 0, 0.02).otherwise(0.0)
    return stats.off_by_more(exp(spark, sf_dir).withColumn("stored", stored), ["record"], "stored", "rmse").withColumn("most", r("most"))


@query(f"WITH {EXP}, e AS (SELECT 'r' || record || CASE WHEN unit % 2 = 0 THEN '_stationary' ELSE '_transient' END AS event, rmse FROM ex) SELECT regexp_replace(event, '_(stationary|transient)$', '') AS record, count(*) AS n, round(avg(rmse), 6) AS rmse FROM e GROUP BY 1")
def records_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments by the record that their event's name tells."""
    event = F.concat(F.lit("r"), F.col("record").cast("string"), F.when(F.col("unit") % 2 == 0, "_stationary").otherwise("_transient"))
    rows = exp(spark, sf_dir).withColumn("record", F.regexp_replace(event, "_(stationary|transient)$", ""))
    return rows.groupBy("record").agg(F.count(F.lit(1)).alias("n"), r(F.avg("rmse")).alias("rmse"))
