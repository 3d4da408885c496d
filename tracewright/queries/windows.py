"""Windows, boundaries, injected faults and tables of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks, metrics, ranges, runs, windows
from ..operators.storage import settled
from ..sources import catalogs, names
from .detection import MERGED, missing
from .quality import CATALOG, CLAMP, EXP, FILES, STA, catalog, exp, files, filled, sta_lta
from .registry import query
from .views import MISS_RUNS, MISSING, TR, TRC, r, tr, trc


@query(f"WITH {TR}, w AS (SELECT trace_id, v, unnest(generate_series(greatest(0, CAST(ceil((idx - 255) / 64.0) AS BIGINT)), idx // 64)) * 64 AS start FROM tr) SELECT trace_id, start, round(sqrt(avg(v * v)), 6) AS rms FROM w GROUP BY trace_id, start HAVING count(*) = 256")
def rms_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.profile(tr(spark, sf_dir), "v", 256, 64).select("trace_id", "start", r("rms").alias("rms"))


@query()
def quiet_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four quietest windows of each trace that don't overlap, of those below the 45th percentile."""
    p = settled(windows.profile(tr(spark, sf_dir), "v", 256, 64), "profile")
    level = p.groupBy("trace_id").agg(F.percentile("rms", F.lit(0.45)).alias("level"))
    return windows.quiet(p.join(level, "trace_id"), 256, F.col("level"), 4)


@query(f"WITH {MISS_RUNS}, l AS (SELECT miss.trace_id, s, e, regr_slope(v, idx - s) AS b, regr_intercept(v, idx - s) AS a, count(*) AS n FROM miss JOIN trc ON trc.trace_id = miss.trace_id AND NOT {MISSING} AND ((idx BETWEEN s - 60 AND s - 1) OR (idx BETWEEN e + 1 AND e + 60)) GROUP BY ALL) SELECT trace_id, s, e, n, round(b, 5) AS slope, round(a, 5) AS level FROM l")
def two_sided_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = trc(spark, sf_dir).where(~masks.missing_counts(F.col("v"))).select("trace_id", "idx", "v")
    return windows.two_sided_lines(missing(spark, sf_dir), good, 60, "v").select("trace_id", "s", "e", "n", r("slope", 5).alias("slope"), r("level", 5).alias("level"))


@query(f"WITH {TR}, b AS (SELECT trace_id, idx // 200 AS k, v, v - lag(v) OVER (PARTITION BY trace_id, idx // 200 ORDER BY idx) AS d FROM tr), m AS (SELECT trace_id, k, median(v) AS m, median(d) AS sl, median(abs(d)) AS a, stddev_pop(v) AS sd FROM b GROUP BY ALL), q AS (SELECT trace_id, k, sl, a, sd, median(abs(v - m)) AS mad FROM b JOIN m USING (trace_id, k) GROUP BY ALL) SELECT trace_id, k, round(CASE WHEN mad > 0 THEN 1.4826 * mad ELSE greatest(sd, 1e-12) END, 6) AS scale, round(CASE WHEN a > 1e-12 THEN greatest(least(sl, 6 * a), -6 * a) ELSE sl END, 6) AS slope FROM q")
def robust_scale_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(tr(spark, sf_dir).withColumn("k", F.floor(F.col("idx") / 200)), "blocks")
    return windows.robust(df, ["trace_id", "k"], "v").select("trace_id", "k", r("scale").alias("scale"), r("slope").alias("slope"))


@query(f"WITH {TR}, i AS (SELECT trace_id, kind, v, CASE WHEN idx % 500 BETWEEN 100 AND 139 THEN CASE kind WHEN 'dropout' THEN 0 WHEN 'step' THEN v + 200 WHEN 'saturation' THEN 1023 ELSE CASE WHEN idx % 500 = 100 THEN v + 500 ELSE v END END ELSE v END AS w FROM tr, (VALUES ('dropout'), ('step'), ('saturation'), ('spike')) k(kind)) SELECT trace_id, kind, count(*) FILTER (WHERE v <> w) AS changed, round(sqrt(avg((w - v) * (w - v))), 6) AS rmse, round(avg(abs(w - v)), 6) AS mae FROM i GROUP BY trace_id, kind")
def injected_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of faults put into every 500 samples, and the error that they make."""
    df = tr(spark, sf_dir)
    place = F.col("idx") % 500
    kinds = ["dropout", "step", "saturation", "spike"]
    rows = df.select("trace_id", "v", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), windows.injected(k, F.col("v"), place, 100, 139).alias("w")) for k in kinds))).alias("i")).select("trace_id", "v", "i.kind", "i.w")
    m = metrics.errors("v", "w")
    return rows.groupBy("trace_id", "kind").agg(F.count_if(F.col("v") != F.col("w")).alias("changed"), r(m["rmse"]).alias("rmse"), r(m["mae"]).alias("mae"))


@query(f"WITH {CLAMP}, n AS (SELECT trace_id, stddev_pop(clean) AS sd FROM filled GROUP BY trace_id) SELECT trace_id, min(idx) FILTER (WHERE abs(v - clean) > 1e-3 * sd) AS s, max(idx) FILTER (WHERE abs(v - clean) > 1e-3 * sd) AS e, count(*) FILTER (WHERE abs(v - clean) > 1e-3 * sd) AS n FROM filled JOIN n USING (trace_id) GROUP BY trace_id")
def recovered_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a corrupted trace departs from the clean one."""
    from ..operators import rolling

    df = rolling.per_trace(trc(spark, sf_dir), sd=F.stddev_pop("clean"))
    off = F.abs(F.col("v") - F.col("clean")) > 1e-3 * F.col("sd")
    return df.groupBy("trace_id").agg(F.min(F.when(off, F.col("idx"))).alias("s"), F.max(F.when(off, F.col("idx"))).alias("e"), F.count_if(off).alias("n"))


@query(f"WITH {CATALOG}, g AS (SELECT station, day, least(s, e - 20) AS a, greatest(s, e - 20) AS b FROM ct) SELECT DISTINCT station, day, greatest(a, 50) AS s, least(b, 450) AS e FROM g WHERE greatest(a, 50) <= least(b, 450)")
def normalised_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their ends in order, cut to bounds, without repeats."""
    c = catalog(spark, sf_dir).select("station", "day", "s", (F.col("e") - 20).alias("e"))
    out = c.select("station", "day", F.greatest(F.least("s", "e"), F.lit(50)).alias("s"), F.least(F.greatest("s", "e"), F.lit(450)).alias("e"))
    return out.where("s <= e").distinct()


@query(f"WITH {MISS_RUNS}, b AS (SELECT trace_id, min(idx) AS bs, max(idx) AS be FROM trc GROUP BY trace_id, idx // 300) SELECT b.trace_id, bs, be, greatest(s, bs) AS s, least(e, be) AS e FROM b JOIN miss ON miss.trace_id = b.trace_id AND s <= be AND e >= bs WHERE least(e, be) - greatest(s, bs) + 1 <= 20")
def short_runs_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing runs cut to blocks of 300 samples, of 20 samples at most."""
    df = settled(trc(spark, sf_dir).withColumn("m", masks.missing_counts(F.col("v"))), "flagged")
    blocks = df.groupBy("trace_id", F.floor(F.col("idx") / 300).alias("b")).agg(F.min("idx").alias("bs"), F.max("idx").alias("be")).drop("b")
    inside = ranges.samples_in(df.where("m").select("trace_id", "idx"), blocks, s="bs", e="be")
    # runs of a block: a block is a trace of its own
    own = runs.runs(inside.select(F.struct("trace_id", "bs", "be").alias("trace_id"), "idx", F.lit(True).alias("m")), "m")
    return own.select("trace_id.*", "s", "e").where(runs.length() <= 20)


@query(f"WITH {EXP}, w AS (SELECT unit, max(rmse) FILTER (WHERE method = 'A') AS a, max(rmse) FILTER (WHERE method = 'N') AS b, max(rmse) FILTER (WHERE method = 'R') AS c, any_value(record) AS record FROM ex GROUP BY unit) SELECT record, round(median((b - a) / b), 6) AS improvement, count(*) FILTER (WHERE a < b AND a < c) AS wins, count(*) AS n, round(regr_slope(a, log10(unit + 1)), 6) AS slope FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND b > 0 GROUP BY record")
def improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median improvement over a baseline, wins against all, and the change per decade of the unit's size."""
    w = exp(spark, sf_dir).groupBy("unit", "record").pivot("method", ["A", "N", "R"]).agg(F.max("rmse")).where("A IS NOT NULL AND N IS NOT NULL AND R IS NOT NULL AND N > 0")
    return w.groupBy("record").agg(r(F.percentile((F.col("N") - F.col("A")) / F.col("N"), F.lit(0.5))).alias("improvement"), F.count_if((F.col("A") < F.col("N")) & (F.col("A") < F.col("R"))).alias("wins"), F.count(F.lit(1)).alias("n"), r(F.regr_slope("A", F.log10(F.col("unit") + 1))).alias("slope"))


@query(f"WITH {STA}, th AS (SELECT * FROM (VALUES (1.21), (1.31), (1.41)) t(lim)), o AS (SELECT trace_id, lim, count(*) AS n, count(DISTINCT g) AS runs FROM (SELECT trace_id, lim, idx - row_number() OVER (PARTITION BY trace_id, lim ORDER BY idx) AS g FROM rt, th WHERE r > lim) GROUP BY trace_id, lim) SELECT trace_id, CAST(lim AS DOUBLE) AS lim, runs, n FROM o")
def trigger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers and their samples at several thresholds."""
    ratio = settled(sta_lta(spark, sf_dir), "ratio")
    many = ratio.select(F.explode(F.array(*(F.lit(t) for t in (1.21, 1.31, 1.41)))).alias("lim"), "trace_id", "idx", "r")
    found = runs.runs(many.select(F.struct("trace_id", "lim").alias("trace_id"), "idx", (F.col("r") > F.col("lim")).alias("on")), "on")
    return found.groupBy("trace_id").agg(F.count(F.lit(1)).alias("runs"), F.sum(runs.length()).alias("n")).select("trace_id.*", "runs", "n")


@query(f"WITH {EXP}, p AS (SELECT unit % 10 AS level, avg(rmse) FILTER (WHERE method = 'A') AS a, avg(rmse) FILTER (WHERE method = 'N') AS n FROM ex GROUP BY 1) SELECT level, round(a, 6) AS a, round(n, 6) AS n, coalesce(a >= lag(a) OVER (ORDER BY level), true) AS rising FROM p")
def level_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = exp(spark, sf_dir).groupBy((F.col("unit") % 10).alias("level")).pivot("method", ["A", "N"]).agg(F.avg("rmse"))
    rising = F.coalesce(F.col("A") >= F.lag("A").over(Window.orderBy("level")), F.lit(True))
    return p.select("level", r("A").alias("a"), r("N").alias("n"), rising.alias("rising"))


@query(f"WITH {CATALOG} SELECT station, day, greatest(s, 100) AS s, least(e, 299) AS e, role AS kind FROM ct WHERE s <= 299 AND e >= 100 AND role NOT IN ('gap')")
def window_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments within a window of time, cut to it, without hidden kinds."""
    c = catalog(spark, sf_dir).where("s <= 299 AND e >= 100 AND role NOT IN ('gap')")
    return c.select("station", "day", F.greatest("s", F.lit(100)).alias("s"), F.least("e", F.lit(299)).alias("e"), F.col("role").alias("kind"))


SEVERITY = """w AS (SELECT trace_id, avg((v > 900)::INT) AS ratio, kurtosis_pop(v) + 3 AS k, count(*) FILTER (WHERE v > 900 AND idx < 400) AS sig, count(*) FILTER (WHERE v > 900 AND idx >= 400) AS noise, count(*) AS n FROM trc GROUP BY trace_id, idx // 200 HAVING stddev_pop(v) > 0),
    s AS (SELECT trace_id, sum(ratio * n) / sum(n) AS a, max(k) AS k, stddev_pop(k) AS d, sum(sig) AS sig, sum(noise) AS noise FROM w GROUP BY trace_id),
    p AS (SELECT *, CASE WHEN a <= 0 THEN 0 WHEN a < 0.001 THEN 5 WHEN a < 0.01 THEN 10 + 10 * (a / 0.01) WHEN a < 0.05 THEN 20 + 5 * ((a - 0.01) / 0.04) ELSE 25 END AS pa,
        CASE WHEN k <= 3 THEN 0 WHEN k < 10 THEN 10 * ((k - 3) / 7) WHEN k < 50 THEN 10 + 20 * ((k - 10) / 40) WHEN k < 200 THEN 30 + 10 * ((k - 50) / 150) ELSE 40 END AS pk,
        CASE WHEN d <= 0 THEN 0 WHEN d < 2 THEN 3 * d WHEN d < 10 THEN 6 + 5 * ((d - 2) / 8) ELSE 15 END AS pd,
        CASE WHEN sig > 0 AND noise > 0 THEN 20 WHEN sig > 0 THEN 15 WHEN noise > 0 THEN 8 ELSE 0 END AS pw FROM s),
    t AS (SELECT *, least(100, pa + pk + pd + least(10, pa * 0.4)) AS score, least(100, pa + pk + pd + pw) AS with_window FROM p),
    l AS (SELECT *, CASE WHEN with_window < 10 THEN 'none' WHEN with_window < 35 THEN 'mild' WHEN with_window < 65 THEN 'moderate' ELSE 'severe' END AS label FROM t)"""


@query(f"WITH {TRC}, {SEVERITY} SELECT trace_id, round(score, 4) AS score, round(with_window, 4) AS with_window, label, CASE label WHEN 'none' THEN 'no_action' WHEN 'mild' THEN 'optional_review' WHEN 'moderate' THEN CASE WHEN sig > 0 THEN 'suggest_clean' ELSE 'optional_review' END ELSE CASE WHEN sig > 0 THEN 'strongly_recommend_clean' WHEN noise > 0 AND a > 0.01 THEN 'recommend_clean' ELSE 'suggest_clean' END END AS advice FROM l")
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 200 samples; the first 400 stand for a signal's window. Scored without and with it."""
    high = F.col("v") > 900
    w = trc(spark, sf_dir).groupBy("trace_id", F.floor(F.col("idx") / 200).alias("k")).agg(F.count_if(high).alias("high"), (F.kurtosis("v") + 3).alias("kurtosis"), F.count_if(high & (F.col("idx") < 400)).alias("sig"), F.count_if(high & (F.col("idx") >= 400)).alias("noise"), F.count(F.lit(1)).alias("n"), F.stddev_pop("v").alias("sd")).where("sd > 0")
    s = w.groupBy("trace_id").agg((F.sum("high") / F.sum("n")).alias("a"), F.max("kurtosis").alias("k"), F.stddev_pop("kurtosis").alias("d"), F.sum("sig").alias("sig"), F.sum("noise").alias("noise"))
    parts = (F.col("a"), F.col("k"), F.col("d"))
    windowed = catalogs.severity(*parts, F.col("sig"), F.col("noise"))
    label = catalogs.severity_label(windowed)
    return s.select("trace_id", r(catalogs.severity(*parts), 4).alias("score"), r(windowed, 4).alias("with_window"), label.alias("label"), catalogs.recommendation(label, F.col("a"), F.col("sig"), F.col("noise")).alias("advice"))


@query(f"WITH {CLAMP}, d AS (SELECT trace_id, round_even(w, 0) AS q, w FROM filled) SELECT trace_id, count(*) FILTER (WHERE q <> w) AS moved, round(max(abs(q - w)), 6) AS most, round(avg(q) - avg(w), 6) AS shift FROM d GROUP BY trace_id")
def rounding_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = filled(spark, sf_dir).withColumn("q", F.rint("w"))
    return df.groupBy("trace_id").agg(F.count_if(F.col("q") != F.col("w")).alias("moved"), r(F.max(F.abs(F.col("q") - F.col("w")))).alias("most"), r(F.avg("q") - F.avg("w")).alias("shift"))


@query(f"WITH {FILES}, l AS (SELECT DISTINCT name, st, d, frag FROM files WHERE NOT broken AND length % 2 = 0), rt AS (SELECT DISTINCT '/f/' || name AS path, st, d FROM files WHERE NOT broken AND length % 2 = 1), b AS (SELECT st, d, min(path) AS p FROM rt GROUP BY st, d) SELECT '/r/' || l.name AS path, coalesce(rt.path, b.p) AS counterpart FROM l LEFT JOIN rt ON rt.path = '/f/' || l.name LEFT JOIN b ON b.st = l.st AND b.d = l.d")
def counterparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one root and what stands for them in another: by path, else by station and day."""
    rows = files(spark, sf_dir).where("sta IS NOT NULL")
    side = lambda k, root: names_of(rows.where(F.col("length") % 2 == k), root)
    return names.counterparts(side(0, "/r/"), side(1, "/f/"))


def names_of(rows: DataFrame, root: str) -> DataFrame:
    return rows.select(F.concat(F.lit(root), "name").alias("path"), F.col("name").alias("rel"), "name", "sta", "day").distinct()


@query(f"WITH {MISS_RUNS}, b AS (SELECT trace_id, idx // 500 AS part, count(*) FILTER (WHERE {MISSING}) AS missing, count(*) AS n FROM trc GROUP BY ALL) SELECT part, bool_and(missing * 5 < n) AS ok, count(*) AS n_files, count(*) FILTER (WHERE missing * 5 >= n) AS n_fail FROM b GROUP BY part")
def part_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of all traces by part: fails where a fifth or more is missing."""
    m = masks.missing_counts(F.col("v"))
    b = trc(spark, sf_dir).groupBy("trace_id", F.floor(F.col("idx") / 500).alias("part")).agg(F.count_if(m).alias("missing"), F.count(F.lit(1)).alias("n"))
    bad = F.col("missing") * 5 >= F.col("n")
    return b.groupBy("part").agg(F.bool_and(~bad).alias("ok"), F.count(F.lit(1)).alias("n_files"), F.count_if(bad).alias("n_fail"))


OSCILLATION = f"""{TR}, x AS (SELECT trace_id, idx, v - 430 AS x FROM tr), sg AS (SELECT trace_id, min(idx) AS s, max(idx) AS e FROM (SELECT trace_id, idx, idx - row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS g FROM x WHERE x > 0) GROUP BY trace_id, g),
    c0 AS ({MERGED.format(apart='s - prev >= 3', table='sg')}), c AS (SELECT c0.trace_id, c0.s, c0.e, sum(sg.e - sg.s + 1) AS total FROM c0 JOIN sg ON sg.trace_id = c0.trace_id AND sg.s BETWEEN c0.s AND c0.e GROUP BY ALL HAVING total > 20),
    d AS (SELECT c.*, x, abs(x - lag(x) OVER (PARTITION BY c.trace_id, s ORDER BY idx)) AS d FROM c JOIN x ON x.trace_id = c.trace_id AND idx BETWEEN s AND e), o AS (SELECT trace_id, s, e, total, sum(d) AS path, max(d) AS most, median(x) AS m, count(*) AS n FROM d GROUP BY ALL),
    i AS (SELECT trace_id, s, e, total, path, most, n, 1.4826 * median(abs(x - m)) AS mad FROM o JOIN d USING (trace_id, s, e, total) GROUP BY ALL),
    b AS (SELECT c.trace_id, s, e, x FROM c JOIN x ON x.trace_id = c.trace_id AND idx BETWEEN s - 300 AND e + 300 AND (idx < s OR idx > e)), bm AS (SELECT trace_id, s, e, median(x) AS m, count(*) AS k FROM b GROUP BY ALL), a AS (SELECT trace_id, s, e, k, greatest(1.4826 * median(abs(x - m)), 0.5) AS around FROM b JOIN bm USING (trace_id, s, e) GROUP BY ALL)"""


@query(f"WITH {OSCILLATION} SELECT i.trace_id, i.s, i.e, CAST(total AS BIGINT) AS total, round(path, 6) AS path, round(most, 6) AS most, round(mad, 6) AS mad, round(around, 6) AS around, coalesce(path > 12 * most AND mad > 1.3 * around AND n >= 8 AND k >= 8, false) AS swings FROM i LEFT JOIN a USING (trace_id, s, e)")
def oscillation_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(tr(spark, sf_dir).select("trace_id", "idx", (F.col("v") - 430).alias("x")), "x")
    segs = settled(runs.runs(df.withColumn("up", F.col("x") > 0), "up"), "segments")
    out = windows.oscillation_clusters(segs, df, 3, 20, 300)
    return out.select("trace_id", "s", "e", "total", *(r(c).alias(c) for c in ("path", "most", "mad", "around")), "swings")


@query(f"WITH {TRC} SELECT trace_id, min(idx) AS s, max(idx) AS e, count(*) AS n, round(sum(v), 6) AS total FROM (SELECT trace_id, idx, v, idx - row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS g FROM trc WHERE NOT {MISSING}) GROUP BY trace_id, g")
def gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces cut at their gaps, as they are to be written where gaps can't be: the pieces."""
    df = settled(trc(spark, sf_dir).withColumn("good", ~masks.missing_counts(F.col("v"))), "flagged")
    pieces = runs.runs(df, "good")
    return ranges.samples_in(df.select("trace_id", "idx", "v"), pieces).groupBy("trace_id", "s", "e").agg(F.count(F.lit(1)).alias("n"), r(F.sum("v")).alias("total"))


@query(f"WITH {MISS_RUNS}, p AS (SELECT miss.trace_id, s, e, idx, v, idx - s AS t, CASE WHEN idx < s THEN 1 ELSE 2 END AS side FROM miss JOIN trc ON trc.trace_id = miss.trace_id AND (idx BETWEEN s - 80 AND s - 1 OR idx BETWEEN e + 1 AND e + 80)), l AS (SELECT trace_id, s, side, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM p GROUP BY ALL), d AS (SELECT p.*, v - a - b * t AS d FROM p JOIN l USING (trace_id, s, side)), q AS (SELECT trace_id, s, side, stddev_pop(d) AS sd FROM d GROUP BY ALL), o AS (SELECT d.trace_id, d.s, d.side, min(idx) AS lo, max(idx) AS hi FROM d JOIN q USING (trace_id, s, side) WHERE abs(d) <= 0.5 * sd GROUP BY ALL) SELECT miss.trace_id, miss.s, miss.e, a.hi AS new_s, b.lo AS new_e FROM miss LEFT JOIN o a ON a.trace_id = miss.trace_id AND a.s = miss.s AND a.side = 1 LEFT JOIN o b ON b.trace_id = miss.trace_id AND b.s = miss.s AND b.side = 2")
def adaptive_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(trc(spark, sf_dir).select("trace_id", "idx", "v"), "raw")
    segs = settled(runs.runs(df.withColumn("m", masks.missing_counts(F.col("v"))), "m"), "runs")
    return windows.adaptive_bounds(segs, df, 80, "v")


@query(f"WITH {TR}, w AS (SELECT trace_id, idx // 250 AS k, avg(v) AS m, stddev_pop(v) AS d FROM tr GROUP BY ALL HAVING count(*) = 250), p AS (SELECT a.trace_id, abs(a.m - b.m) AS dm, abs(a.d - b.d) AS dd FROM w a JOIN w b ON a.trace_id = b.trace_id AND a.k < b.k) SELECT trace_id, count(*) AS n_pairs, round(quantile_cont(dm, 0.5), 6) AS median_mean, round(quantile_cont(dm, 0.95), 6) AS p95_mean, round(quantile_cont(dd, 0.95), 6) AS p95_std FROM p GROUP BY trace_id")
def healthy_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The natural band of differences between healthy windows."""
    wanted = {"median_mean": ("d_mean", 0.5), "p95_mean": ("d_mean", 0.95), "p95_std": ("d_std", 0.95)}
    out = windows.healthy_quantiles(tr(spark, sf_dir).select("trace_id", "idx", "v"), 250, "v", wanted)
    return out.select("trace_id", "n_pairs", *(r(c).alias(c) for c in wanted))


@query(f"WITH {TR}, sweep AS (SELECT k, CAST(round_even(120 * power(45.0, k / 19.0) * 0.05, 0) AS BIGINT) AS n FROM range(20) t(k)), w AS (SELECT trace_id, k, n, v, CASE WHEN idx BETWEEN 40 AND 40 + n - 1 THEN 0 ELSE v END AS x FROM tr, sweep) SELECT trace_id, k, n, round(sqrt(avg((x - v) * (x - v))), 6) AS rmse, count(*) FILTER (WHERE x <> v) AS changed FROM w GROUP BY trace_id, k, n")
def length_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropouts of 20 lengths on a logarithmic scale, and the error that each makes."""
    n = lambda k: F.rint(120 * F.pow(F.lit(45.0), k / 19.0) * 0.05).cast("long")
    lengths = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.struct(k.cast("long").alias("k"), n(k).alias("n")))
    rows = tr(spark, sf_dir).select("trace_id", "idx", "v", F.explode(lengths).alias("l")).select("trace_id", "idx", "v", "l.k", "l.n")
    x = F.when(F.col("idx").between(40, 39 + F.col("n")), 0.0).otherwise(F.col("v"))
    d = x - F.col("v")
    return rows.groupBy("trace_id", "k", "n").agg(r(F.sqrt(F.avg(d * d))).alias("rmse"), F.count_if(d != 0).alias("changed"))


@query(f"WITH {CATALOG}, m AS (SELECT station, day, round((e - s + 1) / 6.625 / 60, 1) AS minutes, role, coalesce(CASE WHEN s % 4 = 0 THEN NULL ELSE method END, CASE WHEN role = 'event' THEN 'catalog_protect' WHEN role = 'gap' THEN 'keep' WHEN e - s + 1 <= 2 THEN 'linear' WHEN e - s + 1 <= 20 THEN 'zscore' ELSE 'core' END) AS method FROM ct) SELECT DISTINCT station, day, role AS kind, method, minutes FROM m")
def displayed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows with a method where one is missing, one of each look."""
    n = F.col("e") - F.col("s") + 1
    inferred = F.when(F.col("role") == "event", "catalog_protect").when(F.col("role") == "gap", "keep").when(n <= 2, "linear").when(n <= 20, "zscore").otherwise("core")
    c = catalog(spark, sf_dir).withColumn("method", F.coalesce(F.when(F.col("s") % 4 != 0, F.col("method")), inferred))
    return c.select("station", "day", F.col("role").alias("kind"), "method", F.round(n / 6.625 / 60, 1).alias("minutes")).distinct()
