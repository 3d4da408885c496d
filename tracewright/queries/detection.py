"""Masks, runs and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Detection, Repair
from ..operators import masks, ranges, rolling, runs, segments
from ..operators.storage import settled
from .registry import query
from .views import FAULTS, MISS_RUNS, MISSING, RUNS, SR, TRC, X, r, reflected, rolling_sql, table, trc  # noqa: F401

CONFIG, REPAIR = Detection(), Repair()


def without_dc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(masks.without_dc(trc(spark, sf_dir)).select("trace_id", "idx", "x"), "x")


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs(trc(spark, sf_dir).withColumn("m", masks.missing_counts(F.col("v"))), "m")


@query(f"WITH {MISS_RUNS} SELECT trace_id, s, e, e - s + 1 AS length, CASE WHEN e - s + 1 <= 2 THEN 'linear' WHEN e - s + 1 <= 20 THEN 'zscore' ELSE 'core' END AS method FROM miss")
def missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of missing data with the repair that its length calls for."""
    return missing(spark, sf_dir).select("trace_id", "s", "e", runs.length().alias("length"), segments.graded_run(REPAIR).alias("method"))


MERGED = "SELECT trace_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY s, e) AS g FROM (SELECT *, CASE WHEN prev IS NULL OR {apart} THEN 1 ELSE 0 END AS new FROM (SELECT *, max(e) OVER (PARTITION BY trace_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {table}))) GROUP BY trace_id, g"


@query(f"WITH {MISS_RUNS} {MERGED.format(apart='s - prev > 100', table='miss')}")
def runs_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.merged(missing(spark, sf_dir), 100)


PADDED = "pad AS (SELECT trace_id, greatest(0, s - p) AS s, least(n - 1, e + p) AS e, s AS core FROM (SELECT miss.*, n.n, CASE WHEN e - s + 1 <= 66.25 THEN 33 ELSE least(396, greatest(198, CAST(floor((e - s + 1) / 20.0) AS BIGINT))) END AS p FROM miss JOIN (SELECT trace_id, max(idx) + 1 AS n FROM trc GROUP BY trace_id) n USING (trace_id)))"


@query(f"WITH {MISS_RUNS}, {PADDED} SELECT trace_id, s, e FROM pad")
def padded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.padded(missing(spark, sf_dir), rolling.lengths(trc(spark, sf_dir)), SR)


@query(f"WITH {MISS_RUNS}, {PADDED}, m AS ({MERGED.format(apart='s > prev', table='pad')}) SELECT m.trace_id, m.s, m.e, (SELECT min(core) FROM pad WHERE pad.trace_id = m.trace_id AND pad.s = m.s) AS core FROM m")
def merge_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = missing(spark, sf_dir).withColumn("core", F.col("s"))
    return runs.merged_overlapping(runs.padded(found, rolling.lengths(trc(spark, sf_dir)), SR), ("core",)).select("trace_id", "s", "e", "core")


@query(f"WITH RECURSIVE {MISS_RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY s) AS k FROM miss), f AS (SELECT trace_id, k, s, e, 1 AS g FROM o WHERE k = 1 UNION ALL SELECT o.trace_id, o.k, CASE WHEN j THEN f.s ELSE o.s END, CASE WHEN j THEN greatest(f.e, o.e) ELSE o.e END, CASE WHEN j THEN g ELSE g + 1 END FROM (SELECT f.*, (o.s - f.e <= floor(least(greatest(6, (f.e - f.s + 1) / {SR} * 0.5), 30) * {SR}) AND (greatest(o.e, f.e) - f.s + 1) / {SR} <= 90) AS j FROM f JOIN o ON o.trace_id = f.trace_id AND o.k = f.k + 1) f JOIN o ON o.trace_id = f.trace_id AND o.k = f.k + 1) SELECT trace_id, min(s) AS s, max(e) AS e FROM f GROUP BY trace_id, g")
def merge_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.merged_by_reference(missing(spark, sf_dir), SR, 6.0, 30.0, 0.5, 90.0)


NEED = f"least(greatest({{}} / {SR} * 0.5, 6), 30)"


@query(f"""WITH RECURSIVE {MISS_RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY s) AS k FROM miss),
    f AS (SELECT trace_id, k, s, e, 1 AS g FROM o WHERE k = 1
        UNION ALL SELECT trace_id, k, CASE WHEN j THEN ps ELSE s END, CASE WHEN j THEN greatest(pe, e) ELSE e END, CASE WHEN j THEN g ELSE g + 1 END FROM (SELECT o.trace_id, o.k, o.s, o.e, f.s AS ps, f.e AS pe, g, (o.s - f.e - 1) / {SR} < {NEED.format('(f.e - f.s + 1)')} + {NEED.format('(o.e - o.s + 1)')} + 2 AS j FROM f JOIN o ON o.trace_id = f.trace_id AND o.k = f.k + 1)),
    u AS (SELECT trace_id, g, min(s) AS m_s, max(e) AS m_e FROM f GROUP BY ALL)
SELECT trace_id, o.s, o.e, m_s, m_e FROM o JOIN f USING (trace_id, k) JOIN u USING (trace_id, g)""")
def merged_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing runs with the units that they are rebuilt in, as room for references demands."""
    return runs.merged_by_need(missing(spark, sf_dir), SR, 6.0, 30.0)


@query(f"WITH {MISS_RUNS}, m AS ({MERGED.format(apart='s - prev > 100', table='miss')}), f AS (SELECT m.trace_id, m.s, m.e, avg(CASE WHEN {MISSING} THEN 1.0 ELSE 0.0 END) AS share FROM m JOIN trc ON trc.trace_id = m.trace_id AND trc.idx BETWEEN m.s AND m.e GROUP BY ALL) SELECT trace_id, s, e, 'repair' AS role FROM f WHERE e - s + 1 <= 150 UNION ALL SELECT trace_id, s, e, 'gap' FROM f WHERE e - s + 1 > 150 AND share > 0.5 UNION ALL SELECT trace_id, b, least(b + 149, e), 'repair' FROM (SELECT *, unnest(generate_series(s, e, 150)) AS b FROM f WHERE e - s + 1 > 150 AND share <= 0.5)")
def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = trc(spark, sf_dir).withColumn("missing", masks.missing_counts(F.col("v")))
    found = segments.shares(samples, runs.merged(runs.runs(samples, "missing"), 100), ("missing",))
    return runs.split_long(found, 150).select("trace_id", "s", "e", "role")


@query(f"WITH {X} SELECT trace_id, dc, count(*) AS n, round(sum(x), 6) AS total, round(stddev_pop(x), 6) AS spread FROM x GROUP BY trace_id, dc")
def dc_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.without_dc(trc(spark, sf_dir)).groupBy("trace_id", "dc").agg(F.count(F.lit(1)).alias("n"), r(F.sum("x")).alias("total"), r(F.stddev_pop("x")).alias("spread"))


@query(f"WITH {TRC}, k AS (SELECT trace_id, min(idx) AS s, max(idx) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY idx) AS g FROM (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER (PARTITION BY trace_id ORDER BY idx) THEN 0 ELSE 1 END AS new FROM trc)) GROUP BY trace_id, g HAVING count(*) >= 198) SELECT trace_id, s, e FROM (SELECT *, count(*) OVER (PARTITION BY trace_id) AS c FROM k) WHERE e - s + 1 >= CASE WHEN c > 50 THEN 795 ELSE 198 END")
def freeze_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.freeze_runs(trc(spark, sf_dir), CONFIG)


@query(f"WITH {TRC}, k AS ({RUNS.format(table='trc', cond='v >= 1020 OR v <= -1020')}) SELECT trace_id, count(*) AS n_runs, CAST(sum(e - s + 1) AS BIGINT) AS n_samples, max(e - s + 1) AS longest FROM k GROUP BY trace_id")
def saturated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.runs(trc(spark, sf_dir).withColumn("sat", masks.saturated(F.col("v"))), "sat")
    return found.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(runs.length()).alias("n_samples"), F.max(runs.length()).alias("longest"))


SPIKE = (
    f"{X}, gl AS (SELECT trace_id, 1.4826 * median(abs(x - m)) AS g FROM x JOIN (SELECT trace_id, median(x) AS m FROM x GROUP BY trace_id) USING (trace_id) GROUP BY trace_id),"
    f" b AS ({rolling_sql('x', 'x', 6, 6, 'median({})', 'base')}), rs AS (SELECT x.trace_id, x.idx, x.n, abs(x.x - base) AS res FROM x JOIN b USING (trace_id, idx)),"
    f" sc AS ({rolling_sql('rs', 'res', 6, 6, 'median({})', 'sc')}), spike AS (SELECT rs.trace_id, rs.idx FROM rs JOIN sc USING (trace_id, idx) JOIN gl USING (trace_id) WHERE res > 8.0 * greatest(1.4826 * sc, greatest(g, 0.5) * 0.5))"
)


@query(f"WITH {SPIKE} SELECT trace_id, idx FROM spike")
def spike_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.spike(without_dc(spark, sf_dir), CONFIG).where("spike").select("trace_id", "idx")


STEP = (
    f"{X}, d AS (SELECT trace_id, idx, lead(x) OVER (PARTITION BY trace_id ORDER BY idx) - x AS d FROM x), dm AS (SELECT trace_id, median(d) AS m FROM d GROUP BY trace_id),"
    " ds AS (SELECT trace_id, m, greatest(1.4826 * median(abs(d - m)), 0.5) AS sc FROM d JOIN dm USING (trace_id) GROUP BY trace_id, m), big AS (SELECT trace_id, idx FROM d JOIN ds USING (trace_id) WHERE abs(d - m) > {k} * sc),"
    " step AS (SELECT trace_id, idx FROM big UNION SELECT trace_id, idx + 1 FROM big)"
)


@query(f"WITH {STEP.format(k='4.5')} SELECT trace_id, idx FROM step")
def step_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.step(without_dc(spark, sf_dir), Detection(step_k=4.5)).where("step").select("trace_id", "idx")


ENERGY = (
    f"{X}, sq AS (SELECT trace_id, idx, n, x * x AS q FROM x), e1 AS ({rolling_sql('sq', 'q', 33, 32, 'avg({})', 'a')}), e2 AS ({rolling_sql('sq', 'q', 397, 397, 'avg({})', 'b')}),"
    " rm AS (SELECT e1.trace_id, e1.idx, sqrt(a) AS a, sqrt(b) AS b FROM e1 JOIN e2 USING (trace_id, idx)), md AS (SELECT trace_id, median(a) AS m FROM rm GROUP BY trace_id),"
    " hit AS (SELECT trace_id, idx, (a / (m * 0.5 + 1e-9) > {r} * 2.0 * CASE WHEN m < 4.0 THEN 3.0 ELSE 1.0 END) OR (a / greatest(b, (m * 0.5 + 1e-9) * 2.0) > {r}) AS h FROM rm JOIN md USING (trace_id)),"
    " energy AS (SELECT trace_id, idx FROM (SELECT trace_id, idx, bool_or(h) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f FROM hit) WHERE f)"
)


@query(f"WITH {ENERGY.format(r='1.37')} SELECT trace_id, idx FROM energy")
def energy_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.energy(without_dc(spark, sf_dir), Detection(rms_ratio=1.37)).where("energy").select("trace_id", "idx")


@query(f"WITH {TRC}, n AS (SELECT trace_id, max(idx) + 1 AS n FROM trc GROUP BY trace_id), p AS (SELECT trace_id, idx, v FROM trc UNION ALL SELECT trace_id, -k, v FROM trc, range(1, 10) t(k) WHERE idx = 0 UNION ALL SELECT trc.trace_id, n - 1 + k, v FROM trc JOIN n USING (trace_id), range(1, 10) t(k) WHERE idx = n - 1) SELECT trace_id, idx, m FROM (SELECT p.trace_id, idx, n, median(v) OVER (PARTITION BY p.trace_id ORDER BY idx ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING) AS m FROM p JOIN n USING (trace_id)) WHERE idx BETWEEN 0 AND n - 1")
def rolling_median_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_median(trc(spark, sf_dir).select("trace_id", "idx", "v"), "v", 19, "m", "edge").select("trace_id", "idx", "m")


@query(f"WITH {X}, sq AS (SELECT trace_id, idx, n, x * x AS q FROM x), w AS ({rolling_sql('sq', 'q', 33, 32, 'avg({})', 'a')}) SELECT trace_id, idx, round(sqrt(a), 6) AS rms FROM w")
def rolling_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_rms(without_dc(spark, sf_dir), "x", 66, "rms").select("trace_id", "idx", r("rms").alias("rms"))


@query(f"WITH {TRC} SELECT trace_id, idx, round(CASE WHEN c < 4 OR d < 1e-12 THEN 0 ELSE k END, 6) AS kurtosis FROM (SELECT trace_id, idx, kurtosis_pop(v) OVER w AS k, count(*) OVER w AS c, stddev_pop(v) OVER w AS d FROM trc WINDOW w AS (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN 16 PRECEDING AND 15 FOLLOWING))")
def sliding_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_kurtosis(trc(spark, sf_dir).select("trace_id", "idx", "v"), "v", 16, "kurtosis").select("trace_id", "idx", r("kurtosis").alias("kurtosis"))


MAD = "SELECT trace_id, idx FROM trc JOIN (SELECT trace_id, m, 1.4826 * median(abs(v - m)) AS sc, stddev_pop(v) AS sd FROM trc JOIN (SELECT trace_id, median(v) AS m FROM trc GROUP BY trace_id) USING (trace_id) GROUP BY trace_id, m) USING (trace_id) WHERE abs(v - m) > 2.3 * CASE WHEN sc > 0 THEN sc WHEN sd > 0 THEN sd ELSE 1 END"
Z = "SELECT trace_id, idx FROM trc JOIN (SELECT trace_id, avg(v) AS m, stddev_pop(v) AS sd FROM trc GROUP BY trace_id) USING (trace_id) WHERE abs(v - m) > 2.1 * CASE WHEN sd > 0 THEN sd ELSE 1 END"
MA = "SELECT trace_id, idx FROM (SELECT trace_id, idx, v, sum(v) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) / 25 AS m FROM trc) WHERE abs(v - m) > 300.5"


@query(f"WITH {TRC} {MAD}")
def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.mad_outliers(trc(spark, sf_dir), "v", 2.3, "o").where("o").select("trace_id", "idx")


@query(f"WITH {TRC} {Z}")
def zscore_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.zscore_outliers(trc(spark, sf_dir), "v", 2.1, "o").where("o").select("trace_id", "idx")


@query(f"WITH {TRC} {MA}")
def moving_average_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.moving_average_outliers(trc(spark, sf_dir), "v", 25, 300.5, "o").where("o").select("trace_id", "idx")


@query(f"WITH {TRC} SELECT trace_id, count(*) FILTER (WHERE v > 900.5) AS above, count(*) FILTER (WHERE v < 0.5) AS below, count(*) FILTER (WHERE abs(v) > 850) AS beyond FROM trc GROUP BY trace_id")
def threshold_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return trc(spark, sf_dir).groupBy("trace_id").agg(*(F.count_if(masks.threshold_outliers(v, t)).alias(n) for t, n in ((">900.5", "above"), ("<0.5", "below"), (850, "beyond"))))


@query(f"WITH {TRC}, a AS ({MAD}), b AS ({Z}), c AS ({MA}) SELECT 'union' AS how, trace_id, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c) GROUP BY trace_id UNION ALL SELECT 'intersection', trace_id, count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b INTERSECT SELECT * FROM c) GROUP BY trace_id")
def combined_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union and intersection of three detectors' masks, computed side by side."""
    df = masks.moving_average_outliers(masks.zscore_outliers(masks.mad_outliers(trc(spark, sf_dir), "v", 2.3, "a"), "v", 2.1, "b"), "v", 25, 300.5, "c")
    how = F.explode(F.array(F.when(F.col("a") | F.col("b") | F.col("c"), "union"), F.when(F.col("a") & F.col("b") & F.col("c"), "intersection")))
    return df.select(how.alias("how"), "trace_id").where("how IS NOT NULL").groupBy("how", "trace_id").agg(F.count(F.lit(1)).alias("n"))


FREEZE_PLACES = "fz AS (SELECT trace_id, unnest(generate_series(s, e)) AS idx FROM (SELECT trace_id, min(idx) AS s, max(idx) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY idx) AS g FROM (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER (PARTITION BY trace_id ORDER BY idx) THEN 0 ELSE 1 END AS new FROM trc)) GROUP BY trace_id, g HAVING count(*) >= 198))"
FLAGS = SPIKE + STEP.format(k="12.0").removeprefix(X) + f", {FREEZE_PLACES}, fl AS (SELECT x.trace_id, x.idx, x.x, (v >= 1020 OR v <= -1020) AS f1, {MISSING} AS f2, fz.idx IS NOT NULL AS f3, spike.idx IS NOT NULL AS f4, step.idx IS NOT NULL AS f5 FROM x LEFT JOIN fz USING (trace_id, idx) LEFT JOIN spike USING (trace_id, idx) LEFT JOIN step USING (trace_id, idx))"


@query(f"WITH {FLAGS}, seg AS ({MERGED.format(apart='s - prev > 20', table='(' + RUNS.format(table='fl', cond='f1 OR f2 OR f3 OR f4 OR f5') + ')')}), q AS (SELECT seg.trace_id, seg.s, seg.e, avg(f1::INT) AS a, avg(f2::INT) AS b, avg(f3::INT) AS c, avg(f4::INT) AS d, avg(f5::INT) AS f FROM seg JOIN fl ON fl.trace_id = seg.trace_id AND fl.idx BETWEEN seg.s AND seg.e GROUP BY ALL) SELECT trace_id, s, e, CASE WHEN greatest(a, b, c, d, f) <= 0.01 THEN 'burst' WHEN a = greatest(a, b, c, d, f) THEN 'sat' WHEN b = greatest(a, b, c, d, f) THEN 'zero' WHEN c = greatest(a, b, c, d, f) THEN 'freeze' WHEN d = greatest(a, b, c, d, f) THEN 'spike' ELSE 'step' END AS kind, round(b, 6) AS missing_share FROM q")
def primary_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = masks.all_masks(trc(spark, sf_dir).select("trace_id", "idx", "v"), CONFIG)
    found = runs.merged(runs.runs(masked, "morph"), 20)
    return segments.primary_kind(masked, found).select("trace_id", "s", "e", "kind", r("missing_share").alias("missing_share"))


PART = "least(b.e, m.e) - greatest(b.s, m.s) + 1"


@query(f"WITH {MISS_RUNS}, blocks AS (SELECT trace_id, min(idx) AS s, max(idx) AS e FROM trc GROUP BY trace_id, idx // 250), l AS (SELECT b.trace_id, b.s, b.e, coalesce(max(CASE WHEN m.s IS NOT NULL THEN least(b.e, m.e) - greatest(b.s, m.s) + 1 END), 0) AS max_run, count(*) FILTER (WHERE {PART} <= 2) AS n1, count(*) FILTER (WHERE {PART} BETWEEN 3 AND 20) AS n2, count(*) FILTER (WHERE {PART} > 20) AS n3 FROM blocks b LEFT JOIN miss m ON m.trace_id = b.trace_id AND m.s <= b.e AND m.e >= b.s GROUP BY b.trace_id, b.s, b.e), q AS (SELECT l.*, avg(CASE WHEN {MISSING} THEN 1.0 ELSE 0.0 END) AS f FROM l JOIN trc ON trc.trace_id = l.trace_id AND trc.idx BETWEEN l.s AND l.e GROUP BY ALL) SELECT trace_id, s, e, CAST(max_run AS BIGINT) AS max_run, round(f, 6) AS missing_share, CASE WHEN f > 0.1 THEN CASE WHEN f <= 0.12 THEN 'missing_runs' WHEN max_run <= 2 THEN 'linear' WHEN max_run <= 20 THEN 'zscore' ELSE 'core' END ELSE 'core' END AS method, CASE WHEN f > 0.1 AND f <= 0.12 THEN 'miss_frac=' || printf('%.3f', f) || ' lin=' || n1 || ' z=' || n2 || ' core=' || n3 WHEN f > 0.12 AND max_run <= 20 THEN 'max_run=' || max_run ELSE 'miss_frac=' || printf('%.3f', f) END AS note FROM q")
def graded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 250 samples graded by their share of missing samples and the longest run, with a note."""
    samples = trc(spark, sf_dir).withColumn("missing", masks.missing_counts(F.col("v")))
    blocks = samples.groupBy("trace_id", F.floor(F.col("idx") / 250).alias("b")).agg(F.min("idx").alias("s"), F.max("idx").alias("e")).drop("b")
    rows = segments.longest_run(segments.shares(samples, blocks, ("missing",)), runs.runs(samples, "missing")).withColumn("kind", F.lit("other"))
    rows = rows.withColumn("method", segments.graded(REPAIR.with_options(missing_share=0.1, core_missing_share=0.12)))
    return rows.select("trace_id", "s", "e", "max_run", r("missing_share").alias("missing_share"), "method", segments.note(F.col("method")).alias("note"))


@query(f"WITH {MISS_RUNS}, seg AS (SELECT miss.*, a.ts AS s_ts, b.ts AS e_ts, CASE WHEN e - s + 1 > 20 THEN 'event' ELSE 'repair' END AS role, CASE WHEN e - s + 1 > 2 THEN 'missing' ELSE 'burst' END AS kind FROM miss JOIN trc a ON a.trace_id = miss.trace_id AND a.idx = s JOIN trc b ON b.trace_id = miss.trace_id AND b.idx = e), cat AS (SELECT ts - INTERVAL 300 SECOND AS w0, ts + INTERVAL 3600 SECOND AS w1 FROM events WHERE event_type = 'error' AND value > 200) SELECT trace_id, s, e, CASE WHEN h AND kind IN ('spike', 'missing') THEN 'spike' WHEN h THEN 'event' WHEN role = 'event' THEN 'burst' ELSE role END AS verdict FROM (SELECT *, EXISTS (SELECT 1 FROM cat WHERE s_ts <= w1 AND e_ts >= w0) AS h FROM seg)")
def catalog_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs judged by a catalog of event times."""
    samples = trc(spark, sf_dir).withColumn("m", masks.missing_counts(F.col("v")))
    at = lambda c, n: samples.select("trace_id", F.col("idx").alias(c), F.col("ts").alias(n))
    found = runs.runs(samples, "m").join(at("s", "s_ts"), ["trace_id", "s"]).join(at("e", "e_ts"), ["trace_id", "e"])
    found = found.withColumns({"role": F.when(runs.length() > 20, "event").otherwise("repair"), "kind": F.when(runs.length() > 2, "missing").otherwise("burst")})
    catalog = table(spark, sf_dir, "events").where("event_type = 'error' AND value > 200").select(F.col("ts").alias("event_ts"))
    return segments.verified(found, catalog, CONFIG).select("trace_id", "s", "e", "verdict")


EVENT_SEGMENTS = "SELECT trace_id, min(idx) AS s, max(idx) AS e FROM x GROUP BY trace_id, idx // 230"


@query(
    f"WITH {FLAGS}, seg AS ({EVENT_SEGMENTS}), p AS (SELECT seg.trace_id, seg.s, seg.e, e - s + 1 AS n, idx - s AS pos, x, f2, f4, (f1 OR f2 OR f3 OR f4 OR f5) AS morph, greatest(3, floor((e - s + 1) * 0.1)) AS h, greatest(3, floor((e - s + 1) * 0.3)) AS m, greatest(2, floor((e - s + 1) * 0.1)) AS t FROM seg JOIN fl ON fl.trace_id = seg.trace_id AND fl.idx BETWEEN seg.s AND seg.e),"
    " st AS (SELECT trace_id, s, e, n, avg(f2::INT) AS mi, avg(morph::INT) AS mo, avg(f4::INT) AS sp, sqrt(avg(CASE WHEN pos < h THEN x * x END) + 1e-12) AS hd, sqrt(coalesce(avg(CASE WHEN pos >= h AND pos < h + m THEN x * x END), 0) + 1e-12) AS md, sqrt(avg(CASE WHEN pos >= n - t THEN x * x END) + 1e-12) AS tl FROM p GROUP BY ALL),"
    " pp AS (SELECT trace_id, s, n, pos, x * x AS q FROM p UNION ALL SELECT trace_id, s, n, -1 - pos, x * x FROM p WHERE pos < 33 UNION ALL SELECT trace_id, s, n, 2 * n - 1 - pos, x * x FROM p WHERE pos >= n - 33),"
    " en AS (SELECT trace_id, s, pos, sqrt(a) AS r FROM (SELECT trace_id, s, n, pos, avg(q) OVER (PARTITION BY trace_id, s ORDER BY pos ROWS BETWEEN 33 PRECEDING AND 32 FOLLOWING) AS a FROM pp) WHERE pos BETWEEN 0 AND n - 1),"
    " sm AS (SELECT trace_id, s, median(abs(r - l)) AS sm FROM (SELECT trace_id, s, r, lag(r) OVER (PARTITION BY trace_id, s ORDER BY pos) AS l FROM (SELECT trace_id, s, pos, r / (max(r) OVER (PARTITION BY trace_id, s) + 1e-12) AS r FROM en)) GROUP BY trace_id, s)"
    " SELECT st.trace_id, st.s, st.e, n >= 198 AND mi <= 0.2 AND mo <= 0.25 AND sp <= 0.04 AND hd >= 1.003 * md AND (hd <= 1e-6 OR tl >= hd / 100) AND sm <= 0.12 AS is_event FROM st JOIN sm USING (trace_id, s)"
)
def event_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event test on blocks of 230 samples."""
    masked = masks.all_masks(trc(spark, sf_dir).select("trace_id", "idx", "v"), CONFIG)
    blocks = masked.groupBy("trace_id", F.floor(F.col("idx") / 230).alias("b")).agg(F.min("idx").alias("s"), F.max("idx").alias("e")).drop("b")
    return segments.event_test(masked, blocks, Detection(event_missing=0.2, event_morph=0.25, event_head_mid=1.003))


@query(f"WITH {MISS_RUNS}, n AS (SELECT trace_id, max(idx) + 1 AS n FROM trc GROUP BY trace_id), w AS (SELECT miss.*, n, CAST(round_even(least(greatest((e - s + 1) / {SR} * 0.5, 2.0), 6.0) * {SR}, 0) AS BIGINT) AS l FROM miss JOIN n USING (trace_id)), b AS (SELECT *, greatest(0, s - 7 - l) AS b_s, s - 8 AS b_e, e + 8 AS a_s, least(n - 1, e + 7 + l) AS a_e FROM w) SELECT b.trace_id, b.s, b.e, b_s, b_e, a_s, a_e, (SELECT count(*) FROM trc t WHERE t.trace_id = b.trace_id AND t.idx BETWEEN b_s AND b_e AND NOT {MISSING.replace('v ', 't.v ')}) AS n_before, (SELECT count(*) FROM trc t WHERE t.trace_id = b.trace_id AND t.idx BETWEEN a_s AND a_e AND NOT {MISSING.replace('v ', 't.v ')}) AS n_after FROM b")
def reference_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the two-sided references of each missing run, and their good samples."""
    samples = trc(spark, sf_dir).withColumn("m", masks.missing_counts(F.col("v")))
    found = ranges.reference_windows(runs.runs(samples, "m"), rolling.lengths(samples), ranges.auto_reference(SR, 0.5, 2.0, 6.0), 7).drop("n")
    good = samples.where("NOT m").select("trace_id", "idx")
    for side, name in (("b", "n_before"), ("a", "n_after")):
        inside = ranges.samples_in(good, found.where(f"{side}_s <= {side}_e"), s=f"{side}_s", e=f"{side}_e").groupBy("trace_id", "s", "e").agg(F.count(F.lit(1)).alias(name))
        found = found.join(inside, ["trace_id", "s", "e"], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return found


@query()
def detected_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of detection: segments by role and kind."""
    return segments.detected(trc(spark, sf_dir).select("trace_id", "idx", "v"), CONFIG)[1]
