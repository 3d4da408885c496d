"""Method lists on selections, planted anomalies, made signals, and results of many cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generators, rolling
from ..operators.storage import fresh_path, settled
from ..plans import methods
from ..sources.results import ResultStore
from .registry import query
from .views import EXP, SR, TRC, exp, r, table, trc

SELECTIONS = [(100, 349), (700, 1049)]
INSIDE = " OR ".join(f"idx BETWEEN {s} AND {e}" for s, e in SELECTIONS)


def selections(df: DataFrame) -> DataFrame:
    """Two ranges of each trace that is long enough."""
    n = rolling.lengths(df)
    ranges_ = F.array(*(F.struct(F.lit(s).cast("long").alias("s"), F.lit(e).cast("long").alias("e")) for s, e in SELECTIONS))
    return n.select("trace_id", "n", F.explode(ranges_).alias("x")).where("x.e < n").select("trace_id", "x.s", "x.e")


@query(f"""WITH {TRC}, o AS (SELECT trace_id, idx, v, idx < 700 AS sel FROM trc WHERE {INSIDE}), m AS (SELECT trace_id, sel, median(v) AS c, avg(v) AS a, stddev_pop(v) AS sd FROM o GROUP BY ALL HAVING count(*) IN (250, 350)),
    d AS (SELECT trace_id, sel, 1.4826 * median(abs(v - c)) AS mad FROM o JOIN m USING (trace_id, sel) GROUP BY ALL),
    h AS (SELECT o.*, abs(v) > 1000 OR abs(v - c) > 2.5 * (CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1 END) OR abs(v - a) > 2.1 * (CASE WHEN sd > 0 THEN sd ELSE 1 END) AS hit FROM o JOIN m USING (trace_id, sel) JOIN d USING (trace_id, sel)),
    kn AS (SELECT trace_id, sel, idx, v, row_number() OVER (PARTITION BY trace_id, sel ORDER BY idx) AS k FROM h WHERE NOT hit),
    w AS (SELECT *, count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY trace_id, sel) AS c, count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY trace_id, sel ORDER BY idx) AS ka FROM h),
    p AS (SELECT *, CASE WHEN ka = 0 THEN 1 WHEN ka = c THEN c - 1 ELSE ka END AS k FROM w WHERE hit),
    f AS (SELECT p.trace_id, p.idx, a.v + (b.v - a.v) * (p.idx - a.idx) / (b.idx - a.idx) AS w FROM p JOIN kn a ON a.trace_id = p.trace_id AND a.sel = p.sel AND a.k = p.k JOIN kn b ON b.trace_id = p.trace_id AND b.sel = p.sel AND b.k = p.k + 1)
SELECT trc.trace_id, trc.idx, round(coalesce(f.w, v), 6) AS v FROM trc LEFT JOIN f USING (trace_id, idx)""")
def methods_on_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three detectors over two selections of each trace: their union is filled once, and nothing else changes."""
    df = trc(spark, sf_dir).select("trace_id", "idx", "v")
    out = methods.applied(df, selections(df), [("threshold", {"threshold": 1000}), ("mad", {"mad_threshold": 2.5}), ("z_score", {"z_threshold": 2.1})], SR)
    return out.select("trace_id", "idx", r("v").alias("v"))


@query(f"""WITH {TRC}, ok AS (SELECT trace_id FROM trc GROUP BY trace_id HAVING max(idx) >= 1049), s AS (SELECT *, v = -1 AND ({INSIDE}) AS on_ FROM trc),
    w AS (SELECT s.*, max(CASE WHEN v <> -1 THEN idx END) OVER (PARTITION BY trace_id ORDER BY idx) AS a, min(CASE WHEN v <> -1 THEN idx END) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM s)
SELECT w.trace_id, w.idx, round(CASE WHEN on_ AND w.trace_id IN (SELECT trace_id FROM ok) THEN coalesce(x.v + (y.v - x.v) * (w.idx - w.a) / (w.b - w.a), x.v, y.v) ELSE w.v END, 6) AS v FROM w LEFT JOIN trc x ON x.trace_id = w.trace_id AND x.idx = w.a LEFT JOIN trc y ON y.trace_id = w.trace_id AND y.idx = w.b""")
def interpolated_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolation excludes the detectors beside it: only sentinels within the selections change."""
    df = trc(spark, sf_dir).select("trace_id", "idx", "v")
    out = methods.applied(df, selections(df), [("z_score", {}), ("missing_value_interpolation", {"method": "linear"})], SR)
    return out.select("trace_id", "idx", r("v").alias("v"))


CRC = "crc AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(n)))"
SEED = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])))"
DRAW = "CAST('0x' || substr(md5(seed || '|' || {counter} || '|{what}'), 1, 13) AS BIGINT)"
NORMAL = f"sqrt(-2 * ln(({DRAW.format(counter='idx', what='normal1')} + 0.5) / 4503599627370496.0)) * cos(6.283185307179586 * ({DRAW.format(counter='idx', what='normal2')} + 0.5) / 4503599627370496.0)"


def traces(df: DataFrame, kind: str) -> DataFrame:
    return rolling.lengths(df).withColumn("seed", generators.seed_of(F.col("trace_id"), kind, "0"))


@query(f"""WITH {TRC}, {CRC}, t AS (SELECT trace_id, max(idx) + 1 AS n, CAST(floor((max(idx) + 1) * 0.9) AS BIGINT) AS center FROM trc GROUP BY trace_id), s AS (SELECT t.*, {SEED.format(text="trace_id || '|spike|0'")} AS seed FROM t, crc),
    c AS (SELECT trace_id, seed, greatest(1, center - 496) AS w0, least(n - 2, center - 496 + 992) AS w1, (least(n - 2, center + 496) - greatest(1, center - 496) + 1) // 20 AS cell, k FROM s, range(20) r(k)),
    p AS (SELECT *, 5 + {DRAW.format(counter='k', what='width')} % 6 AS width, CAST(floor(cell * 0.15) AS BIGINT) AS j FROM c), q AS (SELECT *, w0 + CAST(floor((k + 0.5) * cell) AS BIGINT) + {DRAW.format(counter='k', what='place')} % (2 * j + 1) - j - width // 2 AS at_ FROM p),
    x AS (SELECT trace_id, greatest(w0, least(at_, w1 - width)) AS s, greatest(w0, least(at_, w1 - width)) + width - 1 AS e, CASE WHEN {DRAW.format(counter='k', what='sign')} % 2 = 0 THEN -1 ELSE 1 END AS sign FROM q)
SELECT trc.trace_id, idx, v + 500 * coalesce(arg_max(sign, s), 0) AS w FROM trc LEFT JOIN x ON x.trace_id = trc.trace_id AND idx BETWEEN s AND e GROUP BY trc.trace_id, idx, v""")
def injected_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty spikes of 5 to 10 samples, each in its cell of a window near the end of the trace."""
    df = trc(spark, sf_dir).select("trace_id", "idx", "v")
    return generators.injected(df, generators.planted(traces(df, "spike"), "spike", "large", SR, 0.1)).select("trace_id", "idx", "w")


@query(f"WITH {TRC}, t AS (SELECT trace_id, max(idx) + 1 AS n, CAST(floor((max(idx) + 1) * 0.9) AS BIGINT) AS center FROM trc GROUP BY trace_id) SELECT trc.trace_id, idx, CASE WHEN idx BETWEEN greatest(1, center - 99) AND least(n - 2, center + 98) THEN 0 ELSE v END AS w FROM trc JOIN t USING (trace_id)")
def injected_dropouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trc(spark, sf_dir).select("trace_id", "idx", "v")
    return generators.injected(df, generators.planted(traces(df, "dropout"), "dropout", "small", SR, 0.1)).select("trace_id", "idx", "w")


@query(f"""WITH {CRC}, c AS (SELECT CAST(s_suppkey AS VARCHAR) AS trace_id, s_suppkey % 2 = 0 AS tones, {SEED.format(text="CASE WHEN s_suppkey % 2 = 0 THEN 'multitone' ELSE 'chirp' END || '|none|' || s_suppkey")} AS seed FROM supplier, crc), x AS (SELECT *, idx / {SR} AS t, {NORMAL} AS z FROM c, range(150) r(idx))
SELECT trace_id, idx, round(CASE WHEN tones THEN 0.5 * sin(6.283185307179586 * 0.1 * t) + 0.3 * sin(6.283185307179586 * 0.5 * t) + 0.2 * sin(6.283185307179586 * t) + 0.1 * z
    ELSE 0.6 * sin(6.283185307179586 * (0.05 * t + 0.475 / (149 / {SR}) * t * t)) * (1 + 0.3 * sin(6.283185307179586 * 0.02 * t)) + 0.05 * z END, 6) AS v FROM x""")
def made_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal for each supplier: tones or a chirp, in noise."""
    family = F.when(F.col("s_suppkey") % 2 == 0, "multitone").otherwise("chirp")
    cases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("trace_id"), family.alias("family"), generators.seed_of(family, "none", F.col("s_suppkey")).alias("seed"))
    return generators.signals(cases, 150, SR).select("trace_id", "idx", r("v").alias("v"))


def ratio(case: dict) -> dict:
    """Fails for every seventh unit."""
    return {"ratio": case["rmse"] / (case["unit"] % 7), "size": abs(case["std_ratio"])}


@query(f"WITH {EXP} SELECT record, method, count(*) AS cases, count(*) FILTER (WHERE unit % 7 = 0) AS failed, round(avg(CASE WHEN unit % 7 <> 0 THEN rmse / (unit % 7) END), 6) AS ratio, round(avg(CASE WHEN unit % 7 <> 0 THEN abs(std_ratio) END), 6) AS size FROM ex GROUP BY record, method")
def resumed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of which some fail, run in two goes: the second one measures only what the first hasn't."""
    cases = settled(exp(spark, sf_dir).withColumns({"event": F.concat(F.lit("r"), F.col("record").cast("string")), "anom_type": F.col("method"), "level": F.when(F.col("unit") % 2 == 0, "small").otherwise("large")}), "experiment")
    store = ResultStore(spark, fresh_path(spark, "results"), ["ratio", "size"])
    store.run(cases.where("unit % 3 = 0"), ratio)
    store.run(cases, ratio)
    return store.summary(["record", "method"]).select("record", "method", "cases", "failed", r("ratio").alias("ratio"), r("size").alias("size"))
