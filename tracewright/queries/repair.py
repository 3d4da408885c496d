"""Spectra, repairs and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Detection
from ..functions import arrays
from ..operators import masks, ranges, rolling, runs, stats, verification
from ..operators.storage import settled
from ..plans.pipeline import cleaned, repaired
from ..plans.replace import rebuilt, replaced, segment_contexts, written_back
from .quality import PAIRS, pairs
from .registry import query
from .views import EXP, MISS_RUNS, SR, TRC, exp, r, table, trc

N = 64
DFT = f"el AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range({N})) AS i FROM embeddings), pg AS (SELECT vec_id, k, (power(sum(v * cos(2 * pi() / {N} * ((k * i) % {N}))), 2) + power(sum(v * sin(2 * pi() / {N} * ((k * i) % {N}))), 2)) / {N} AS p FROM el, range({N // 2 + 1}) t(k) GROUP BY vec_id, k)"


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return settled(rows.select("vec_id", arrays.periodogram(F.col("x"), N).alias("psd")), "spectra")


@query(f"WITH {DFT} SELECT vec_id, k AS bin, round(p, 6) AS power FROM pg")
def periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).select("vec_id", F.posexplode("psd").alias("bin", "power")).select("vec_id", F.col("bin").cast("long").alias("bin"), r("power").alias("power"))


@query(f"WITH {DFT}, two AS (SELECT a.vec_id, a.k, a.p AS b, c.p AS a, exp(0.5 * ln(a.p + 1e-30) + 0.5 * ln(c.p + 1e-30)) AS f FROM pg a JOIN pg c ON c.vec_id = a.vec_id + 1 AND c.k = a.k) SELECT vec_id, round(sum(f), 6) AS fused_power, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS similarity, round(sqrt(avg(power(10 * log10(b + 1e-12) - 10 * log10(a + 1e-12), 2))), 5) AS log_distance FROM two GROUP BY vec_id")
def psd_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of neighbours fused and compared."""
    s = spectra(spark, sf_dir)
    both = s.select("vec_id", F.col("psd").alias("before")).join(s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("psd").alias("after")), "vec_id")
    b, a = F.col("before"), F.col("after")
    return both.select("vec_id", r(arrays.total(arrays.fused(b, a))).alias("fused_power"), r(arrays.cosine(b, a)).alias("similarity"), r(arrays.log_distance(b, a), 5).alias("log_distance"))


@query(f"""WITH {DFT}, ends AS (SELECT max(vec_id) AS last FROM embeddings), two AS (SELECT a.vec_id, a.k, CASE WHEN c.p IS NULL THEN a.p ELSE (a.p + c.p) / 2 END AS f, CASE WHEN c.p IS NULL THEN a.p ELSE exp(0.5 * ln(a.p + 1e-30) + 0.5 * ln(c.p + 1e-30)) END AS g FROM pg a LEFT JOIN pg c ON c.vec_id = a.vec_id + 1 AND c.k = a.k),
    w AS (SELECT vec_id, sum(f) AS power, sum(f) FILTER (WHERE k > 0) AS rest, sum(g) AS geometric FROM two GROUP BY vec_id)
SELECT vec_id, round(power, 6) AS fused_power, round(power - geometric, 6) AS above_geometric, round(max(f / rest), 6) AS greatest_share, round(sum(f / rest) FILTER (WHERE k > 0), 6) AS shares FROM two JOIN w USING (vec_id) GROUP BY vec_id, power, geometric""")
def psd_fusion_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of neighbours fused by their mean, one-sided at the end, against the geometric mean; and their shares of the power beyond the first bin."""
    s = spectra(spark, sf_dir)
    both = s.select("vec_id", F.col("psd").alias("before")).join(s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("psd").alias("after")), "vec_id", "left")
    b, a = F.col("before"), F.col("after")
    linear = both.select("vec_id", arrays.fused_linear(b, a).alias("f"), arrays.total(arrays.fused(b, a)).alias("g"))
    share = arrays.normalised(F.col("f"))
    out = linear.select("vec_id", arrays.total(F.col("f")).alias("power"), "g", F.array_max(share).alias("most"), arrays.total(F.slice(share, 2, N // 2)).alias("shares"))
    return out.select("vec_id", r("power").alias("fused_power"), r(F.col("power") - F.col("g")).alias("above_geometric"), r("most").alias("greatest_share"), r("shares").alias("shares"))


@query(f"WITH {DFT}, s AS (SELECT vec_id, p, p / sum(p) OVER (PARTITION BY vec_id) AS q, k FROM pg) SELECT vec_id, round(-sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln({N // 2 + 1}), 6) AS entropy, arg_max(k, p) FILTER (WHERE k > 0) AS peak_bin FROM s GROUP BY vec_id")
def spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    psd = F.col("psd")
    tail = F.slice(psd, 2, N // 2)
    return spectra(spark, sf_dir).select("vec_id", r(arrays.entropy(psd)).alias("entropy"), F.array_position(tail, F.array_max(tail)).cast("long").alias("peak_bin"))


@query()
def core_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long missing runs rebuilt from both sides: the report of each, and how it goes on from its references."""
    df = settled(trc(spark, sf_dir).select("trace_id", "idx", "v").withColumn("bad", masks.missing_counts(F.col("v"))), "raw")
    segs = settled(runs.runs(df, "bad").where(runs.length() > 20).withColumn("method", F.lit("core")), "segments")
    values, report = replaced(df, segs, SR)
    wide = ranges.reference_windows(segs, rolling.lengths(df), ranges.auto_reference(SR), round(SR))
    checked = verification.verified(settled(written_back(df, values), "written"), wide.select("trace_id", "s", "e", "b_s", "b_e", "a_s", "a_e"), SR)
    return report.join(checked.select("trace_id", "s", "spectral", "envelope", "level", "autocorrelation", "energy", "passed", "issues"), ["trace_id", "s"])


@query(f"WITH {TRC}, g AS (SELECT DISTINCT trace_id, idx // 500 * 500 + 200 AS s, idx // 500 * 500 + 219 AS e FROM trc) SELECT g.trace_id, g.s, g.e, count(*) AS n, m.method FROM g JOIN trc ON trc.trace_id = g.trace_id AND trc.idx BETWEEN g.s AND g.e, (VALUES ('linear'), ('pchip'), ('spline'), ('ar'), ('ssa'), ('lowpass'), ('core')) m(method) GROUP BY ALL HAVING count(*) = 20")
def baseline_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 samples taken out of each 500 and filled by every method: new values of each."""
    methods = ["linear", "pchip", "spline", "ar", "ssa", "lowpass", "core"]
    df = settled(trc(spark, sf_dir).select("trace_id", "idx", F.col("clean").alias("v")).withColumn("bad", (F.col("idx") % 500).between(200, 219)), "raw")
    segs = runs.runs(df, "bad").where(runs.length() == 20)
    contexts = segment_contexts(df, segs, SR, round(SR)).withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    out = rebuilt(contexts, SR, round(SR)).select("trace_id", "s", "method", F.explode("values").alias("w"))
    return out.where("w IS NOT NULL AND NOT isnan(w)").groupBy("trace_id", "s", "method").agg(F.count(F.lit(1)).alias("n"), (F.min("s") + 19).alias("e")).select("trace_id", "s", "e", "n", "method")


@query(f"WITH {MISS_RUNS} SELECT trace_id, count(*) AS n, CAST(0 AS BIGINT) AS residual, CAST(0 AS BIGINT) AS leaks, count(*) FILTER (WHERE idx % 997 < 40) AS protected, CAST(0 AS BIGINT) AS protected_changed FROM trc GROUP BY trace_id")
def pipeline_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline with protected segments: nothing missing stays outside them, nothing else but spikes changes, and they stay as they were."""
    raw = settled(trc(spark, sf_dir).select("trace_id", "idx", "v"), "raw")
    safe = settled(runs.runs(raw.withColumn("p", F.col("idx") % 997 < 40), "p"), "protected")
    config = Detection()
    out = settled(repaired(raw, config, protected=safe)[0], "repaired")
    missing = settled(runs.runs(raw.withColumn("m", masks.missing_counts(F.col("v"))), "m"), "missing")
    inside = lambda segs, name: ranges.samples_in(raw.select("trace_id", "idx"), segs.select("trace_id", "s", "e")).select("trace_id", "idx", F.lit(True).alias(name))
    touching = ranges.overlapping(missing, safe, "left_semi")
    df = out.join(inside(safe, "p"), ["trace_id", "idx"], "left").join(inside(touching, "t"), ["trace_id", "idx"], "left").join(inside(missing, "m"), ["trace_id", "idx"], "left")
    p, t, m = (F.coalesce(c, F.lit(False)) for c in ("p", "t", "m"))
    changed = ~F.col("v").eqNullSafe(F.col("w"))
    leak = ~p & ~m & ~F.col("spike") & changed
    return df.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~p & ~t & masks.missing_counts(F.col("w"))).alias("residual"), F.count_if(leak).alias("leaks"), F.count_if(p).alias("protected"), F.count_if(p & changed).alias("protected_changed"))


@query(f"WITH {MISS_RUNS} SELECT trace_id, CASE WHEN e - s + 1 > 47700 THEN 'gap' ELSE 'repair' END AS role, CASE WHEN e - s + 1 > 47700 THEN 'keep' WHEN e - s + 1 > 20 THEN 'core' WHEN e - s + 1 > 2 THEN 'zscore' ELSE 'linear' END AS method, count(*) AS n, CAST(sum(e - s + 1) AS BIGINT) AS samples FROM miss GROUP BY ALL")
def pipeline_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pipeline did to each trace, by role and method."""
    raw = trc(spark, sf_dir).select("trace_id", "idx", "v")
    return repaired(raw)[1].groupBy("trace_id", "role", "method").agg(F.count(F.lit(1)).alias("n"), F.sum(runs.length()).alias("samples"))


@query()
def cleaning_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors in order, each filling what it marks before the next looks."""
    raw = trc(spark, sf_dir).select("trace_id", "idx", "v")
    return cleaned(raw, [("threshold", {"limit": 1000}), ("spike", {}), ("z_score", {"k": 3.0})]).select("trace_id", "idx", r("v").alias("v"))


@query()
def composite_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair by kinds: what was done, by role, kind and method."""
    from ..plans.composite import composite

    catalog = composite(trc(spark, sf_dir).select("trace_id", "idx", "v"))[1]
    return catalog.groupBy("trace_id", "role", "kind", "method").agg(F.count(F.lit(1)).alias("n"), F.sum(runs.length()).alias("samples"))


@query(f"WITH {TRC} SELECT trace_id, count(*) AS n, CAST(0 AS BIGINT) AS touched_walls, CAST(0 AS BIGINT) AS unexplained, CAST(0 AS BIGINT) AS below_one, CAST(0 AS BIGINT) AS outside_catalog FROM trc GROUP BY trace_id")
def composite_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair by kinds changes nothing in events and gaps, leaves nothing below 1 elsewhere, and says where it changed what."""
    from ..plans.composite import _marks, composite

    out, catalog = composite(trc(spark, sf_dir).select("trace_id", "idx", "v"))
    df = _marks(settled(out, "composite"), settled(catalog.where("role = 'repair'"), "repairs"), "listed")
    df = _marks(df, settled(catalog.where("role <> 'repair'"), "kept"), "wall")
    changed = ~F.col("v").eqNullSafe(F.col("w"))
    return df.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("wall") & changed).alias("touched_walls"), F.count_if(changed & F.col("how").isNull()).alias("unexplained"),
        F.count_if(~F.col("wall") & (F.col("w").isNull() | (F.col("w") < 1))).alias("below_one"), F.count_if(changed & ~F.col("listed") & (F.col("how") == "segment")).alias("outside_catalog"),
    )


U = "CAST('0x' || substr(md5(7 || '|' || {draw} || '|' || {unit}), 1, 13) AS BIGINT) / 4503599627370496.0"
WEIGHT = " + ".join(f"(CASE WHEN u >= {b!r} THEN 1 ELSE 0 END)" for b in stats.POISSON)


@query(f"WITH {EXP}, w AS (SELECT method, draw, rmse, {U.format(draw='draw', unit='unit')} AS u FROM ex, range(1, 20001) t(draw)), m AS (SELECT method, draw, sum(rmse * ({WEIGHT})) / nullif(sum({WEIGHT}), 0) AS m FROM w GROUP BY method, draw) SELECT method, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY method")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.bootstrap_mean(exp(spark, sf_dir), ["method"], "unit", "rmse")
    return out.select("method", r("low").alias("low"), r("high").alias("high"))


@query(f"WITH {PAIRS}, q AS (SELECT unit // 12 AS record, d, row_number() OVER (PARTITION BY unit // 12 ORDER BY unit) - 1 AS k FROM pd WHERE d <> 0), o AS (SELECT record, count(*) AS n, abs(sum(d)) AS seen FROM q GROUP BY record), s AS (SELECT record, x.draw, abs(sum(CASE WHEN (x.draw >> k) & 1 = 1 THEN d ELSE -d END)) AS t FROM q JOIN o USING (record), range(0, 4096) x(draw) WHERE x.draw < (1 << n) GROUP BY record, x.draw) SELECT record, n, round(CASE WHEN n >= 6 THEN (count(*) FILTER (WHERE t >= seen - 1e-12) + 1) / ((1 << n) + 1.0) END, 6) AS p FROM s JOIN o USING (record) GROUP BY record, n")
def sign_flip_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of 12 units, for which all signs are tried."""
    rows = pairs(spark, sf_dir).withColumn("record", F.floor(F.col("unit") / 12))
    return stats.sign_flips(rows, ["record"], "unit").withColumn("p", r("p"))


@query()
def wilcoxon_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed ranks of each record with their p values, and the least p that so many pairs can give."""
    out = stats.signed_ranks(pairs(spark, sf_dir), ["record"])
    args = (F.col("w_plus"), F.col("n"), F.col("ties"))
    return out.select("record", "n", F.least("w_plus", "w_minus").alias("w"), r(stats.wilcoxon_p(*args), 9).alias("p"), r(stats.wilcoxon_p_less(*args), 9).alias("p_less"), stats.p_floor(F.col("n")).alias("floor"))
