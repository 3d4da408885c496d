"""Spectra of windows, bands of them, and envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spectra
from ..operators.storage import settled
from .quality import CLAMP, filled
from .registry import query
from .views import SR, r

PI2 = "6.283185307179586"
#: Windows of 360 filled samples of each trace, and the transform of each by its definition.
WINDOWS = f"{CLAMP}, w0 AS (SELECT trace_id, idx // 360 AS k, idx % 360 AS pos, w AS x, clean FROM filled), n0 AS (SELECT trace_id, k, count(*) AS n, avg(x) AS m, avg(clean) AS mc FROM w0 GROUP BY ALL HAVING count(*) = 360), wn AS (SELECT w0.trace_id, w0.k, pos, x - m AS x, clean - mc AS clean, x AS raw FROM w0 JOIN n0 USING (trace_id, k))"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = filled(spark, sf_dir).select("trace_id", F.floor(F.col("idx") / 360).alias("w"), (F.col("idx") % 360).alias("pos"), F.col("w").alias("x"), "clean")
    whole = df.groupBy("trace_id", "w").agg(F.count(F.lit(1)).alias("n")).where("n = 360").drop("n")
    return settled(df.join(whole, ["trace_id", "w"]), "windows")


def _dft(table: str, value: str, n: int, keys: str = "trace_id, k") -> str:
    return f"SELECT {keys}, f, sum({value} * cos({PI2} * ((pos * f) % {n}) / {n})) AS re, -sum({value} * sin({PI2} * ((pos * f) % {n}) / {n})) AS im FROM {table}, range({n // 2 + 1}) t(f) GROUP BY {keys}, f"


@query(f"WITH {WINDOWS}, d AS ({_dft('wn', f'x * (0.5 - 0.5 * cos({PI2} * pos / 359))', 360)}), s AS (SELECT sum(0.5 - 0.5 * cos({PI2} * pos / 359)) AS sw FROM range(360) t(pos)) SELECT trace_id, k AS w, f AS k, round(f * {SR} / 360, 9) AS frequency, round(CASE WHEN f = 0 THEN 1 ELSE 2 END * sqrt(re * re + im * im) / sw, 6) AS amplitude FROM d, s")
def amplitude_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitudes of windows of 360 samples."""
    out = spectra.amplitude_spectrum(windows(spark, sf_dir).select("trace_id", "w", "pos", "x"), ["trace_id", "w"], SR)
    return out.select("trace_id", "w", "k", r("frequency", 9).alias("frequency"), r("amplitude").alias("amplitude"))


@query(f"""WITH {WINDOWS}, q AS (SELECT trace_id, k, j, pos - j * 32 AS pos, x FROM wn, range(10) t(j) WHERE pos BETWEEN j * 32 AND j * 32 + 63), qm AS (SELECT trace_id, k, j, avg(x) AS m FROM q GROUP BY ALL), qc AS (SELECT q.trace_id, q.k, q.j, pos, x - m AS x FROM q JOIN qm USING (trace_id, k, j)),
    d AS ({_dft('qc', f'x * (0.5 - 0.5 * cos({PI2} * pos / 64))', 64, 'trace_id, k, j')}), s AS (SELECT sum(power(0.5 - 0.5 * cos({PI2} * pos / 64), 2)) AS sw FROM range(64) t(pos))
SELECT trace_id, k AS w, f AS k, round(avg(CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END * (re * re + im * im) / ({SR} * sw)), 6) AS power FROM d, s GROUP BY trace_id, w, f""".replace("GROUP BY trace_id, w, f", "GROUP BY 1, 2, 3"))
def welch_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power densities of windows of 360 samples, averaged over windows of 64."""
    out = spectra.welch(windows(spark, sf_dir).select("trace_id", "w", "pos", "x"), ["trace_id", "w"], SR, 16, 64)
    return out.select("trace_id", "w", "k", r("power").alias("power"))


PERIODOGRAM = f"SELECT trace_id, k, f, f * {SR} / 360 AS fr, CASE WHEN f IN (0, 180) THEN 1 ELSE 2 END * (re * re + im * im) / ({SR} * 360) AS p FROM"


@query(f"WITH {WINDOWS}, a AS ({PERIODOGRAM} ({_dft('wn', 'x', 360)})), b AS ({PERIODOGRAM} ({_dft('wn', 'clean', 360)})) SELECT a.trace_id, a.k AS w, round(sum(CASE WHEN a.fr >= 0.1 AND a.fr < 1 THEN a.p ELSE 0 END) * {SR} / 360, 6) AS power, round(sqrt(avg(CASE WHEN a.fr >= 0.01 AND a.fr < 1 THEN power(a.p - b.p, 2) END)), 6) AS rms FROM a JOIN b USING (trace_id, k, f) GROUP BY 1, 2")
def band_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power of a band, and how far the repaired trace's spectrum is from the true one's."""
    df, keys = windows(spark, sf_dir), ["trace_id", "w"]
    one = settled(spectra.periodogram(df.select(*keys, "pos", "x"), keys, SR), "spectrum")
    other = spectra.periodogram(df.select(*keys, "pos", F.col("clean").alias("x")), keys, SR)
    out = spectra.band_power(one, keys, 0.1, 1.0).join(spectra.band_rms(one, other, keys), keys)
    return out.select(*keys, r("power").alias("power"), r("rms").alias("rms"))


#: The profile from 0.5 to 1.5 Hz with transitions of 0.25, and transforms of 1,024 places, of every eighth window.
PROFILE = "CASE WHEN fr BETWEEN 0.5 AND 1.5 THEN 1.0 WHEN fr >= 0.25 AND fr < 0.5 THEN power((fr - 0.25) / 0.25, 2) * (3 - 2 * (fr - 0.25) / 0.25) WHEN fr > 1.5 AND fr <= 1.75 THEN 1 - power((fr - 1.5) / 0.25, 2) * (3 - 2 * (fr - 1.5) / 0.25) ELSE 0.0 END"


@query(f"""WITH {WINDOWS}, d AS ({_dft('wn', 'raw', 1024)}), p AS (SELECT *, {PROFILE} AS g FROM (SELECT *, f * {SR} / 1024 AS fr FROM d)), q AS (SELECT trace_id, k, f, CASE WHEN f IN (0, 512) THEN 1 ELSE 2 END * g * re AS re, CASE WHEN f IN (0, 512) THEN 1 ELSE 2 END * g * im AS im FROM p WHERE g > 0)
SELECT trace_id, k AS w, pos, round(sum(re * cos({PI2} * ((pos * f) % 1024) / 1024) - im * sin({PI2} * ((pos * f) % 1024) / 1024)) / 1024, 6) AS x FROM q, range(360) t(pos) GROUP BY 1, 2, 3""")
def band_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a band lets pass of each window."""
    out = spectra.band_component(windows(spark, sf_dir).select("trace_id", "w", "pos", "x"), ["trace_id", "w"], SR, 0.5, 1.5, 0.25)
    return out.select("trace_id", "w", "pos", r("x").alias("x"))


def _envelope(value: str) -> str:
    return f"(SELECT trace_id, k, pos, sqrt(power(sum(c * (re * cos({PI2} * ((pos * f) % 360) / 360) - im * sin({PI2} * ((pos * f) % 360) / 360))), 2) + power(sum(c * (re * sin({PI2} * ((pos * f) % 360) / 360) + im * cos({PI2} * ((pos * f) % 360) / 360))), 2)) / 360 AS v FROM (SELECT *, CASE WHEN f IN (0, 180) THEN 1 ELSE 2 END AS c FROM ({_dft('wn', value, 360)})), range(360) t(pos) GROUP BY trace_id, k, pos)"


@query(f"""WITH {WINDOWS}, a AS {_envelope('x')}, b AS (SELECT * FROM {_envelope('clean')} WHERE pos >= 30), u AS (SELECT trace_id, k, v, 1.0 / 360 AS p FROM a UNION ALL SELECT trace_id, k, v, -1.0 / 330 FROM b),
    o AS (SELECT trace_id, k, v, sum(p) OVER (PARTITION BY trace_id, k ORDER BY v) AS f, lead(v) OVER (PARTITION BY trace_id, k ORDER BY v) - v AS gap FROM u)
SELECT trace_id, k AS w, round(sum(abs(f) * gap), 5) AS distance FROM o GROUP BY 1, 2""")
def envelope_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the envelope's values of each window are from those of the true trace, of which the first 30 are left out."""
    df, keys = windows(spark, sf_dir), ["trace_id", "w"]
    held = df.join(df.groupBy(*keys).agg(F.avg("x").alias("m"), F.avg("clean").alias("mc")), keys)
    one = settled(spectra.envelope(held.select(*keys, "pos", (F.col("x") - F.col("m")).alias("x")), keys), "envelope")
    other = settled(spectra.envelope(held.select(*keys, "pos", (F.col("clean") - F.col("mc")).alias("x")), keys).where("pos >= 30"), "envelope-true")
    return spectra.set_distance(one, other, keys).select(*keys, r("distance", 5).alias("distance"))
