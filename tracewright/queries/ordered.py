"""Repairs in an order, and the line that rebuilt segments are put on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import restore
from ..operators.storage import settled
from ..plans import rounds
from .quality import FLAGGED, flagged
from .registry import query
from .restoring import BLOCKS, blocks
from .views import SR, r

#: References of 120 s beyond 1 s; tasks are blocks around the places of missing runs.
REACH, GAP = int(600.0 * SR) + round(SR), round(SR)
TASKS = f"""{FLAGGED}, gd AS (SELECT trace_id, idx, v FROM fl WHERE NOT bad), nn AS (SELECT trace_id, max(idx) + 1 AS n, median(CASE WHEN NOT bad THEN v END) AS whole FROM fl GROUP BY trace_id),
    {BLOCKS}, tk AS (SELECT trace_id, s, e, n, whole, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY s) AS BIGINT) AS k FROM bk JOIN nn USING (trace_id)),
    gk AS (SELECT gd.*, tk.k FROM gd LEFT JOIN tk ON tk.trace_id = gd.trace_id AND gd.idx BETWEEN tk.s AND tk.e)"""
#: What is seen of the trace while task q is rebuilt: good samples, earlier tasks' levels, later tasks' parts at the level of their surroundings.
SEEN = f"""own AS (SELECT t.trace_id, t.k, t.s, t.e, t.n, greatest(0, t.s - {GAP} - 795) AS b_s, t.s - {GAP} - 1 AS b_e, t.e + 1 + {GAP} AS a_s, least(t.n - 1, t.e + {GAP} + 795) AS a_e FROM tk t),
    parts AS (SELECT o.trace_id, o.k, p.k AS pk, greatest(p.s, o.s - {REACH}, 0) AS a, least(p.e, o.e + {REACH}) AS b, p.whole FROM own o JOIN tk p ON p.trace_id = o.trace_id AND p.k > o.k AND p.s <= o.e + {REACH} AND p.e >= o.s - {REACH}),
    around AS MATERIALIZED (SELECT p.trace_id, p.k, p.pk, p.a, p.b, p.whole, g.v, CAST(NULL AS BIGINT) AS j FROM parts p JOIN gk g ON g.trace_id = p.trace_id AND coalesce(g.k >= p.k, true) AND g.idx BETWEEN p.a - {REACH} AND p.b + {REACH} AND g.idx NOT BETWEEN p.a AND p.b
        UNION ALL SELECT p.trace_id, p.k, p.pk, p.a, p.b, p.whole, NULL, t.k FROM parts p JOIN tk t ON t.trace_id = p.trace_id AND t.k < p.k, LATERAL (SELECT unnest(range(t.s, t.e + 1)) AS i) WHERE i BETWEEN p.a - {REACH} AND p.b + {REACH} AND i NOT BETWEEN p.a AND p.b),
    refs AS MATERIALIZED (SELECT o.trace_id, o.k, g.v, CAST(NULL AS BIGINT) AS j, CAST(NULL AS BIGINT) AS pk FROM own o JOIN gk g ON g.trace_id = o.trace_id AND g.k IS NULL AND (g.idx BETWEEN b_s AND b_e OR g.idx BETWEEN a_s AND a_e)
        UNION ALL SELECT o.trace_id, o.k, NULL, CASE WHEN t.k < o.k THEN t.k END, CASE WHEN t.k > o.k THEN t.k END FROM own o JOIN tk t ON t.trace_id = o.trace_id AND t.k <> o.k, LATERAL (SELECT unnest(range(t.s, t.e + 1)) AS i) WHERE i BETWEEN b_s AND b_e OR i BETWEEN a_s AND a_e)"""


@query(f"""WITH RECURSIVE {TASKS}, {SEEN},
    done AS (SELECT trace_id, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS levels FROM nn
        UNION ALL SELECT d.trace_id, d.k + 1, list_append(d.levels, x.level) FROM done d JOIN (SELECT trace_id, max(k) AS last FROM tk GROUP BY trace_id) m ON m.trace_id = d.trace_id AND d.k < m.last,
            LATERAL (SELECT median(coalesce(f.v, d.levels[f.j], z.level)) AS level FROM refs f LEFT JOIN (
                SELECT a.pk, CASE WHEN count(*) >= 8 THEN median(coalesce(a.v, d.levels[a.j])) ELSE any_value(a.whole) END AS level FROM around a WHERE a.trace_id = d.trace_id AND a.k = d.k + 1 GROUP BY a.pk) z ON z.pk = f.pk
                WHERE f.trace_id = d.trace_id AND f.k = d.k + 1) x)
SELECT tk.trace_id, s, e, round(levels[tk.k], 6) AS level FROM tk JOIN done ON done.trace_id = tk.trace_id AND len(levels) = (SELECT max(k) FROM tk t WHERE t.trace_id = tk.trace_id)""")
def levels_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks put at the level of their references, one after the other: each sees what those before it became."""
    df = flagged(spark, sf_dir)
    tasks = settled(blocks(df).withColumn("round", F.lit(0)), "tasks")
    values, _ = rounds.in_rounds(df, tasks, tasks.limit(0), rounds.at_reference_level, SR)
    return values.groupBy("trace_id", "s", "e").agg(r(F.max("w")).alias("level"))


@query(f"""WITH {FLAGGED}, gd AS (SELECT trace_id, idx, v FROM fl WHERE NOT bad), {BLOCKS},
    sd AS (SELECT bk.trace_id, s, e, gd.idx < s AS lf, median(v) AS m FROM bk JOIN gd ON gd.trace_id = bk.trace_id AND (gd.idx BETWEEN s - 298 AND s - 1 OR gd.idx BETWEEN e + 67 AND e + 364) GROUP BY ALL HAVING count(*) >= 4),
    sc AS (SELECT sd.trace_id, s, e, lf, m, 1.4826 * median(abs(v - m)) AS c FROM sd JOIN gd ON gd.trace_id = sd.trace_id AND ((lf AND gd.idx BETWEEN s - 298 AND s - 1) OR (NOT lf AND gd.idx BETWEEN e + 67 AND e + 364)) GROUP BY ALL),
    w AS (SELECT bk.*, idx, v + 5 * (idx % 7) AS w, (idx - s) / (e - s) AS t FROM bk JOIN fl ON fl.trace_id = bk.trace_id AND idx BETWEEN s AND e), f AS (SELECT trace_id, s, median(w) AS own, regr_slope(w, t) AS b, regr_intercept(w, t) AS a FROM w GROUP BY ALL),
    l AS (SELECT f.*, coalesce(x.m, own) AS ml, CASE WHEN x.m IS NULL THEN 0 ELSE x.c END AS cl, coalesce(y.m, x.m, own) AS mr, CASE WHEN y.m IS NULL THEN CASE WHEN x.m IS NULL THEN 0 ELSE x.c END ELSE y.c END AS cr FROM f LEFT JOIN sc x ON x.trace_id = f.trace_id AND x.s = f.s AND x.lf LEFT JOIN sc y ON y.trace_id = f.trace_id AND y.s = f.s AND NOT y.lf),
    z AS (SELECT w.*, ml + CASE WHEN abs(mr - ml) < 20 AND NOT (cr > 0 AND cl > 0 AND cr > 3 * greatest(cl, 0.5)) THEN mr - ml ELSE 0 END * t AS line, w.w - (a + b * t) AS rest FROM w JOIN l USING (trace_id, s)),
    p AS (SELECT trace_id, s, stddev_pop(rest + line) AS d FROM z GROUP BY ALL)
SELECT trace_id, s, idx, round(line + rest * CASE WHEN d > 15 THEN 15 / d ELSE 1 END, 6) AS w FROM z JOIN p USING (trace_id, s)""")
def realigned_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks put on the line of their surroundings and pressed to a deviation."""
    df = settled(flagged(spark, sf_dir).withColumn("w", F.col("v") + 5 * (F.col("idx") % 7)), "rebuilt")
    segs = settled(blocks(df).withColumns({"around_std": F.lit(10.0), "most_std": F.lit(15.0)}), "blocks")
    return restore.realigned(segs, df, "v", "w", "bad", SR).select("trace_id", "s", "idx", r("w").alias("w"))
