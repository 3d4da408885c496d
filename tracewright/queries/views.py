"""The driver's tables as traces: `tr` from events, `trc` with planted faults, `tru` of many short traces; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..operators.index import dense_index

SR = 6.625
#: Faults by place: frozen, a long and a short run of zeros, a pair of sentinels, saturation, spikes.
FAULTS = "CASE WHEN idx % 613 BETWEEN 300 AND 520 THEN 450 WHEN idx % 500 BETWEEN 100 AND 130 THEN 0 WHEN idx % 307 BETWEEN 50 AND 59 THEN 0 WHEN idx % 211 IN (7, 8) THEN -1 WHEN idx % 401 BETWEEN 200 AND 203 THEN 1023 WHEN idx % 251 = 17 THEN v + 500 ELSE v END"

TR = "tr AS (SELECT event_type AS trace_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, ts, CAST(400 + floor(value) AS DOUBLE) AS v FROM events)"
TRC = f"{TR}, trc AS (SELECT trace_id, idx, ts, v AS clean, CAST({FAULTS} AS DOUBLE) AS v FROM tr)"
MISSING = "(v <= -1 OR v = 0)"
#: Runs of a condition over trc, to be formatted with cond.
RUNS = "SELECT trace_id, min(idx) AS s, max(idx) AS e FROM (SELECT trace_id, idx, idx - row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS g FROM {table} WHERE {cond}) GROUP BY trace_id, g"
MISS_RUNS = f"{TRC}, miss AS ({RUNS.format(table='trc', cond=MISSING)})"
#: v without DC, and the padding of half-sample reflection by h places.
X = f"{TRC}, n AS (SELECT trace_id, max(idx) + 1 AS n, median(CASE WHEN v > -1 THEN v END) AS dc FROM trc GROUP BY trace_id), x AS (SELECT trace_id, idx, v, (CASE WHEN v > -1 THEN v ELSE 0 END) - dc AS x, n, dc FROM trc JOIN n USING (trace_id))"


def reflected(table: str, column: str, h: int) -> str:
    """Rows of a table (trace_id, idx, n, column) and their mirror images outside."""
    return f"(SELECT trace_id, idx, {column}, n FROM {table} UNION ALL SELECT trace_id, -1 - idx, {column}, n FROM {table} WHERE idx < {h} UNION ALL SELECT trace_id, 2 * n - 1 - idx, {column}, n FROM {table} WHERE idx >= n - {h})"


def rolling_sql(table: str, column: str, before: int, after: int, aggregate: str, out: str) -> str:
    """trace_id, idx and an aggregate over reflected rows."""
    return f"SELECT trace_id, idx, {out} FROM (SELECT trace_id, idx, n, {aggregate.format(column)} OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING) AS {out} FROM {reflected(table, column, max(before, after))}) WHERE idx BETWEEN 0 AND n - 1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("trace_id"), "ts", "event_id", (400 + F.floor("value")).cast("double").alias("v"))
    return dense_index(events, ["trace_id"], F.to_date("ts"), [F.col("ts"), F.col("event_id")]).select("trace_id", "idx", "ts", "v")


def trc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr(spark, sf_dir).select("trace_id", "idx", "ts", F.col("v").alias("clean"), F.expr(FAULTS).cast("double").alias("v"))


def exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as an experiment table: a unit, a record, a method and three metrics, averaged per unit and method in the order of the stored rows."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("method"), "l_discount", "l_tax", "l_quantity", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    found = stats.averages_in_order(rows, ["unit", "method"], {"rmse": "l_discount", "acf": "l_tax", "std_ratio": "l_quantity"}, ["_file", "_row"])
    return found.withColumn("record", F.col("unit") % 6)


EXP = "ex AS (SELECT l_suppkey AS unit, l_returnflag AS method, avg(l_discount) AS rmse, avg(l_tax) AS acf, avg(l_quantity) AS std_ratio, l_suppkey % 6 AS record FROM lineitem GROUP BY l_suppkey, l_returnflag)"


def r(column, places: int = 6):
    return F.round(column, places)


def nearest(column, places: int):
    """Rounded as the SQL's round does it: to the nearest whole of column * 10^places. r goes by the decimal digits instead, which takes 0.00015 up where 0.00015 * 10^4 is just below 1.5."""
    return F.round(column * 10**places) / 10**places
