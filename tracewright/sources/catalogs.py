"""Repair catalogs and event catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranges

KEY = ("station", "day", "s", "e", "kind", "method")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both by key, new ones first."""
    rows = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("_batch"), *(c for c in old.columns if c not in KEY)))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r", "_batch")


def marked_manual(rows: DataFrame, manual: DataFrame, bucket: int = ranges.BUCKET) -> DataFrame:
    """Rows where repairs that overlap a manual range (station, day, s, e) have method manual_apply and a note more. The join is on buckets of the place."""
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    by_hand = manual.select("station", "day", F.col("s").alias("_s"), F.col("e").alias("_e")).withColumn("_b", spread("_s", "_e"))
    repairs = rows.where("kind = 'repair'").select(*KEY).distinct().withColumn("_b", spread("s", "e"))
    marks = repairs.join(by_hand, ["station", "day", "_b"]).where("s <= _e AND e >= _s").select(*KEY).distinct().withColumn("_m", F.lit(True))
    rows = rows.join(marks, list(KEY), "left")
    note = F.concat_ws(" | ", F.nullif("note", F.lit("")), F.lit("manual apply"))
    return rows.withColumns({"note": F.when(F.col("_m"), note).otherwise(F.col("note")), "method": F.when(F.col("_m"), "manual_apply").otherwise(F.col("method"))}).drop("_m")


def day_replaced(old: DataFrame, new: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """All rows of the days in new replaced; new repair rows that overlap a manual range (station, day, s, e) are marked."""
    kept = old.join(new.select("station", "day").distinct(), ["station", "day"], "left_anti")
    return kept.unionByName(new if manual is None else marked_manual(new, manual))


def first_by_name(files: DataFrame, prefix: str, suffix: str = ".csv") -> DataFrame:
    """Of files (path, name, priority) called prefix...suffix the one of the least priority for each name, and of those the first path."""
    named = files.where(F.col("name").startswith(prefix) & F.col("name").endswith(suffix))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("priority", "path"))
    return named.withColumn("_r", rank).where("_r = 1").drop("_r")


def event_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """priority, form ('json' or 'csv') and text of the event catalogs among the paths that exist, the first being the one to go by."""
    found = spark.createDataFrame([], "priority int, form string, text string")
    conf = spark._jsc.hadoopConfiguration()
    for k, path in enumerate(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            rows = spark.read.text(path, wholetext=True)
            found = found.unionByName(rows.select(F.lit(k).alias("priority"), F.lit("csv" if path.endswith(".csv") else "json").alias("form"), F.col("value").alias("text")))
    return found


def events_of(documents: DataFrame) -> DataFrame:
    """event_ts, distinct, of the event catalog to go by: the first JSON document whose list `events` isn't empty, else all CSV documents.

    JSON events are ISO times, CSV ones stand in the column Date as YYMMDDHHMM; what isn't a time is dropped, and a document that can't be read counts as one without events.
    """
    events = F.from_json("text", "events array<string>")["events"]
    lists = documents.where("form = 'json'").select("priority", events.alias("events")).where(F.size("events") > 0)
    first = lists.agg(F.min("priority").alias("_first"))
    chosen = lists.join(F.broadcast(first), F.col("priority") == F.col("_first")).select(F.explode("events").alias("at"))
    by_json = chosen.select(F.to_timestamp_ntz(F.when(F.try_to_timestamp("at").isNotNull(), F.try_to_timestamp("at").cast("string"))).alias("event_ts")).where("event_ts IS NOT NULL")
    lines = documents.where("form = 'csv'").select(F.split(F.regexp_replace("text", "\r", ""), "\n").alias("lines"))
    place = F.array_position(F.transform(F.split(F.regexp_replace(F.col("lines")[0], "^\ufeff", ""), ","), F.trim), "Date").cast("int")
    # the column's place stands beside the lines before they are exploded, so that no line carries all of its document
    held = lines.select(place.alias("place"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("rest")).where("place > 0")
    dates = held.select("place", F.explode("rest").alias("line"))
    dates = dates.select(F.trim(F.try_element_at(F.split("line", ","), F.col("place"))).alias("Date")).where(F.col("Date").rlike("^[0-9]{10}$"))
    return by_json.unionByName(event_times(dates).join(F.broadcast(first.where("_first IS NOT NULL")), how="left_anti")).distinct()


def seconds_of_day(events: DataFrame) -> DataFrame:
    """day (YYYYMMDD) and the distinct seconds after its beginning, of event_ts."""
    return events.select(F.date_format("event_ts", "yyyyMMdd").alias("day"), (F.hour("event_ts") * 3600 + F.minute("event_ts") * 60 + F.second("event_ts")).cast("long").alias("second")).distinct()


def catalog_rows(segments: DataFrame, sr: float) -> DataFrame:
    """station, day, s, e, role, kind, method to catalog rows: repairs that lie whole within an event go, events and gaps are kept as such."""
    keys = ("station", "day")
    repairs = ranges.covered(segments.where("role = 'repair'"), segments.where("role = 'event'"), "left_anti", keys)
    rest = segments.where("role IN ('event', 'gap')").withColumns({"method": F.when(F.col("role") == "event", "catalog_protect").otherwise("keep"), "note": F.when(F.col("role") == "gap", "no data").otherwise("")})
    rows = repairs.withColumn("note", F.lit("")).unionByName(rest)
    return rows.withColumn("len_s", F.round((F.col("e") - F.col("s") + 1) / sr, 1)).withColumn("kind", F.col("role")).drop("role")


def event_times(df: DataFrame, date: str = "Date") -> DataFrame:
    """Distinct instants of dates written YYMMDDHHMM, in the 2000s before 70; what isn't a date is dropped."""
    d = F.lpad(F.trim(F.col(date)), 10, "0")
    part = lambda a, n=2: F.substring(d, a, n).try_cast("int")
    year = part(1) + F.when(part(1) < 70, 2000).otherwise(1900)
    made = F.try_make_timestamp_ntz(year, part(3), part(5), part(7), part(9), F.lit(0))
    return df.select(made.alias("event_ts")).where("event_ts IS NOT NULL").distinct()


def severity(ratio: Column, kurtosis: Column, spread: Column, in_signal: Column | None = None, in_noise: Column | None = None) -> Column:
    """0 to 100 from the share of outliers, the greatest kurtosis of a window (3 is normal), the deviation of the windows' kurtosis, and the outliers inside and outside a signal's window.

    Each part rises piece by piece: up to 25, 40, 15 and 20. Without a signal's window the last is 0.4 of the first, 10 at most.
    """
    by_ratio = F.when(ratio <= 0, 0.0).when(ratio < 0.001, 5.0).when(ratio < 0.01, 10 + 10 * ratio / 0.01).when(ratio < 0.05, 20 + 5 * (ratio - 0.01) / 0.04).otherwise(25.0)
    by_kurtosis = F.when(kurtosis <= 3, 0.0).when(kurtosis < 10, 10 * (kurtosis - 3) / 7).when(kurtosis < 50, 10 + 20 * (kurtosis - 10) / 40).when(kurtosis < 200, 30 + 10 * (kurtosis - 50) / 150).otherwise(40.0)
    by_spread = F.when(spread <= 0, 0.0).when(spread < 2, 3 * spread).when(spread < 10, 6 + 5 * (spread - 2) / 8).otherwise(15.0)
    if in_signal is None or in_noise is None:
        by_window = F.least(F.lit(10.0), by_ratio * 0.4)
    else:
        by_window = F.when((in_signal > 0) & (in_noise > 0), 20.0).when(in_signal > 0, 15.0).when(in_noise > 0, 8.0).otherwise(0.0)
    return F.least(F.lit(100.0), by_ratio + by_kurtosis + by_spread + by_window)


def severity_label(score: Column) -> Column:
    return F.when(score < 10, "none").when(score < 35, "mild").when(score < 65, "moderate").otherwise("severe")


def recommendation(label: Column, ratio: Column, in_signal: Column, in_noise: Column) -> Column:
    """What to do about outliers of that severity."""
    moderate = F.when(in_signal > 0, "suggest_clean").otherwise("optional_review")
    severe = F.when(in_signal > 0, "strongly_recommend_clean").when((in_noise > 0) & (ratio > 0.01), "recommend_clean").otherwise("suggest_clean")
    return F.when(label == "none", "no_action").when(label == "mild", "optional_review").when(label == "moderate", moderate).otherwise(severe)
