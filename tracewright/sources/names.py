"""Files of traces by their names: NET.STA.YYYYMMDD.mseed, or NET.STA.LOC.CHA.START-END.mseed for fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECONDS_PER_FILE = 0.9


def listed(spark, root: str) -> DataFrame:
    """path, name and length of all files below root, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def parsed(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds net, sta, loc, cha, day: null where the name isn't one of the two forms or the day isn't eight digits."""
    parts = F.split(F.regexp_replace(F.col(name), r"(?i)\.mseed$", ""), r"\.")
    count, is_file = F.size("_p"), F.col(name).rlike(r"(?i)\.mseed$")
    day_file, fragment = is_file & (count == 3), is_file & (count >= 5)
    start = F.substring(F.regexp_replace(F.element_at(F.split(F.get("_p", F.lit(4)), "-"), 1), "_", ""), 1, 8)
    df = df.withColumn("_p", F.explode(F.array(parts)))  # split once: a plain column would be put in each place that uses it
    day = F.when(day_file, F.get("_p", F.lit(2))).when(fragment, start)
    ok = day.rlike("^[0-9]{8}$") & (F.get("_p", F.lit(0)) != "") & (F.get("_p", F.lit(1)) != "")
    pick = lambda one, other: F.when(ok & day_file, one).when(ok & fragment, other)
    return df.withColumns({"net": pick(F.get("_p", F.lit(0)), F.get("_p", F.lit(0))), "sta": pick(F.get("_p", F.lit(1)), F.get("_p", F.lit(1))), "loc": pick(F.lit(""), F.get("_p", F.lit(2))), "cha": pick(F.lit(""), F.get("_p", F.lit(3))), "day": F.when(ok, day)}).drop("_p")


def in_scope(files: DataFrame, stations: list[str], first: int, last: int) -> Column:
    day = F.col("day").cast("int")
    return F.col("sta").isNotNull() & (F.lit(not stations) | F.col("sta").isin(stations)) & day.between(first, last)


def stations_and_years(files: DataFrame) -> DataFrame:
    """One row: the distinct stations and years of the files, in order, with commas between."""
    listed_in_order = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return files.where("sta IS NOT NULL").agg(listed_in_order(F.col("sta")).alias("stations"), listed_in_order(F.substring("day", 1, 4)).alias("years"))


def diagnosed(files: DataFrame, stations: list[str], first: int, last: int) -> DataFrame:
    """One row: names seen, and those that fail first by form, then by station, then by day."""
    bad_name = F.col("sta").isNull()
    bad_sta = ~bad_name & ~(F.lit(not stations) | F.col("sta").isin(stations))
    bad_day = ~bad_name & ~bad_sta & ~F.col("day").cast("int").between(first, last)
    return files.agg(F.count(F.lit(1)).alias("seen"), F.count_if(bad_name).alias("bad_name"), F.count_if(bad_sta).alias("bad_sta"), F.count_if(F.coalesce(bad_day, F.lit(False))).alias("bad_day"), F.countDistinct("sta").alias("stations"))


def quick_scan(files: DataFrame) -> DataFrame:
    """Files, bytes and estimated seconds by month."""
    month = F.concat_ws("-", F.substring("day", 1, 4), F.substring("day", 5, 2))
    return files.where("day IS NOT NULL").groupBy(month.alias("ym")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).withColumn("est_sec", F.col("files") * SECONDS_PER_FILE)


def stream_label(net: str = "net", sta: str = "sta", loc: str = "loc", cha: str = "cha") -> Column:
    """Parts that aren't empty, with dots between."""
    return F.concat_ws(".", *(F.nullif(F.col(c), F.lit("")) for c in (net, sta, loc, cha)))


def split_stream_label(label: Column) -> Column:
    """Network, station, location and channel of a label; a label of one part is a station, one of three has no location."""
    p = F.split(label, r"\.")
    n = F.size(p)
    at = lambda i: F.try_element_at(p, F.lit(i))
    return F.struct(F.when(n > 1, at(1)).otherwise("").alias("net"), F.when(n == 1, at(1)).otherwise(at(2)).alias("sta"), F.when(n >= 4, at(3)).otherwise("").alias("loc"), F.when(n >= 4, at(4)).when(n == 3, at(3)).otherwise("").alias("cha"))


def counterparts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each path of left with the path of right for it: same relative path, else same year/month/name, else same station and day (the first by path)."""
    month = lambda d: F.concat_ws("/", F.substring(d, 1, 4), F.substring(d, 5, 2), F.col("name"))
    l, r = left.withColumn("_ym", month("day")), right.withColumn("_ym", F.col("rel"))
    a = r.select(F.col("rel").alias("_a"), F.col("path").alias("p1"))
    b = r.select(F.col("rel").alias("_b"), F.col("path").alias("p2"))
    c = right.where("sta IS NOT NULL").groupBy(F.col("sta").alias("_s"), F.col("day").alias("_d")).agg(F.min("path").alias("p3"))
    rows = l.join(a, F.col("rel") == F.col("_a"), "left").join(b, F.col("_ym") == F.col("_b"), "left").join(c, (F.col("sta") == F.col("_s")) & (F.col("day") == F.col("_d")), "left")
    other = lambda p: F.when(F.col(p) != F.col("path"), F.col(p))
    return rows.select("path", F.coalesce(other("p1"), other("p2"), other("p3")).alias("counterpart"))


def resolved(requests: DataFrame, index: DataFrame, raw: DataFrame, fix: DataFrame) -> DataFrame:
    """stream, day, raw_path, fix_path, error for requests (stream, day), where stream is a label or a station.

    The raw file is the index's (label, day, path) for the stream, else for its station; else the raw file called NET.STATION.DAY.mseed at the root; else the first fragment of that station and day, which
    is no whole day: RAW_SEGMENT. With none of these: RAW_MISSING. The repaired file is its counterpart among `fix`; without one the path is where it should be: FIX_MISSING.
    raw and fix are parsed files with path and rel, the path below their root.
    """
    asked = requests.withColumn("sta", split_stream_label(F.col("stream"))["sta"])
    held = index.select(F.col("label").alias("_label"), F.col("day").alias("_day"), F.col("path").alias("_path"))
    whole = raw.where("loc = '' AND cha = '' AND rel = name").groupBy("sta", "day").agg(F.min("path").alias("guess"))
    parts = raw.where("cha <> ''").groupBy("sta", "day").agg(F.min("path").alias("fragment"))
    rows = asked.join(held.withColumnRenamed("_path", "by_label"), (F.col("stream") == F.col("_label")) & (F.col("day") == F.col("_day")), "left").drop("_label", "_day")
    rows = rows.join(held.withColumnRenamed("_path", "by_station"), (F.col("sta") == F.col("_label")) & (F.col("day") == F.col("_day")), "left").drop("_label", "_day")
    rows = rows.join(whole, ["sta", "day"], "left").join(parts, ["sta", "day"], "left")
    rows = rows.select("stream", "day", F.coalesce("by_label", "by_station", "guess").alias("found"), "fragment")
    pairs = counterparts(raw, fix).select(F.col("path").alias("_path"), "counterpart").join(raw.select(F.col("path").alias("_path"), "rel"), "_path")
    rows = rows.join(pairs, F.col("found") == F.col("_path"), "left")
    error = F.when(F.col("found").isNotNull(), F.when(F.col("counterpart").isNull(), "FIX_MISSING")).when(F.col("fragment").isNotNull(), "RAW_SEGMENT").otherwise("RAW_MISSING")
    return rows.select("stream", "day", F.coalesce("found", "fragment").alias("raw_path"), F.when(F.col("found").isNotNull(), F.coalesce("counterpart", "rel")).alias("fix_path"), error.alias("error"))


def first_per_label(files: DataFrame) -> DataFrame:
    """The first path of each stream label and day, and of each bare station and day."""
    labels = files.where("sta IS NOT NULL").select(F.explode(F.array_distinct(F.array(stream_label(), F.col("sta")))).alias("label"), "day", "path")
    return labels.groupBy("label", "day").agg(F.min("path").alias("path"))


def by_priority(traces: DataFrame, file: str, loc: str | None, cha: str | None, fallback: str = "MHZ") -> DataFrame:
    """One trace per file: the wanted location and channel, else the fallback channel, else the first."""
    wanted = F.lit(True) if loc is None else F.col("loc") == loc
    wanted &= F.lit(True) if cha is None else F.col("cha") == cha
    rank = F.when(F.lit(loc is not None or cha is not None) & wanted, 0).when(F.col("cha") == fallback, 1).otherwise(2)
    return traces.withColumn("_r", F.row_number().over(Window.partitionBy(file).orderBy(rank, "pos"))).where("_r = 1").drop("_r")
