"""Stored samples and catalogs, paths with error codes, and event catalogs in order of precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import fresh_path, settled
from ..sources import catalogs, names
from ..sources.store import CatalogStore, SampleStore
from .quality import CATALOG, FILES, catalog, files
from .registry import query
from .views import TRC, table, trc


@query(f"WITH {TRC} SELECT trace_id, idx, CASE WHEN idx % 1000 BETWEEN 250 AND 760 AND idx < 1500 THEN v + 1 ELSE v END AS v FROM trc")
def range_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored samples after new values were written back for two ranges of each trace only."""
    df = settled(trc(spark, sf_dir).select("trace_id", "idx", "v"), "samples")
    store = SampleStore(spark, fresh_path(spark, "store"), block=700)
    store.append(df)
    starts = df.where("idx IN (250, 1250)").select("trace_id", F.col("idx").alias("s"), F.least(F.col("idx") + 510, F.lit(1499)).alias("e"))
    store.write_back(df.select("trace_id", "idx", (F.col("v") + 1).alias("w")), starts)
    return store.samples()


NEW_DAYS = "day LIKE '%6'"


@query(f"""WITH {CATALOG}, o AS (SELECT DISTINCT station, day, s, e, role AS kind, method, CASE WHEN s % 2 = 0 THEN 'seen' ELSE '' END AS note FROM ct)
SELECT station, day, s, e, kind, CASE WHEN hit THEN 'manual_apply' ELSE method END AS method, CASE WHEN hit THEN CASE WHEN note = '' THEN 'manual apply' ELSE note || ' | manual apply' END ELSE note END AS note
FROM (SELECT *, {NEW_DAYS} AND kind = 'repair' AND s <= 260 AND e >= 240 AND station <> 'S11' AS hit FROM o WHERE NOT ({NEW_DAYS}) OR s % 3 = 0)""")
def catalog_days_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored catalog after some days were replaced, with repairs marked that a manual range overlaps."""
    rows = catalog(spark, sf_dir).withColumnRenamed("role", "kind").distinct().withColumn("note", F.when(F.col("s") % 2 == 0, "seen").otherwise(""))
    rows = settled(rows, "rows")
    store = CatalogStore(spark, fresh_path(spark, "catalog"))
    store.append(rows)
    new = rows.where(NEW_DAYS).where("s % 3 = 0")
    manual = new.where("station <> 'S11'").select("station", "day", F.lit(240).alias("s"), F.lit(260).alias("e")).distinct()
    store.replace_days(new, manual)
    return store.read().select("station", "day", "s", "e", "kind", "method", "note")


#: Raw files lie flat but for some in folders, repaired ones by year and month, some elsewhere, some not at all; requests are all stations and days that orders have, and some more.
PATHS = f"""{FILES}, uq AS (SELECT name, st, d, frag, min(length) AS k FROM files WHERE NOT broken GROUP BY ALL),
    rw AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'old/' ELSE '' END || name AS rel FROM uq WHERE k % 7 <> 0),
    fx AS (SELECT *, CASE k % 3 WHEN 0 THEN name WHEN 1 THEN substr(d, 1, 4) || '/' || substr(d, 5, 2) || '/' || name ELSE 'deep/down/' || name END AS rel FROM uq WHERE k % 5 <> 1),
    rq AS (SELECT DISTINCT 'XA.' || st AS stream, st, d AS day FROM uq), ix AS (SELECT label, day, min('raw/' || rel) AS path FROM (SELECT unnest(CASE WHEN frag THEN ['XA.' || st || '.01.MHZ', st] ELSE ['XA.' || st, st] END) AS label, d AS day, rel FROM rw WHERE k % 11 <> 0) GROUP BY ALL)"""


def libraries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw files, repaired files, and the index of most of the raw ones."""
    found = files(spark, sf_dir).where("sta IS NOT NULL")
    one = settled(found.groupBy(*(c for c in found.columns if c != "length")).agg(F.min("length").alias("k")), "files")
    raw = one.where("k % 7 <> 0").withColumn("rel", F.concat(F.when(F.col("k") % 4 == 0, "old/").otherwise(""), "name")).withColumn("path", F.concat(F.lit("raw/"), "rel"))
    month = F.concat_ws("/", F.substring("day", 1, 4), F.substring("day", 5, 2), "name")
    fix = one.where("k % 5 <> 1").withColumn("rel", F.when(F.col("k") % 3 == 0, F.col("name")).when(F.col("k") % 3 == 1, month).otherwise(F.concat(F.lit("deep/down/"), "name"))).withColumn("path", F.concat(F.lit("fix/"), "rel"))
    return raw, fix, names.first_per_label(raw.where("k % 11 <> 0"))


@query(f"""WITH {PATHS}, fd AS (SELECT rq.*, coalesce(a.path, b.path, (SELECT min('raw/' || rel) FROM rw WHERE NOT frag AND rel = name AND rw.st = rq.st AND rw.d = rq.day)) AS found, (SELECT min('raw/' || rel) FROM rw WHERE frag AND rw.st = rq.st AND rw.d = rq.day) AS fragment
        FROM rq LEFT JOIN ix a ON a.label = stream AND a.day = rq.day LEFT JOIN ix b ON b.label = st AND b.day = rq.day),
    cp AS (SELECT fd.*, rw.rel, coalesce(x.rel, y.rel, z.rel) AS there FROM fd LEFT JOIN rw ON found = 'raw/' || rw.rel LEFT JOIN fx x ON x.rel = rw.rel LEFT JOIN fx y ON y.rel = substr(rw.d, 1, 4) || '/' || substr(rw.d, 5, 2) || '/' || rw.name
        LEFT JOIN (SELECT st, d, substr(min('fix/' || rel), 5) AS rel FROM fx GROUP BY ALL) z ON z.st = rw.st AND z.d = rw.d)
SELECT stream, day, coalesce(found, fragment) AS raw_path, CASE WHEN found IS NOT NULL THEN coalesce('fix/' || there, rel) END AS fix_path, CASE WHEN found IS NOT NULL THEN CASE WHEN there IS NULL THEN 'FIX_MISSING' END WHEN fragment IS NOT NULL THEN 'RAW_SEGMENT' ELSE 'RAW_MISSING' END AS error FROM cp""")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and repaired file of each stream and day, or why there is none."""
    raw, fix, index = libraries(spark, sf_dir)
    requests = files(spark, sf_dir).where("sta IS NOT NULL").select(F.concat(F.lit("XA."), "sta").alias("stream"), "day").distinct()
    return names.resolved(requests, index, raw, fix)


@query("""WITH f AS (SELECT 'catalog_' || (p_partkey % 50) || CASE WHEN p_partkey % 13 = 0 THEN '.txt' ELSE '.csv' END AS name, CAST(p_partkey % 3 AS INTEGER) AS priority, 'd' || (p_partkey % 3) || '/' || p_partkey || '/catalog_' || (p_partkey % 50) || CASE WHEN p_partkey % 13 = 0 THEN '.txt' ELSE '.csv' END AS path FROM part WHERE p_partkey % 9 <> 2 OR p_partkey % 3 <> 0)
SELECT name, priority, path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY priority, path) AS r FROM f WHERE name LIKE '%.csv') WHERE r = 1""")
def catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog file to go by for each name, by the precedence of its folder."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("catalog_"), (k % 50).cast("string"), F.when(k % 13 == 0, ".txt").otherwise(".csv"))
    found = table(spark, sf_dir, "part").where("p_partkey % 9 <> 2 OR p_partkey % 3 <> 0").select(name.alias("name"), (k % 3).cast("int").alias("priority"), F.concat_ws("/", F.concat(F.lit("d"), (k % 3).cast("string")), k.cast("string"), name).alias("path"))
    return catalogs.first_by_name(found, "catalog_")


EVENT_TIMES = "SELECT CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey % 1440 * 60 AS BIGINT)) AS t, o_orderkey AS k FROM orders"


@query(f"WITH e AS ({EVENT_TIMES}) SELECT DISTINCT source, strftime(t, '%Y%m%d') AS day, CAST(hour(t) * 3600 + minute(t) * 60 AS BIGINT) AS second FROM (SELECT 'override' AS source, t FROM e WHERE k % 10 = 1 UNION ALL SELECT 'packaged', t FROM e WHERE k % 10 = 2 UNION ALL SELECT 'csv', t FROM e WHERE k % 10 = 3 AND k % 4 <> 3)")
def event_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three sets of catalogs by day and second: with a JSON override, without one, and with CSV files only."""
    k, at = F.col("o_orderkey"), F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1440 * 60)
    rows = settled(table(spark, sf_dir, "orders").select(k.alias("k"), F.floor(k / 100_000).alias("g"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(at, "yyMMddHHmm").alias("short")), "events")
    listed = lambda where: rows.where(where).groupBy("g").agg(F.collect_list("iso").alias("events"))
    as_json = lambda where, k: listed(where).select(F.lit(k).alias("priority"), F.lit("json").alias("form"), F.to_json(F.struct(F.concat("events", F.array(F.lit("not a time"))).alias("events"))).alias("text"))
    empty = spark.createDataFrame([(0, "json", '{"events": []}'), (0, "json", "{broken")], "priority int, form string, text string")
    date = F.when(F.col("k") % 4 == 3, F.concat(F.lit("77047"), F.substring("short", 6, 5))).otherwise(F.col("short"))
    lines = rows.where("k % 10 = 3").groupBy("g").agg(F.concat_ws("\n", F.lit("No,Date,Kind"), F.array_join(F.collect_list(F.concat_ws(",", F.col("k").cast("string"), date, F.lit("x"))), "\n")).alias("text"))
    by_csv = lines.select(F.lit(2).alias("priority"), F.lit("csv").alias("form"), "text")
    override, packaged = as_json("k % 10 = 1", 0), as_json("k % 10 = 2", 1)
    sets = {"override": override.unionByName(packaged).unionByName(by_csv), "packaged": empty.unionByName(packaged).unionByName(by_csv), "csv": empty.unionByName(by_csv)}
    out = [catalogs.seconds_of_day(catalogs.events_of(docs)).withColumn("source", F.lit(name)) for name, docs in sets.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("source", "day", "second")
