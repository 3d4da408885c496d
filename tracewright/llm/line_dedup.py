"""Removal of lines that stand on many sites.

Each line's sites are counted by a HyperLogLog sketch, merged by aggregation. Only lines that occur at least as often as the
threshold are sketched, as no other can be on that many sites; lines whose estimate is near the threshold get an exact
distinct count. Lines on at least `sites` sites are boilerplate, and every text is written again without them.

Cases: lines are compared without the white space around them, and empty lines always stay; a null text counts as
empty; a null site is a site of its own; rows with null ids and repeated rows are cleaned like others; an empty table
gives no rows; other columns are passed through, but input columns called n_lines and n_removed are replaced by the outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen_join, col, others, whole_row, written

SITES = 10
#: Estimates within this share of the threshold are checked by an exact count. With 2^12 registers the standard error is 1.6 %.
BAND, REGISTERS = 0.2, 12
_EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def line_table(rows: DataFrame) -> DataFrame:
    """A row for every line that isn't empty, from (doc_id, text, site): doc_id, a hash of the row's text, site, place and a 128-bit hash of the line."""
    lines = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", _EDGES, "")).where("line <> ''")
    return lines.select("doc_id", "text_hash", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """h1, h2 of the lines on at least so many sites.

    Counts and sketches are merged by partial aggregation, and joins keep to frequent lines that are broadcast or dealt
    by site: a line that stands in every document is never one task's work.
    """
    keys = ["h1", "h2"]
    often = written(lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites).select(*keys), "lines-often")
    some = chosen_join(lines.select(*keys, "site"), often, keys, F.col("site"))
    spread = some.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(REGISTERS))).alias("estimate"))
    spread = written(spread.where(F.col("estimate") >= sites * (1 - BAND)), "lines-spread")
    near = spread.where(F.col("estimate") <= sites * (1 + BAND)).select(*keys)
    pairs = chosen_join(lines.select(*keys, "site"), near, keys, F.col("site")).distinct()
    exact = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites)
    return spread.where(F.col("estimate") > sites * (1 + BAND)).select(*keys).unionByName(exact.select(*keys))


def without_boilerplate(df: DataFrame, sites: int = SITES, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """All columns of df with the text cleaned, then n_lines and n_removed."""
    names = others(df, ("n_lines", "n_removed"))
    rows = df.select(col(key).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(col(site).cast("string"), F.lit("")).alias("site"), whole_row(df).alias("row"))
    lines = written(line_table(rows), "lines")
    bad = written(boilerplate(lines, sites), "boilerplate")
    marked = chosen_join(lines, bad, ["h1", "h2"], F.struct("doc_id", "pos")).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("removed"))
    on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.hash") == F.col("r.text_hash"))
    rows = rows.select("row", "doc_id", F.xxhash64("text").alias("hash")).alias("l").join(marked.alias("r"), on, "left")
    rows = rows.select("row", F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")).alias("text"), F.coalesce("r.removed", F.array().cast("array<int>")).alias("removed")).withColumn("lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    cleaned = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n"))
    passed = [cleaned.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names]
    return rows.select(*passed, F.size("lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"))
