"""Placement of rows in shards by a hierarchical weighted hash tree.

A topology is a tree of regions, racks and shards. At each level every child draws -ln(u) / weight, where u is a
uniform number hashed from the key and the child's name, and the smallest draw wins; the weight of an inner node is
the sum of its shards' weights. Draws of a child depend on nothing but its own weight, so that a change of weights
moves rows only into or out of the subtrees whose weights change. `grown` adds a shard as a region of its own: no
other weight changes, and rows move only into the new shard.

Cases: a null key hashes as the empty text, so all rows without a key share a shard; equal keys share a shard; a
null text has 0 bytes; an empty table gives no rows; other columns are passed through (one called like the output is replaced by it) or ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, bucket_of, col, key_text, others, with_totals_before


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def regular_topology(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """Equal shards, filled rack by rack and region by region."""
    return [Shard(f"r{i // (per_rack * racks_per_region)}", f"k{i // per_rack}", i) for i in range(shards)]


def grown(topology: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """With one more shard, in a region of its own."""
    new = max(s.shard for s in topology) + 1
    return [*topology, Shard(f"new{new}", f"new{new}", new, weight)]


def _drawn(key: Column, children: Column) -> Column:
    """The id of the child (name, weight, id) that draws least; ties go to the smaller id."""

    def draw(child: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(child["name"], F.lit("|"), key)), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / child["weight"]).alias("draw"), child["id"].alias("id"))

    return F.array_min(F.transform(children, draw))["id"]


def _children(nodes: Sequence[tuple[str, float, int]]) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(i).alias("id")) for name, weight, i in nodes))


def shard_of(df: DataFrame, key: str, topology: Sequence[Shard], out: str = "shard") -> DataFrame:
    """Adds the shard of each row: a region is drawn, then one of its racks, then one of that rack's shards."""
    tree: dict[str, dict[str, list[Shard]]] = {}
    for s in topology:
        if s.weight > 0:
            tree.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    racks = [(r, k) for r in tree for k in tree[r]]
    weight = {rk: sum(s.weight for s in tree[rk[0]][rk[1]]) for rk in racks}
    regions = _children([(r, sum(weight[r, k] for k in tree[r]), i) for i, r in enumerate(tree)])
    racks_of = F.array(*(_children([(f"{r}/{k}", weight[r, k], racks.index((r, k))) for k in tree[r]]) for r in tree))
    shards_of = F.array(*(_children([(f"{r}/{k}/{s.shard}", s.weight, s.shard) for s in tree[r][k]]) for r, k in racks))
    text = key_text(key)
    region = _drawn(text, regions)
    held = df.select(F.struct(*(col(c) for c in others(df, (out,)))).alias("row"), text.alias("key"), region.alias("region"))
    text = F.col("key")
    held = held.withColumn("rack", _drawn(text, F.element_at(racks_of, F.col("region") + 1)))
    held = held.withColumn("shard", _drawn(text, F.element_at(shards_of, F.col("rack") + 1)))
    return held.select("row.*", F.col("shard").alias(out))


def place(df: DataFrame, topology: Sequence[Shard], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: the key, size, text_crc32, law, shard, slot in the shard and grown_shard.

    Slots are numbered from 0 without gaps, by (hash of the key, key, text_crc32, size). The text itself isn't shuffled.
    """
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = df.select(col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = shard_of(shard_of(rows, "doc_id", topology), "doc_id", grown(topology), "grown_shard")
    rows = rows.withColumn("_hash", F.md5(key_text("doc_id"))).withColumn("_bucket", bucket_of(F.col("_hash"), bucket_bits(df.count() // len(topology))))
    rows = with_totals_before(rows, ["shard"], "_bucket", [F.col(c) for c in ("_hash", "doc_id", "text_crc32", "size")], F.lit(1).cast("long"), "slot")
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
