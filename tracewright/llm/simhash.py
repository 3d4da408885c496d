"""Near-duplicate detection by SimHash with covering locality-sensitive hashing.

Fingerprints within Hamming distance r are found through 2^(r+1)-1 masks. Bit i carries a non-zero vector of r+1 bits,
and mask v keeps the bits whose vector has an odd inner product with v. The vectors of r or fewer differing bits span
less than the whole space, so some v is orthogonal to all of them: under that mask the two fingerprints are equal, and
every pair within the radius meets in some table.

A table's bucket with many fingerprints is split once more by the masks of the bits that it leaves free. What is left
then has fewer than 2^14 distinct fingerprints, which one task searches; it returns a spanning forest of the links, never all pairs.

Cases: a null text counts as empty, and texts without words have fingerprint zero and are linked like others; rows
without an id get the component of their fingerprint but link nothing (null if no row with an id has it); repeated
rows and equal ids are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen_join, col, pieces, rows_of, spread_join, written
from .components import connected

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: A bucket with more distinct fingerprints than this is split by a second set of masks.
CROWDED = 2048


def masks(positions: list[int], radius: int = RADIUS) -> list[list[int]]:
    """For each of the 2^(radius+1)-1 masks, the positions that it keeps."""
    vectors = (1 << (radius + 1)) - 1
    return [[p for i, p in enumerate(positions) if ((1 + i % vectors) & v).bit_count() % 2] for v in range(1, vectors + 1)]


def signed(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is 1 if more than half of the shingles' XXH64 have it; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    first = np.concatenate([[0], ends[: n - 1] + 1])
    counts = np.zeros(BITS, np.int64)
    xxh = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        h = np.array([xxh(joined[a:b], seed) for a, b in zip(first[at : at + (1 << 16)].tolist(), last[at : at + (1 << 16)].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint as a long (its bit pattern) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = np.array([fingerprint(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out)], names=["doc_id", "text_hash", "fp"])

    rows = df.select(col(key).cast("long").alias("doc_id"), F.xxhash64(col(text).cast("string")).alias("text_hash"), col(text).cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, text_hash long, fp long")


def forest(values: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within the radius: each value is compared with those not yet reached."""
    links, left = [], np.arange(len(values))
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= radius
            if near.any():
                links += [(int(nodes[at]), int(nodes[j])) for j in left[near]]
                reached += left[near].tolist()
                left = left[~near]
    return links


def _links(radius: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, part, node, fp) sorted by bucket; a bucket may go on in the next batch."""
        held: list[np.ndarray] = []

        def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(parts)
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            found: list[tuple[int, int]] = []
            for group in np.split(rows, cuts):
                if len(group) > 1:
                    found += forest(group[:, 3].view(np.uint64), group[:, 2], radius)
            pairs = np.array(sorted({(max(p), min(p)) for p in found}), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.int64)
            if not len(rows):
                continue
            change = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield flush([*held, rows[:cut]])
                held = [rows[cut:].copy()]
            else:
                held.append(rows)
                if (held[0][0, :2] != rows[0, :2]).any():
                    yield flush(held[:-1])
                    held = [rows]
        if held:
            yield flush(held)

    return each


def near_links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the nodes of (node, fp), enough to connect all that is within the radius."""

    bucket = ["bucket", "part"]

    def tables(df: DataFrame, part, kept) -> DataFrame:
        """part, kept: for each row, the tables and what their masks keep of the fingerprint."""
        rows = df.select("node", "fp", F.explode(F.arrays_zip(part.alias("part"), kept.alias("bucket"))).alias("t"))
        return rows.select("t.bucket", F.col("t.part").cast("long").alias("part"), "node", "fp")

    level1 = masks(list(range(BITS)), radius)
    first = tables(values, F.array(*(F.lit(i) for i in range(len(level1)))), F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in level1)))
    crowded = written(first.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select(*bucket), "simhash-crowded")
    finer = []
    for m in level1:
        free = [b for b in range(BITS) if b not in set(m)]
        finer.append([signed(m + s) for s in masks(free, radius)])
    # the masks of the second level by the table of the first
    choose = F.element_at(F.array(*(F.array(*(F.lit(x) for x in row)) for row in finer)), F.col("part").cast("int") + 1)
    split = chosen_join(first, crowded, bucket, F.col("node")).select("node", "fp", F.transform(choose, lambda m: F.col("fp").bitwiseAND(m)).alias("kept"), F.transform(F.sequence(F.lit(1), F.lit(len(level1))), lambda i: F.col("part") * 16 + 15 + i).alias("tables"))
    second = tables(split, F.col("tables"), F.col("kept"))
    rows = chosen_join(first, crowded, bucket, F.col("node"), "left_anti").select(*bucket, "node", "fp").unionByName(second)
    # a bucket now has CROWDED fingerprints at most, or as many as a second mask leaves: none can grow with the data
    return rows.repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(_links(radius), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp (long) and component_id of every row: the smallest id reachable over links within the radius."""
    rows = written(fingerprints(df, key, text), "fingerprints")
    values = written(rows.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "fingerprint-values")
    roots = connected(near_links(values.where("node IS NOT NULL").select("node", "fp"), radius))
    named = written(values.join(roots, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("component_id")), "fingerprint-components")
    return spread_join(rows, named, "fp", "n").select("doc_id", "text_hash", "fp", "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """df with one row of each component: the one with the smallest id (one without an id only where all lack it)."""
    found = near_duplicates(df, key, text, radius)
    apart = F.when(F.col("component_id").isNull(), F.col("fp"))
    best = found.groupBy("component_id", apart.alias("apart")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"))
    return rows_of(df, written(best.select("best.doc_id", "best.text_hash").distinct().withColumn("copies", F.lit(1)), "kept"), key, text)


def hex16(col):
    return F.lpad(F.lower(F.hex(col)), 16, "0")
