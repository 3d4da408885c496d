"""Benchmark decontamination by greedy string tiling.

Documents and test items that share a run of `shortest` words meet. Their words are tiled: the longest runs that both
still have unmarked are found by Karp-Rabin hashes of windows, marked, and searched again until none of `shortest`
words is left. Tiles may come in any order, so reordered passages count too. A document is contaminated by an item if tiles cover
the stated share of the item's words.

A benchmark of up to BLOCK_WORDS words (they are counted first) goes to every task as an index of seeds. Of a larger one only a
bitmap of seeds of fixed size does; the documents' runs that it lets through are joined with the items' seeds, and each
pair of a document and an item is tiled by itself. Both ways are one pass over the documents and give the same rows.

Cases: words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased; a null text counts as empty;
items of fewer than `shortest` words contaminate nothing (they would mark clean documents); of items that cover equally, the smallest id is
named (null last); items without an id, and repeated ones, count one by one; rows of documents are kept as they are, repeated or
without id; an empty benchmark leaves every document clean; input columns called like an output are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, col, others, pieces, whole_row, written
from .words import WordHasher, chained

SHORTEST, COVERAGE = 5, 0.8
BLOCK_WORDS = 1_000_000
_BITS = 22
#: Bits of the bitmap that stands for the seeds of a large benchmark: 2^27 bits are 16 MB.
BITMAP_BITS = 27


class Windows:
    """Karp-Rabin hashes of all windows of a sequence, of any length, from running sums."""

    R = 0x5851F42D4C957F2D

    def __init__(self, words: np.ndarray):
        n = len(words)
        step, back = np.full(n + 1, self.R, np.uint64), np.full(n + 1, pow(self.R, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.multiply.accumulate(step)[:n])])

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[starts + length] - self.sums[starts]) * self.back[starts]


def tile(item: np.ndarray, doc: np.ndarray, breaks: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length), the longest first; breaks: positions of doc where a run starts, over which no tile may go on."""
    item_windows, doc_windows = Windows(item), Windows(doc)
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)

    def starts(free: np.ndarray, length: int, cuts: np.ndarray | None) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(~free)])
        ok = taken[length:] == taken[:-length]
        if cuts is not None and len(cuts):
            run = np.cumsum(np.bincount(cuts, minlength=len(free)))
            ok &= run[length - 1 :] == run[: len(run) - length + 1]
        return np.flatnonzero(ok)

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        i, j = starts(free_item, length, None), starts(free_doc, length, breaks)
        hi, hj = item_windows.of(i, length), doc_windows.of(j, length)
        keep = np.isin(hj, hi)
        return i, hi, j[keep], hj[keep]

    tiles, longest = [], min(len(item), len(doc))
    while longest >= shortest:
        low, high = shortest - 1, longest  # the longest length that both have: if there is one, all shorter ones are there
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(common(mid)[2]) else (low, mid - 1)
        longest = low
        if longest < shortest:
            break
        i, hi, j, hj = common(longest)
        where: dict[int, list[int]] = {}  # item places by hash, the first one last
        for h, at in zip(hi[::-1].tolist(), i[::-1].tolist(), strict=True):
            where.setdefault(h, []).append(at)
        end = 0  # of the last tile in the document; tiles of one length overlap only at their ends
        for h, to in zip(hj.tolist(), j.tolist(), strict=True):
            places = where[h]
            while to >= end and places:
                at = places[-1]
                if not (free_item[at] and free_item[at + longest - 1]):
                    places.pop()
                    continue
                if (item[at : at + longest] == doc[to : to + longest]).all():
                    free_item[at : at + longest] = free_doc[to : to + longest] = False
                    tiles.append((at, to, longest))
                    end = to + longest
                break
        if not tiles or tiles[-1][2] != longest:
            longest -= 1  # equal hashes of unequal words
    return tiles


def covering(item: np.ndarray, words: np.ndarray, places: np.ndarray, shortest: int) -> float:
    """The share of the item's words that tiles cover; words: those of the document at the given places, where seeds are."""
    breaks = np.flatnonzero(np.diff(places) > 1) + 1
    return sum(t[2] for t in tile(item, words, breaks, shortest)) / len(item)


def _better(share: float, item_id: object, best: float, best_id: object) -> bool:
    """Whether an item is to be named rather than the best so far."""
    return share > best or share == best and share > 0 and item_id is not None and (best_id is None or item_id < best_id)


class Items:
    """Test items and an index of their seeds."""

    def __init__(self, ids: list, texts: list[bytes], shortest: int):
        self.shortest = shortest
        words, counts, _ = WordHasher(punctuation=True).hash(texts)
        parts = np.split(words, np.cumsum(counts)[:-1]) if len(ids) else []
        self.items = [(i, w) for i, w in zip(ids, parts, strict=True) if len(w) >= shortest]
        seeds = [chained(w, shortest) for _, w in self.items]
        own = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        every = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.seeds, self.owners = every[order], own[order]
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[every >> np.uint64(64 - _BITS)] = True

    def coverage(self, words: np.ndarray, grams: np.ndarray, hits: np.ndarray) -> Iterator[tuple[object, float]]:
        """Items that share a seed with a document and how much of each its tiles cover; hits: where grams are seeds."""
        low, high = np.searchsorted(self.seeds, grams[hits], "left"), np.searchsorted(self.seeds, grams[hits], "right")
        where: dict[int, set[int]] = {}
        for at, a, b in zip(hits.tolist(), low.tolist(), high.tolist(), strict=True):
            for k in self.owners[a:b].tolist():
                where.setdefault(k, set()).add(at)
        for k, at in where.items():
            covered = np.unique((np.array(sorted(at))[:, None] + np.arange(self.shortest)).ravel())
            item_id, item = self.items[k]
            yield item_id, covering(item, words[covered], covered, self.shortest)


def _matches(items: Items, threshold: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, n = WordHasher(punctuation=True), items.shortest
        for batch in pieces(batches):
            cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names) if name in ("n_items", "item_id", "coverage")}
            words, counts, _ = hasher.hash([t or b"" for t in batch.column(batch.schema.names.index("text")).cast(pa.binary()).to_pylist()])
            grams = chained(words, n)
            found = np.flatnonzero(items.filter[grams >> np.uint64(64 - _BITS)]) if len(items.seeds) else np.zeros(0, np.int64)
            if len(found):
                found = found[items.seeds[np.minimum(np.searchsorted(items.seeds, grams[found]), len(items.seeds) - 1)] == grams[found]]
            ends = np.cumsum(counts)
            owner = np.searchsorted(ends, found, "right")
            found, owner = found[found + n <= ends[owner]], owner[found + n <= ends[owner]]
            for row in np.unique(owner).tolist():
                hits = found[owner == row]
                base, end = int(ends[row] - counts[row]), int(ends[row])
                for item_id, share in items.coverage(words[base:end], grams[base : max(base, end - n + 1)], hits - base):
                    if _better(share, item_id, cols["coverage"][row], cols["item_id"][row]):
                        cols["coverage"][row], cols["item_id"][row] = share, item_id
                    cols["n_items"][row] += share >= threshold
            out = [pa.array(cols[f.name], f.type) if f.name in cols else batch.column(i) for i, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(out, schema=batch.schema)

    return each


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", shortest: int = SHORTEST, threshold: float = COVERAGE) -> DataFrame:
    """All columns of docs, then n_items (items that the row contaminates), item_id (the best covered, or null) and coverage (its share)."""
    items = benchmark.select(col(item).alias("item_id"), F.coalesce(col(item_text).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    if size > BLOCK_WORDS:
        return _joined(docs, items, text, shortest, threshold)
    rows = items.collect()
    held = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r["text"].encode() for r in rows]))
    names = others(docs, OUTPUTS)
    inner = docs.select(*(col(c).alias(f"c{i}") for i, c in enumerate(names)), col(text).cast("string").alias("text"), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("coverage"))
    found = inner.mapInArrow(_broadcast_matches(held, shortest, threshold), inner.schema)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *OUTPUTS)


OUTPUTS = ("n_items", "item_id", "coverage")


def _broadcast_matches(held, shortest: int, threshold: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _matches(Items(*held.value, shortest), threshold)(batches)

    return each


def _item_seeds(shortest: int):
    """(n, text) to (n, words, seeds), for items that are long enough."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(punctuation=True)
        for batch in pieces(batches):
            words, counts, _ = hasher.hash([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            parts = [w for w in np.split(words, np.cumsum(counts)[:-1])]
            rows = [{"n": n, "words": w.view(np.int64).tolist(), "seeds": np.unique(chained(w, shortest)).view(np.int64).tolist()} for n, w in zip(batch.column(0).to_pylist(), parts, strict=True) if len(w) >= shortest]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("n", pa.int64()), ("words", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64()))]))

    return each


def _hits(held, shortest: int):
    """(k1, k2, text) to (k1, k2, at, seed, words): the runs of words whose hashes the bitmap knows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bitmap = WordHasher(punctuation=True), np.frombuffer(held.value, np.uint8)
        for batch in pieces(batches):
            words, counts, _ = hasher.hash([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()])
            grams, ends = chained(words, shortest), np.cumsum(counts)
            bit = (grams >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            found = np.flatnonzero(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            owner = np.searchsorted(ends, found, "right")
            inside = found + shortest <= ends[owner]
            found, owner = found[inside], owner[inside]
            runs = words[found[:, None] + np.arange(shortest)].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * shortest), pa.array(runs.ravel()))
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found - (ends - counts)[owner]), pa.array(grams[found].view(np.int64)), lists], names=["k1", "k2", "at", "seed", "run"])

    return each


def _tiled(shortest: int):
    """(k1, k2, n, hits, words) to (k1, k2, n, share)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = []
            for hits, item in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                at = np.array([h["at"] for h in hits])
                places, first = np.unique((at[:, None] + np.arange(shortest)).ravel(), return_index=True)
                words = np.array([h["run"] for h in hits], np.int64).ravel()[first].view(np.uint64)
                shares.append(covering(np.array(item, np.int64).view(np.uint64), words, places, shortest))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shares, pa.float64())], names=["k1", "k2", "n", "share"])

    return each


def _joined(docs: DataFrame, items: DataFrame, text: str, shortest: int, threshold: float) -> DataFrame:
    """The same rows for a benchmark that is too large to broadcast."""
    items = written(items.withColumn("n", F.monotonically_increasing_id()), "items")
    index = written(items.select("n", "text").mapInArrow(_item_seeds(shortest), "n long, words array<long>, seeds array<long>"), "item-seeds")
    seeds = index.select(F.explode("seeds").alias("seed"), "n")
    bit = F.shiftrightunsigned("seed", 64 - BITMAP_BITS)
    set_bits = seeds.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - BITMAP_BITS}) & 63 as int))")).alias("bits")).collect()  # at most 2^(BITMAP_BITS - 6) rows
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bitmap[[r["at"] for r in set_bits]] = [r["bits"] for r in set_bits]
    held = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    keys = [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit("second"), body).alias("k2")]
    hits = docs.select(*keys, body.alias("text")).mapInArrow(_hits(held, shortest), "k1 long, k2 long, at long, seed long, run array<long>").dropDuplicates(["k1", "k2", "at"])
    pairs = hits.join(seeds, "seed").groupBy("k1", "k2", "n").agg(F.collect_list(F.struct("at", "run")).alias("hits"))
    tiled = pairs.join(index.select("n", "words"), "n").select("k1", "k2", "n", "hits", "words").mapInArrow(_tiled(shortest), "k1 long, k2 long, n long, share double")
    best = F.min(F.struct((-F.col("share")).alias("least"), F.col("item_id").isNull().alias("none"), "item_id"))
    found = tiled.where("share > 0").join(items.select("n", "item_id"), "n").groupBy("k1", "k2").agg(F.sum((F.col("share") >= threshold).cast("long")).alias("n_items"), best.alias("best"))
    found = written(found, "contaminated")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    rows = docs.select(whole_row(docs).alias("row"), *keys).join(found, ["k1", "k2"], "left")
    passed = [F.col("row").getField(c).alias(c) for c in others(docs, OUTPUTS)]
    return rows.select(*passed, F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.col("best.item_id").alias("item_id"), F.coalesce(-F.col("best.least"), F.lit(0.0)).alias("coverage"))
