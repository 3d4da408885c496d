"""Product codes of vectors, with memoised grid cells for the nearest entries.

Components become whole numbers, vectors are cut into equal parts, and each part position has a codebook that a few rounds of
k-means refine. All arithmetic is on integers, so that results don't depend on how rows are dealt.

The nearest entry of a part is found through a grid: the part's coarse cell is hashed, and the cell's entry in the memo lists the
codebook entries that aren't dominated across its box, which are those whose least distance to the box is no more than the smallest of all
entries' largest distances to it. Only these are evaluated exactly, so equal distances still go to the lower index. A memo belongs to one task,
part and codebook and is emptied when it holds MEMO_CELLS cells; that and the width of cells change the time taken, never a result.

A round is one pass over the table: each task sums what it assigned to each entry, sums meet by entry, and the driver gets the codebooks, whose
size is entries x dimension. Vectors are read anew each round and never shuffled.

Cases: rows whose vector is null or holds a null, NaN or infinite component are dropped; so that sums stay whole numbers, components of more than
16,384 count as 16,384. The dimension is that of the smallest kept id's vector; a vector of another length, or any if the dimension isn't a positive multiple of the
parts, can't be cut and gets a null code and error. Fewer vectors than entries make smaller codebooks; repeated rows are coded alike; null ids come last; of equal
ids the lesser vector comes first; an empty table gives no rows; other columns are passed through, but input columns called code and error are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, col, free_name, others, pieces, spread_join, whole_row, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: The largest component, so that sums of squares over vectors of up to 4,096 components stay below 2^63.
LARGEST = 16_384
#: Cells that a memo holds at most, and cells across the usual spread of a codebook's components.
MEMO_CELLS, CELLS_PER_SPREAD = 32_768, 4

Codebooks = list[np.ndarray]  # of each part: entries x components


def usable(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(broken, F.lit(False))


def whole_numbers(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), of components up to LARGEST."""
    return np.floor(SCALE * np.clip(flat.astype(np.float64), -LARGEST, LARGEST)).astype(np.int64)


def of_dimension(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors have the dimension, and those as whole numbers."""
    sizes = np.diff(vectors.offsets.to_numpy())
    right = sizes == dimension
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return right, whole_numbers(flat[np.repeat(right, sizes)]).reshape(-1, dimension)


class Nearest:
    """Nearest entries of one part's codebook."""

    def __init__(self, codebook: np.ndarray, memo_cells: int = MEMO_CELLS):
        self.codebook, self.memo_cells = codebook, memo_cells
        spread = int(codebook.std(axis=0).mean()) if len(codebook) else 0
        self.width = 1 << max(0, (spread // CELLS_PER_SPREAD).bit_length() - 1)
        self.memo: dict[bytes, np.ndarray] = {}
        self.evaluated = 0

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """The entries of each cell that no other entry dominates across its box."""
        tables = []  # by component: of each coarse place that occurs, the squared least and largest distances to every entry
        for k in range(cells.shape[1]):
            places, which = np.unique(cells[:, k], return_inverse=True)
            below = places[:, None] * self.width - self.codebook[None, :, k]  # how far the box begins above the entry
            above = -below - (self.width - 1)  # how far it ends below
            tables.append((which, np.maximum(np.maximum(below, above), 0) ** 2, np.maximum(np.abs(below), np.abs(above)) ** 2))
        small = sum(int(far.max()) for _, _, far in tables) < 1 << 31
        nearest, farthest = np.zeros((2, len(cells), len(self.codebook)), np.int32 if small else np.int64)
        for which, near, far in tables:
            nearest += near.astype(nearest.dtype)[which]
            farthest += far.astype(nearest.dtype)[which]
        kept = nearest <= farthest.min(axis=1)[:, None]
        return np.split(np.nonzero(kept)[1].astype(np.int32), np.cumsum(kept.sum(axis=1))[:-1])

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each vector's nearest entry, the lower one of equally near ones, and the squared distance."""
        if not len(vectors):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cells = np.ascontiguousarray(vectors // self.width)
        keys = cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        first, which = np.unique(keys, return_index=True, return_inverse=True)[1:]
        names = [keys[i].tobytes() for i in first]
        lists = [self.memo.get(name) for name in names]
        new = [i for i, found in enumerate(lists) if found is None]
        if len(self.memo) + len(new) > self.memo_cells:
            self.memo.clear()
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            for i, found in zip(part, self.candidates(cells[first[part]]), strict=True):
                lists[i] = found
                if len(self.memo) < self.memo_cells:
                    self.memo[names[i]] = found
        sizes = np.array([len(x) for x in lists])
        flat, starts = np.concatenate(lists), np.cumsum(sizes) - sizes
        best, error = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
        per = max(1, (1 << 20) // (int(sizes.max()) * vectors.shape[1]))  # vectors that are evaluated at a time
        for at in range(0, len(vectors), per):
            mine, their = vectors[at : at + per], which[at : at + per]
            n = sizes[their]
            ends = np.cumsum(n)
            begins = ends - n
            entry = flat[np.arange(ends[-1]) - np.repeat(begins - starts[their], n)]
            distance = ((np.repeat(mine, n, axis=0) - self.codebook[entry]) ** 2).sum(axis=1)
            least = np.minimum.reduceat(distance, begins)
            error[at : at + per] = least
            best[at : at + per] = np.minimum.reduceat(np.where(distance == np.repeat(least, n), entry, len(self.codebook)), begins)
            self.evaluated += int(ends[-1])
        return best, error


def _first_entries(rows: DataFrame, entries: int) -> tuple[int, np.ndarray]:
    """The dimension, and the vectors of the smallest ids as whole numbers."""
    head = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    dimension = len(head[0].vector) if head else 0
    first = rows.where(F.size("vector") == dimension).orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    return dimension, whole_numbers(np.array([r.vector for r in first], np.float64).reshape(len(first), dimension))


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, Codebooks]:
    """The dimension of (id, vector) and its codebooks: a pass over the rows for each round."""
    dimension, first = _first_entries(rows, entries)
    if not dimension or dimension % parts:
        return dimension, []
    width = dimension // parts
    books = [first[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        held = books  # what the tasks of this round get

        def summed(batches: Iterator[pa.RecordBatch], held: Codebooks = held) -> Iterator[pa.RecordBatch]:
            near = [Nearest(book) for book in held]
            sums = np.zeros((parts, len(held[0]), width), np.int64)
            counts = np.zeros((parts, len(held[0])), np.int64)
            for batch in pieces(batches):
                vectors = of_dimension(batch.column("vector"), dimension)[1]
                for p in range(parts):
                    mine = vectors[:, p * width : (p + 1) * width]
                    entry = near[p](mine)[0]
                    order = np.argsort(entry, kind="stable")
                    used, begins, n = np.unique(entry[order], return_index=True, return_counts=True)
                    if len(used):
                        sums[p, used] += np.add.reduceat(mine[order], begins, axis=0)
                        counts[p, used] += n
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_pydict({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": counts[part, entry], "total": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))})

        found = rows.select("vector").mapInArrow(summed, "part int, entry int, n long, total array<long>")
        found = found.select("part", "entry", "n", F.posexplode("total").alias("k", "total")).groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = [book.copy() for book in books]
        for r in found.toLocalIterator():
            books[r.part][r.entry, r.k] = r.total // r.n
    return dimension, books


def codebook_text(books: Codebooks) -> str:
    """All components by part, entry and position."""
    return ",".join(str(x) for book in books for x in book.ravel())


def codebook_sha256(books: Codebooks) -> str:
    return hashlib.sha256(codebook_text(books).encode()).hexdigest()


def encoded(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """All columns of df's kept rows with `code` (two hexadecimal digits a part) and `error` (squared distances summed over parts), and the codebooks."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits a part: at most 256 entries")
    names = others(df, ("code", "error"))
    kept = df.where(usable(col(vector)))
    dimension, books = trained(kept.select(col(key).alias("id"), col(vector).alias("vector")), parts, entries, rounds)
    width = dimension // parts

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Nearest(book) for book in books]
        for batch in pieces(batches):
            right, vectors = of_dimension(batch.column("vector"), dimension)
            codes, errors = np.full(len(right), None, object), np.full(len(right), None, object)
            if books:
                found = [near[p](vectors[:, p * width : (p + 1) * width]) for p in range(parts)]
                codes[right] = ["".join(f"{i:02x}" for i in row) for row in zip(*(entry for entry, _ in found), strict=True)]
                errors[right] = sum(error for _, error in found).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["row", "code", "error"])

    held = kept.select(whole_row(df).alias("row"), col(vector).alias("vector"))
    schema = T.StructType([held.schema["row"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    out = held.mapInArrow(coded, schema)
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), "code", "error"), books


def with_label_error(df: DataFrame, label: str = "label", error: str = "error", out: str = "label_error") -> DataFrame:
    """Adds the error summed over equal labels; null labels are one. A sum beyond 2^63 is null.

    Sums are pre-aggregated; few labels are broadcast, of many only those with a large share of the rows. df is read several times.
    """
    names, name = others(df, (out,)), free_name(df, "_label")
    rows = df.select(F.coalesce(F.concat(F.lit("="), col(label).cast("string")), F.lit("")).alias(name), *(col(c) for c in df.columns))
    totals = written(rows.groupBy(name).agg(F.try_sum(col(error)).alias("_total"), F.count(F.lit(1)).alias("_rows")), "label-errors")
    held = rows.select(name, whole_row(df).alias("row"))
    joined = held.join(F.broadcast(totals), name) if totals.count() <= BROADCAST_ROWS else spread_join(held, totals, name, "_rows")
    return joined.select(*(F.col("row").getField(c).alias(c) for c in names), F.col("_total").alias(out))
