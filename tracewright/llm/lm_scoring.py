"""Language-model scores of texts by a weighted backoff automaton.

States are the learned n-grams of fewer than ORDER words, from the empty one up. A state h has an arc for each word w that was seen after it, of weight
log10((c(h,w) + m(h) P(w|h')) / (c(h) + m(h))), where h' is h without its oldest word and m(h) = STRENGTH * c(h)**SPREAD is the mass that h leaves to it;
for any other word its failure arc leads to h', at log10(m(h) / (c(h) + m(h))). One traversal from left to right carries the state and adds up weights. The
empty state gives every known word (c + 1) / (N + V + 1), and 1 / (N + V + 1) to all unknown words together, so that each state's probabilities add up to 1.

Neither the model nor the texts pass through the driver or are broadcast. Texts are packed in parts of about PART_BYTES, a table bucketed by part, so that no
text is shuffled. Each part sends its distinct n-grams, as sorted hashes, to buckets of the hash; a bucket sums the training counts over all parts and
sends each part the totals of just the n-grams that it sent, in the same order. Words go first, and come back with N, V and whether other parts have them too. A
longer n-gram with a word that no other part has is in no other part either: its count is known where it is, and it isn't sent. From the
totals the part builds the piece of the automaton that its texts walk through. Buckets grow in number, not in size, with the corpus; how many of them a partition holds grows too, so that
no corpus asks for more partitions than Spark allows. A part sends a row to each bucket that it has n-grams for: never more rows than n-grams.

Words are told apart by 80 bits, and buckets and parts split words whose first 64 agree: counts of words are exact. Longer n-grams have 56 bits; of
10**12 distinct ones about one in 70,000 shares its count with another.

Cases: a null text counts as empty, and an empty text is the end token alone; nothing to learn from leaves one unknown
word, of probability 1; repeated rows and null ids are rows like others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, col, pieces, written
from .words import WordHasher, mixed

ORDER, STRENGTH, SPREAD = 3, 3.0, 0.85
PART_BYTES = 6_000_000
#: N-grams that a bucket gets, about.
BUCKET_GRAMS = 1_000_000
#: Buckets of the table of parts, and partitions of a shuffle, at most: beyond so many each holds several parts, or several buckets of n-grams that are summed one after the other.
MOST_BUCKETS = 1 << 15
BEGIN, END = np.uint64(0x5DEECE66D), np.uint64(0xB5026F5AA96619E9)

#: Long texts are walked in pieces of so many tokens, each after reading the few tokens before it that its state depends on.
PIECE = 512
#: Bits of a longer n-gram's hash that aren't kept.
LOW = np.uint64(0xFF)

_PART = "part long, ids binary, flags binary, sizes binary, texts binary, n_bytes long"
_SENT = "bucket long, part long, size int, grams binary, checks binary, counts binary, n long"
_TOTAL = "part long, bucket long, size int, totals binary, n long, tokens long, kinds long"
_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def pack(x: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed: small ones and those with few values take little."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpack(data: bytes, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) to parts; a part never mixes rows of two tasks."""
    task, number = TaskContext.get().partitionId(), 0
    ids, flags, texts, size = [], [], [], 0

    def flush() -> pa.RecordBatch:
        joined = b"".join(texts)
        row = {"part": (task << 24) + number, "ids": np.array([i or 0 for i in ids], np.int64).tobytes(), "flags": np.array([f + 2 * (i is None) for i, f in zip(ids, flags, strict=True)], np.uint8).tobytes(), "sizes": np.array([len(t) for t in texts], np.int64).tobytes(), "texts": pa.compress(joined, codec="zstd", asbytes=True) if joined else b"", "n_bytes": len(joined)}
        return pa.RecordBatch.from_pylist([row], schema=_arrow(_PART))

    for batch in batches:
        for i, held, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            t = t or b""
            if texts and size + len(t) > PART_BYTES:
                yield flush()
                number += 1
                ids, flags, texts, size = [], [], [], 0
            ids.append(i)
            flags.append(int(held))
            texts.append(t)
            size += len(t)
    if texts:
        yield flush()


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def numbered(keys: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of one of each distinct (key, check) in order of the keys, the number of every row's, and how many rows each has.

    Checks are looked at only to see whether they agree for a key, which is the rule; where they don't, the pairs are sorted.
    """
    found, first, number, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    if checks is not None and (checks[first][number] != checks).any():
        pairs = np.stack([keys, checks.astype(np.uint64)], axis=1)
        found, first, number, n = np.unique(pairs, axis=0, return_index=True, return_inverse=True, return_counts=True)
    return first, number.ravel(), n


class Part:
    """The texts of a part as tokens between begin and end, and its distinct n-grams of each size."""

    def __init__(self, row: dict):
        self.ids, flags, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["flags"], np.uint8), np.frombuffer(row["sizes"], np.int64)
        self.held, self.no_id = (flags & 1) > 0, (flags & 2) > 0
        joined = pa.decompress(row["texts"], row["n_bytes"], codec="zstd", asbytes=True) if row["n_bytes"] else b""
        ends = np.cumsum(sizes)
        hasher = WordHasher()
        words, counts, _ = hasher.hash([joined[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], check=True)
        n = len(counts)
        self.lengths = counts + 2  # with begin and end
        self.last = np.cumsum(self.lengths) - 1
        self.first = self.last - self.lengths + 1
        self.tokens, self.checks = np.empty(len(words) + 2 * n, np.uint64), np.zeros(len(words) + 2 * n, np.uint16)
        inside = np.ones(len(self.tokens), bool)
        inside[self.first] = inside[self.last] = False
        self.tokens[inside], self.tokens[self.first], self.tokens[self.last] = words, BEGIN, END
        self.checks[inside] = hasher.checks >> np.uint32(16)
        self.owner = np.repeat(np.arange(n), self.lengths)
        self.offset = np.arange(len(self.tokens)) - self.first[self.owner]

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The places where n-grams of that size end, and the n-grams' hashes."""
        at = np.flatnonzero(self.offset >= size - 1)
        running = self.tokens
        for _ in range(size - 1):
            before = np.concatenate([np.zeros(1, np.uint64), running[:-1]])
            running = mixed(before * np.uint64(0x9E3779B97F4A7C15)) ^ self.tokens
        return at, mixed(running[at] + np.uint64(size)) & ~LOW

    def distinct(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places where n-grams end, the number of each place's n-gram in order of their hashes, and one place of each n-gram."""
        at, grams = self.grams(size)
        first, number, _ = numbered(grams)
        return at, number, at[first]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words' sorted hashes, their checks, their counts in training texts, and every place's number among them."""
        first, number, _ = numbered(self.tokens, self.checks)
        return self.tokens[first], self.checks[first], np.bincount(number[~self.held[self.owner]], minlength=len(first)).astype(np.uint32), number

    def counted(self, size: int, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct n-grams' sorted hashes, their counts in training texts, and whether other parts may have them. alone: places whose word no other part has."""
        at, grams = self.grams(size)
        before = np.concatenate([[0], np.cumsum(alone)])
        marks = (~self.held[self.owner[at]]).astype(np.uint64) | (before[at + 1] == before[at + 1 - size]).astype(np.uint64) << np.uint64(1)
        grams |= marks  # in bits that the hash leaves free
        grams.sort()
        start = np.flatnonzero(np.concatenate([[True], (grams[1:] ^ grams[:-1]) > LOW])) if len(grams) else np.zeros(0, np.int64)
        counts = np.add.reduceat(grams & np.uint64(1), start) if len(start) else np.zeros(0)
        shared = np.maximum.reduceat(grams & np.uint64(2), start) > 0 if len(start) else np.zeros(0, bool)
        return grams[start] & ~LOW, counts.astype(np.uint32), shared


def _rows(part: int, size: int, bits: int, found: np.ndarray, checks: np.ndarray, counts: np.ndarray) -> list[dict]:
    """Rows of a part's sorted hashes, cut by their first bits."""
    bucket = (found >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(found), np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return [
        {"bucket": int(bucket[a]), "part": part, "size": size, "grams": pack(np.diff(found[a:b], prepend=np.uint64(0))), "checks": pack(checks[a:b]), "counts": pack(counts[a:b]), "n": b - a}
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(found)], strict=True)
        if b > a
    ]


def _send_words(bits: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(_rows(row["part"], 1, bits, *Part(row).words()[:3]), schema=_arrow(_SENT))

    return each


def _received(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals of a part's n-grams of a size in order, and whether other parts have them."""
    rows = sorted((r for r in table.to_pylist() if r["size"] == size), key=lambda r: r["bucket"])
    both = np.concatenate([np.zeros(0, np.uint64), *(unpack(r["totals"], np.uint64, r["n"]) for r in rows)])
    return both >> np.uint64(1), (both & np.uint64(1)) > 0


def _send_grams(order: int, bits: int):
    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            part = Part(row)
            alone = ~_received(right, 1)[1][part.words()[3]]
            for size in range(2, order + 1):
                found, counts, shared = part.counted(size, alone)
                out.append(pa.Table.from_pylist(_rows(row["part"], size, bits, found[shared], np.zeros(0, np.uint16), counts[shared]), schema=_arrow(_SENT)))
        return pa.concat_tables(out) if out else _arrow(_SENT).empty_table()

    return each


def _sum(table: pa.Table) -> pa.Table:
    """All rows of a bucket: totals of every n-gram over all parts, and for each part those of its own; of words also their kinds and tokens."""
    out = []
    for size in sorted(set(table.column("size").to_pylist())):
        rows = table.filter(pc.equal(table.column("size"), size)).to_pylist()
        grams = np.concatenate([np.cumsum(unpack(r["grams"], np.uint64, r["n"])) for r in rows])
        checks = np.concatenate([unpack(r["checks"], np.uint16, r["n"]) for r in rows]) if size == 1 else None
        first, number, n = numbered(grams, checks)
        totals = np.bincount(number, np.concatenate([unpack(r["counts"], np.uint32, r["n"]) for r in rows]), len(first)).astype(np.uint64)
        word = grams[first] != BEGIN if size == 1 else np.zeros(len(first), bool)
        both, at = totals << np.uint64(1) | (n > 1).astype(np.uint64), 0
        for i, r in enumerate(rows):
            out.append({"part": r["part"], "bucket": r["bucket"], "size": size, "totals": pack(both[number[at : at + r["n"]]]), "n": r["n"], "tokens": 0 if i else int(totals[word].sum()), "kinds": 0 if i else int((totals[word] > 0).sum())})
            at += r["n"]
    return pa.Table.from_pylist(out, schema=_arrow(_TOTAL))


class BackoffAutomaton:
    """The states and arcs that the texts of one part use.

    State 0 is the empty n-gram; it has an arc for every word. The arcs of the others are sorted by (state, word).
    """

    def __init__(self, part: Part, totals: dict[int, np.ndarray], tokens: int, kinds: int, order: int, strength: float = STRENGTH, spread: float = SPREAD):
        self.order = order
        self.kept, self.failure, self.below = [np.zeros(1)], [np.zeros(1)], [np.zeros(1, np.int64)]  # by state: count, weight and end of the failure arc
        self.word = part.words()[3]
        self.count = totals[1].astype(float)
        self.lowest = np.log10((self.count + 1) / (tokens + kinds + 1))
        self.words = len(self.count)
        keys, weights, ends = [], [], []
        states, weight = 1, self.lowest[self.word]  # by place: the weight of the arc of the n-gram that is one word shorter
        history = None  # by place: the state of the n-gram of `size` - 1 words that ends there, or -1
        for size in range(1, order + 1):
            at, number, one = part.distinct(size) if size > 1 else (np.arange(len(part.tokens)), self.word, None)
            count = totals[size].astype(float)
            learned = count > 0
            if size > 1:  # what is learned has learned parts, unless hashes were equal
                learned &= (history[one - 1] >= 0) & (history[one] >= 0)
            state = np.full(len(count), -1)
            if size < order:
                state[learned] = states + np.arange(int(learned.sum()))
                states += int(learned.sum())
            here = np.full(len(part.tokens), -1)
            here[at] = state[number]
            if size == 1:
                self.root_to = np.maximum(state, 0)
                below = np.zeros(int(learned.sum()), np.int64)
            else:
                one = one[learned]
                source = history[one - 1]
                mass = strength * self.kept_of(source) ** spread
                step = np.log10((count[learned] + mass * 10 ** weight[one]) / (self.kept_of(source) + mass))
                keys.append(source * self.words + self.word[one])
                weights.append(step)
                below = history[one]
                ends.append(state[learned] if size < order else below)
                by_gram = np.zeros(len(count))
                by_gram[learned] = step
                weight = np.zeros(len(part.tokens))
                weight[at] = by_gram[number]
            if size < order:
                mass = strength * count[learned] ** spread
                self.kept.append(count[learned])
                self.failure.append(np.log10(mass / (count[learned] + mass)))
                self.below.append(below)
                self._all = np.concatenate(self.kept)
            history = here
        self.failure, self.below = np.concatenate(self.failure), np.concatenate(self.below)
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        sort = np.argsort(key, kind="stable")
        self.key, self.weight, self.end = np.append(key[sort], -1), np.append((np.concatenate(weights) if weights else np.zeros(0))[sort], 0.0), np.append((np.concatenate(ends) if ends else np.zeros(0, np.int64))[sort], 0)

    def kept_of(self, state: np.ndarray) -> np.ndarray:
        return self._all[state]

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each state's next state and the weight of the way there: an arc, or failure arcs until a state has one."""
        weight, out, left, at = np.zeros(len(state)), np.zeros(len(state), np.int64), np.arange(len(state)), state
        while len(left):
            key = at * self.words + word[left]
            place = np.searchsorted(self.key[:-1], key)
            arc, root = (self.key[place] == key) & (at > 0), at == 0
            weight[left[arc]] += self.weight[place[arc]]
            out[left[arc]] = self.end[place[arc]]
            weight[left[root]] += self.lowest[word[left[root]]]
            out[left[root]] = self.root_to[word[left[root]]]
            rest = ~(arc | root)
            weight[left[rest]] += self.failure[at[rest]]
            left, at = left[rest], self.below[at[rest]]
        return out, weight

    def walk(self, part: Part) -> np.ndarray:
        """The weight of the step to every token but the begins. Texts are walked side by side, each from left to right, long ones in pieces."""
        n = -(-(part.lengths - 1) // PIECE)
        text = np.repeat(np.arange(len(n)), n)
        start = part.first[text] + 1 + PIECE * (np.arange(len(text)) - (np.cumsum(n) - n)[text])
        stop = np.minimum(start + PIECE, part.last[text] + 1)
        at = np.maximum(start - max(1, self.order - 1), part.first[text])
        sort = np.argsort(at - stop, kind="stable")
        at, start, stop = at[sort], start[sort], stop[sort]
        out, state = np.zeros(len(part.tokens)), np.zeros(len(at), np.int64)
        while len(at):
            state, weight = self.read(state, self.word[at])
            counts = at >= start
            out[at[counts]] = weight[counts]
            at = at + 1
            going = at < stop
            at, start, stop, state = at[going], start[going], stop[going], state[going]
        return out


def scores(part: Part, totals: dict[int, np.ndarray], tokens: int, kinds: int, order: int, strength: float = STRENGTH, spread: float = SPREAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, known tokens, score of the empty state alone, and score of each text."""
    automaton = BackoffAutomaton(part, totals, tokens, kinds, order, strength, spread)
    step, real, n = automaton.walk(part), part.offset > 0, len(part.lengths)
    total = lambda x: np.bincount(part.owner[real], x[real], n)
    return part.lengths - 1, total((automaton.count[automaton.word] > 0).astype(float)).astype(np.int64), total(automaton.lowest[automaton.word]), total(step)


def scored(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows that aren't held out are learned from."""
    rows = docs.select(col(key).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = bucketed(rows.mapInArrow(_parts, _PART), "lm_parts", "part", min(MOST_BUCKETS, 1 << int(np.ceil(np.log2(max(1, size / PART_BYTES))))))

    def bits(grams: float) -> int:
        # how many n-grams there are is guessed, a word taking about six bytes: no result depends on it
        return max(0, int(np.ceil(np.log2(max(1, grams / BUCKET_GRAMS)))))

    def summed(sent: DataFrame, bits: int) -> DataFrame:
        return sent.repartition(min(MOST_BUCKETS, 1 << bits), "bucket").groupBy("bucket").applyInArrow(_sum, _TOTAL)

    few, many = bits(size / 24), bits(size / 6 * (order - 1))
    words = written(summed(parts.mapInArrow(_send_words(few), _SENT), few), "lm-words")
    tokens, kinds = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    by_part = words.groupBy("part")
    totals = words.unionByName(summed(parts.groupBy("part").cogroup(by_part).applyInArrow(_send_grams(order, many), _SENT), many)) if order > 1 else words

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            part = Part(row)
            counts = {1: _received(right, 1)[0]}
            alone = ~_received(right, 1)[1][part.words()[3]]
            for n in range(2, order + 1):
                _, own, shared = part.counted(n, alone)
                counts[n] = own.astype(np.uint64)
                counts[n][shared] = _received(right, n)[0]
            n, known, base, score = scores(part, counts, tokens, kinds, order)
            ids = pa.array(part.ids, mask=part.no_id)
            out.append(pa.table([ids, pa.array(part.held), pa.array(n), pa.array(known), pa.array(base), pa.array(score)], schema=_arrow(_SCORE)))
        return pa.concat_tables(out) if out else _arrow(_SCORE).empty_table()

    return parts.groupBy("part").cogroup(totals.groupBy("part")).applyInArrow(score, _SCORE).withColumn("train_tokens", F.lit(tokens).cast("long"))
