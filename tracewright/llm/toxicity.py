"""Toxicity of texts that may be disguised: a noisy channel restores them, a linear model scores what is restored.

Characters that stand for letters, letters set apart by separators, and letters repeated are a lattice of what may
have been meant. Viterbi decoding finds the path that a character language model finds likeliest; only what could be
read in more than one way is decoded. The restored text's words and word beginnings are the features of a logistic
model with an L1 penalty.

Model, language model and threshold are fitted on all labelled rows, each distinct text once and whole: words, features and scores are counted by Spark, the weights come from its logistic regression. What the models hold is
bounded, not what they are counted over: the MOST_WORDS most frequent words and the MOST_FEATURES most telling features. Scoring covers every whole text, and words of any length.

Cases: a null text counts as empty, and an empty text gets the score of a text without any feature; without labels of
both kinds every score is 0; a null id hashes as empty; of contradicting labels of an id toxic wins; repeated rows are
scored each; an empty table gives no rows; an input column called like the output is replaced by it.
"""

from __future__ import annotations

import functools
import math
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, others, pieces, written
from .words import WordHasher

MOST_FEATURES, MOST_WORDS = 3000, 50_000
PREFIXES = (4, 5, 6)
#: The language model learns words that the texts have so often, and the scorer features of so many toxic texts.
LEAST_COUNT = 2
THRESHOLD = 0.7
#: Of texts, how much is looked through for disguises at once.
SUSPECT_BYTES = 1 << 20
#: Bits for each key of a broadcast filter, and of a filter in all (32 MB).
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28

# The letters that a character may stand for.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
SEPARATORS = " .-_*"

_STANDS = re.compile("[" + re.escape("".join(STANDS_FOR)) + "]")
_LETTER = r"[^\W\d_]"
_SPACED = re.compile(rf"(?<![\w])(?:{_LETTER}|[0134578@$!|])(?:[ .\-_*](?:{_LETTER}|[0134578@$!|])){{3,}}(?![\w])")
_REPEATED = re.compile(rf"({_LETTER})\1\1")
_ADDRESS = re.compile(r"@[\w-]+\.|://|=")
_EDGES = ".,;:?\"'()[]{}<>%&#*~^`-_/\\"


class CharacterModel:
    """Interpolated character n-grams of words between boundaries (Witten-Bell), as log10 probabilities."""

    ORDER, EDGE = 5, " "

    def __init__(self, words: Counter):
        self.counts: dict[str, int] = defaultdict(int)
        self.totals: dict[str, list[int]] = {}
        for word, n in words.items():
            chars = self.EDGE * (self.ORDER - 1) + word + self.EDGE
            for i in range(self.ORDER - 1, len(chars)):
                for k in range(self.ORDER):
                    total = self.totals.setdefault(chars[i - k : i], [0, 0])
                    total[0] += n
                    total[1] += chars[i - k : i + 1] not in self.counts
                    self.counts[chars[i - k : i + 1]] += n
        self.known: dict[tuple[str, str], float] = {}

    def p(self, context: str, c: str) -> float:
        if (key := (context, c)) in self.known:
            return self.known[key]
        lower = self.p(context[1:], c) if context else 1 / 500
        n, kinds = self.totals.get(context, (0, 0))
        if len(self.known) > 500_000:
            self.known.clear()
        out = self.known[key] = (self.counts.get(context + c, 0) + kinds * lower) / (n + kinds) if n else lower
        return out

    def decode(self, lattice: list[list[tuple[str, float]]], split: bool) -> str:
        """Viterbi: the likeliest string; lattice: for each place, strings and what they cost; split: words may end anywhere."""
        width = self.ORDER - 1
        best: dict[str, tuple[float, tuple | None]] = {self.EDGE * width: (0.0, None)}  # by state: log10 probability, and the way there as (way before, string)
        for options in lattice:
            new: dict[str, tuple[float, tuple | None]] = {}
            for state, (score, way) in best.items():
                for chars, cost in options:
                    for lead in ("", self.EDGE) if split and way and chars else ("",):
                        at, total = state, score - cost
                        for c in lead + chars:
                            total += math.log10(self.p(at, c))
                            at = (at + c)[-width:]
                        if lead:
                            at = (self.EDGE * width + chars)[-width:]
                        if at not in new or total > new[at][0]:
                            new[at] = (total, (way, lead + chars))
            best = new
        ends = [(score + math.log10(self.p(state, self.EDGE)), way) for state, (score, way) in best.items()]
        top = max(score for score, _ in ends)
        return max(self._read(way) for score, way in ends if score == top)

    @staticmethod
    def _read(way: tuple | None) -> str:
        out = []
        while way:
            way, text = way
            out.append(text)
        return "".join(reversed(out))


class Restorer:
    """Replaces what is disguised in a lower-case text by what the language model takes it for."""

    def __init__(self, model: CharacterModel):
        self.model, self.known = model, {}

    def _word(self, word: str, split: bool) -> str:
        if (word, split) in self.known:
            return self.known[word, split]
        lattice: list[list[tuple[str, float]]] = []
        for run in re.finditer(r"(.)\1*", word):
            c, n = run[1], len(run[0])
            letters = STANDS_FOR.get(c, c)
            cost = math.log10(len(letters))
            once = [(x, cost) for x in letters]
            lattice.append(once if n == 1 else [*((x, cost + 0.7 * (n > 2) + 0.7 * (n == 2)) for x in letters), *((x * 2, cost + 0.7 * (n > 2)) for x in letters)])
        out = self.model.decode(lattice, split)
        if len(self.known) < 200_000 and len(word) <= 100:
            self.known[word, split] = out
        return out

    def _token(self, token: str) -> str:
        core = token.strip(_EDGES)
        if len(core) < 3 or _ADDRESS.search(core):
            return token
        core = core.rstrip("!+|") or core
        once = re.sub(r"(.)\1+", r"\1", core)  # a letter drawn out hides no more than one
        disguised = _STANDS.search(core) and sum(c.isalpha() for c in once) * 5 >= len(once) * 2
        if not (disguised or _REPEATED.search(core)) or core.isdigit() or not all(c.isalpha() or c in STANDS_FOR for c in core):
            return token
        return token.replace(core, self._word(core, False), 1)

    def __call__(self, text: str) -> str:
        text = _SPACED.sub(lambda m: self._word(re.sub(r"[ .\-_*]", "", m[0]), True), text)
        return re.sub(r"\S+", lambda m: self._token(m[0]), text)


@functools.cache
def _kinds() -> np.ndarray:
    """What each code point may be, as bits: 1 letter, 2 stands for one, 4 or 8 does so at a core's end or start too, 16 one of a spaced run, 32 sets letters apart."""
    kinds = np.array([c.isalnum() and not c.isdecimal() for c in map(chr, range(sys.maxunicode + 1))], np.uint8) * 17
    for c in STANDS_FOR:
        kinds[ord(c)] |= 2 | 4 * (c not in _EDGES + "!+|") | 8 * (c not in _EDGES) | 16 * (c in "0134578@$!|")
    for c in SEPARATORS:
        kinds[ord(c)] |= 32
    return kinds


def _suspects(texts: list[bytes]) -> np.ndarray:
    """Which texts may hold what the restorer changes: a stand-in beside a letter, a letter three times over, or four letters set apart.

    Judged on the lower-case characters that the restorer gets, about SUSPECT_BYTES at a time. Some that it leaves alone are among them, none that it changes is missed.
    """
    out, sizes = np.zeros(len(texts), bool), np.cumsum([len(t) for t in texts])
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes // SUSPECT_BYTES)) + 1):
        lowered = [texts[i].decode(errors="replace").lower() for i in part]
        data = np.frombuffer(("\n".join(["\n", *lowered]) + "\n" * 8).encode("utf-32-le"), np.uint32)
        starts = 2 + np.cumsum([0, *(len(t) + 1 for t in lowered)])[:-1]
        k, n = _kinds()[data], len(data) - 7
        letter, stands = (k & 1) > 0, (k & 2) > 0
        either = letter | stands
        after = letter[:n] & stands[1 : n + 1] & (((k[1 : n + 1] & 4) > 0) | either[2 : n + 2])
        before = stands[1 : n + 1] & letter[2 : n + 2] & (((k[1 : n + 1] & 8) > 0) | either[:n])
        three = letter[:n] & (data[:n] == data[1 : n + 1]) & (data[:n] == data[2 : n + 2])
        one, apart = (k & 16) > 0, (k & 32) > 0
        spaced = one[:n] & apart[1 : n + 1] & one[2 : n + 2] & apart[3 : n + 3] & one[4 : n + 4] & apart[5 : n + 5] & one[6 : n + 6]
        at = np.concatenate([np.flatnonzero(after | three | spaced), np.flatnonzero(before) + 1])
        out[part[np.unique(np.searchsorted(starts, at, "right") - 1)]] = True
    return out


def restored(texts: list[bytes], restorer: Restorer | None) -> list[bytes]:
    if restorer is None or not texts:
        return texts
    return [restorer(t.decode(errors="replace").lower()).encode() if s else t for t, s in zip(texts, _suspects(texts), strict=True)]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashed features: words and word beginnings."""
    words, counts, heads = WordHasher(punctuation=True).hash(texts, PREFIXES)
    rows = np.repeat(np.arange(len(texts)), counts)
    salted = [words] + [h ^ np.uint64(0x9E37 * (i + 1)) for i, h in enumerate(heads)]
    return np.tile(rows, len(salted)), np.concatenate(salted)


class Scorer:
    """A logistic model over sorted feature hashes; a text has a feature or doesn't, however often."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[keys >> np.uint64(44)] = True

    def _pairs(self, rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of row and feature number."""
        some = np.flatnonzero(self.maybe[found >> np.uint64(44)])
        rows, found = rows[some], found[some]
        at = np.searchsorted(self.keys, found).clip(0, max(0, len(self.keys) - 1))
        ok = self.keys[at] == found if len(found) else np.zeros(0, bool)
        pairs = np.unique(rows[ok] * max(1, len(self.keys)) + at[ok])
        return pairs // max(1, len(self.keys)), pairs % max(1, len(self.keys))

    def _logits(self, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(rows, self.weights[at], n) if len(rows) else np.full(n, self.bias)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        x = self._logits(*self._pairs(*features(texts)), len(texts)) if len(self.keys) else np.full(len(texts), self.bias)
        return np.where(np.isneginf(x), 0.0, 1 / (1 + np.exp(-np.clip(x, -700, 700))))


def _maybe_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows that may have a key of `wanted` (distinct keys, a written table): all that do, and about one in FILTER_BITS of the others.

    Bits of the keys' hashes are broadcast, FILTER_BITS a key at most and MOST_FILTER_BITS in all, so that rows without a key needn't be shuffled to find that out.
    """
    bits = min(MOST_FILTER_BITS, 1 << (FILTER_BITS * max(1, wanted.count()) - 1).bit_length())
    place = F.pmod(F.xxhash64(key), F.lit(bits).cast("long"))
    bucket, at = F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place)
    table = wanted.groupBy(bucket).agg(F.bitmap_construct_agg(at).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1
    return rows.withColumn("_bucket", bucket).withColumn("_at", at).join(F.broadcast(table), "_bucket").withColumn("_byte", byte).where(hit).select(*rows.columns)


def _labelled(docs: DataFrame, labels: DataFrame, chosen: Column, key: str, text: str) -> DataFrame:
    """text, toxic and half (0 or 1, by the text's hash) of every distinct text that has a label. Labels find digests first; then only texts that may have one of these are shuffled, once."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & chosen).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IN (0, 1)")
    texts = docs.select(col(key).alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    marked = written(texts.select("doc_id", "digest").join(marks, "doc_id").groupBy("digest").agg(F.max("toxic").cast("int").alias("toxic")), "marked")
    rows = _maybe_in(texts.select("digest", "text"), marked, "digest").groupBy("digest").agg(F.min("text").alias("text")).join(marked, "digest")
    return written(rows.select("text", "toxic", F.conv(F.substring(F.hex("digest"), 64, 1), 16, 10).cast("int").bitwiseAND(1).alias("half")), "labelled")


def _frequent_words(rows: DataFrame) -> Counter:
    """The MOST_WORDS most frequent words of the texts, of at least LEAST_COUNT, with their counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})
            found.clear()
            return out

        for batch in pieces(batches):
            for t in batch.column(0).to_pylist():
                found.update(re.findall(rf"{_LETTER}{{2,}}", t.lower()))
            if len(found) > 200_000:
                yield counted()
        yield counted()

    words = rows.select("text").mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return Counter({r["word"]: r["n"] for r in words.orderBy(F.desc("n"), "word").limit(MOST_WORDS).collect()})


def _counted(rows: DataFrame) -> DataFrame:
    """feature, and c0 to c3: how many texts of each kind (2 * half + toxic) have it; features of at least LEAST_COUNT toxic texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            kinds = batch.column(1).to_numpy() + 2 * batch.column(2).to_numpy()
            at, found = features(batch.column(0).cast(pa.binary()).to_pylist())
            order = np.lexsort((at, found))
            at, found = at[order], found[order]
            first = np.ones(len(at), bool)
            first[1:] = (found[1:] != found[:-1]) | (at[1:] != at[:-1])
            names, where = np.unique(found[first], return_inverse=True)
            table = np.bincount(where * 4 + kinds[at[first]], minlength=4 * len(names)).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *(pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in table.T)], names=["feature", "c0", "c1", "c2", "c3"])

    counts = rows.mapInArrow(each, "feature long, c0 long, c1 long, c2 long, c3 long").groupBy("feature").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(4)))
    return written(counts.where(F.col("c1") + F.col("c3") >= LEAST_COUNT), "features")


def _telling(counts: DataFrame, clean: Column, toxic: Column, neg: int, pos: int) -> np.ndarray:
    """The MOST_FEATURES most telling features, sorted."""
    telling = F.abs(F.log((toxic + 0.5) / (pos + 1)) - F.log((clean + 0.5) / (neg + 1))) * F.sqrt(toxic)
    found = counts.where(toxic >= LEAST_COUNT).orderBy(F.desc(telling), "feature").select("feature").limit(MOST_FEATURES).collect()
    return np.sort(np.array([r["feature"] for r in found], np.int64).view(np.uint64))


def _hits(rows: DataFrame, keys: np.ndarray) -> DataFrame:
    """hits (numbers in keys, each once), toxic and half of every text."""
    held = rows.sparkSession.sparkContext.broadcast(Scorer(keys, np.zeros(len(keys)), 0.0))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at, number = held.value._pairs(*features(batch.column(0).cast(pa.binary()).to_pylist()))
            ends = np.cumsum([0, *np.bincount(at.astype(np.int64), minlength=batch.num_rows)])
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(number.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([hits, batch.column(1), batch.column(2)], names=["hits", "toxic", "half"])

    return written(rows.mapInArrow(each, "hits array<int>, toxic int, half int"), "hits")


def _weighted(hits: DataFrame, keys: np.ndarray, mine: np.ndarray, penalty: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights by number in keys, 0 for all but `mine`, and the bias: a logistic model with an L1 penalty, fitted by Spark."""
    place = np.full(len(keys), -1)
    place[np.searchsorted(keys, mine)] = np.arange(len(mine))

    @F.udf(VectorUDT())
    def vector(numbers: list[int]):
        at = place[numbers]
        at = at[at >= 0]  # hits ascend, and places with them
        return Vectors.sparse(len(mine), at, np.ones(len(at)))

    rows = hits.select(vector("hits").alias("features"), F.col("toxic").cast("double").alias("label"))
    model = LogisticRegression(regParam=penalty, elasticNetParam=1.0, standardization=False, family="binomial", maxIter=50, tol=1e-5).fit(rows)
    weights = np.zeros(len(keys))
    weights[place >= 0] = model.coefficients.toArray()[place[place >= 0]]
    return weights, float(model.intercept)


def _cut(hits: DataFrame, models: list[tuple[np.ndarray, float]]) -> float:
    """The logit that parts the kinds best (by F1), as models[half] sees the rows of that half. Logits are counted by thousandths."""
    weights, bias = np.stack([w for w, _ in models]), np.array([b for _, b in models])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, sizes = batch.column(2).to_numpy(), pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(batch.num_rows), sizes)
            x = bias[half] + np.bincount(at, weights[half[at], batch.column(0).flatten().to_numpy()], batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(x * 1000).astype(np.int64)), batch.column(1)], names=["logit", "toxic"])

    bins = hits.mapInArrow(each, "logit long, toxic int").groupBy("logit").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).orderBy("logit").collect()
    logit, n, k = (np.array([r[c] for r in bins], float) for c in ("logit", "n", "k"))
    if len(logit) < 2:
        return 0.0
    right, above = k.sum() - np.cumsum(k)[:-1], n.sum() - np.cumsum(n)[:-1]
    f1 = 2 * right / (above + k.sum())
    best, cuts = np.flatnonzero(f1 == f1.max()), (logit[1:] + logit[:-1]) / 2000
    return float(cuts[best[0]] + cuts[best[-1]]) / 2


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, chosen: Column | None = None, key: str = "doc_id", text: str = "text") -> tuple[Restorer, Scorer]:
    """Restorer and scorer of all labelled texts. The scorer is shifted so that THRESHOLD lies midway between the kinds, as each half's model sees the other half."""
    texts = _labelled(docs, labels, F.lit(True) if chosen is None else chosen, key, text)
    restorer = Restorer(CharacterModel(_frequent_words(texts)))
    sizes = {(r["half"], r["toxic"]): r["count"] for r in texts.groupBy("half", "toxic").count().collect()}
    neg, pos = (np.array([sizes.get((h, x), 0) for h in (0, 1)]) for x in (0, 1))
    if not neg.sum() or not pos.sum():
        return restorer, Scorer(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    held = texts.sparkSession.sparkContext.broadcast(restorer)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(restored(batch.column(0).cast(pa.binary()).to_pylist(), held.value)).cast(pa.string()), *batch.columns[1:]], schema=batch.schema)

    rows = written(texts.mapInArrow(each, texts.schema), "restored")
    counts, c = _counted(rows), [F.col(f"c{k}") for k in range(4)]
    whole = _telling(counts, c[0] + c[2], c[1] + c[3], int(neg.sum()), int(pos.sum()))
    if not len(whole):
        return restorer, Scorer(whole, np.zeros(0), math.log(pos.sum() / neg.sum()))
    # of each half, what the model of the other half's texts takes
    taken = [_telling(counts, c[2 - 2 * h], c[3 - 2 * h], int(neg[1 - h]), int(pos[1 - h])) if neg[1 - h] and pos[1 - h] else whole[:0] for h in (0, 1)]
    keys = np.unique(np.concatenate([whole, *taken]))
    hits = _hits(rows, keys)
    weights, bias = _weighted(hits, keys, whole)
    if all(len(x) for x in taken):
        models = [_weighted(hits.where(F.col("half") != h), keys, taken[h]) for h in (0, 1)]
        if all(w.any() for w, _ in models):
            bias += math.log(THRESHOLD / (1 - THRESHOLD)) - _cut(hits, models)
    return restorer, Scorer(keys[weights != 0], weights[weights != 0], bias)


def scored(docs: DataFrame, labels: DataFrame, chosen: Column | None = None, key: str = "doc_id", text: str = "text", out: str = "toxicity") -> DataFrame:
    """All columns of docs, then the toxicity (0 to 1). chosen: which rows of the labels may be learned from."""
    names, held = others(docs, (out,)), docs.sparkSession.sparkContext.broadcast(fit(docs, labels, chosen, key, text))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, scorer = held.value
        for batch in pieces(batches):
            texts = [t or b"" for t in batch.column(batch.num_columns - 2).cast(pa.binary()).to_pylist()]
            scores = pa.array(scorer(restored(texts, restorer)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], schema=batch.schema)

    inner = docs.select(*(col(c).alias(f"c{i}") for i, c in enumerate(names)), col(text).cast("string").alias("text"), F.lit(0.0).alias("score"))
    return inner.mapInArrow(each, inner.schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("score").alias(out))
