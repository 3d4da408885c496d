"""Personal data in texts: exact patterns, and candidates that boosted trees accept.

Base spans follow fixed patterns. Beside them, high-recall generators propose spans of the same kinds in looser forms
(addresses spelled out, numbers without their plus sign, with other separators, or defanged), and of secrets (keys and tokens: long runs of
letters and digits); spans may overlap. Boosted trees judge each by its format and its context, and one above the threshold of its
kind is accepted, the likeliest first, if it overlaps nothing accepted before. Base spans always stay.

What the trees learn from is labelled by rules, over all documents: a base span written in a looser form where it stands is a positive, the same
with wrong digits or words a negative, and so is what the generators propose beside base spans. A secret is a positive where it is
assigned to a name that tells (token = "...") and else a negative. The trees are fitted on at most FIT_ROWS of these labelled rows of each
label, the ones with the smallest hashes; half of the hashes never enter a fit, and all rows of that half set the thresholds: the least
score at which PRECISION is reached.

Cases: a null text counts as empty; positions are code points, ends exclusive; repeated rows and null ids are rows like
others; a kind without labelled rows gets no added spans; an empty table gives no rows; an input column called like the output is replaced by it.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import col, others, pieces, written

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4  # the kinds with fixed patterns come first
FIT_ROWS, PRECISION = 6000, 0.95
#: Scores are counted in so many steps to set the thresholds.
STEPS = 1000
#: Characters of context before and after a span.
BEFORE, AFTER = 60, 40
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _valid(kind: int, text: str) -> bool:
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    d = _digits(text)
    return (13 <= len(d) <= 19 and luhn(d)) if kind == 2 else 9 <= len(d) <= 15


def base_spans(text: str) -> list[Span]:
    """Per kind, leftmost matches that don't overlap; each pattern is searched in time linear in the text."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            parts = m[0].split(".")
            pos = m.start()
            for i in range(0, len(parts) - 3, 4):
                found = ".".join(parts[i : i + 4])
                if _valid(1, found):
                    out.append((1, pos, pos + len(found)))
                pos += len(found) + 1
        out += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _valid(2, m[0])]
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if _valid(3, m[0])]
    return out


_DOT = r"(?: ?[\[({<] ?dot ?[\])}>] ?| dot |\.)"
_SPELLED = (
    (0, re.compile(rf"(?<![\w.%+-])[\w.%+-]{{1,64}} ?[\[({{<] ?at ?[\])}}>] ?[\w-]{{1,64}}(?:{_DOT}[\w-]{{1,64}})+", re.I)),
    (0, re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} at [\w-]{1,64}(?:(?: ?[\[({<] ?dot ?[\])}>] ?| dot )[\w-]{1,64})+", re.I)),
)
_SPACED = ((0, re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} ?@ ?[\w-]{1,64}(?: ?\. ?[\w-]{1,64})+")),)
_NUMBERS = (
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?: ?[\[({](?:\.|dot)[\])}] ?| \. ?| dot )[0-9]{1,3}){3}(?![0-9])", re.I)),
    (2, re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9])")),
    (3, re.compile(r"(?<![\w+.])(?:00[0-9]{1,3}[ .-]?|[0-9]{1,2}[ .-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ ./-]{1,2}[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![\w])")),
)
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z0-9_+/=-]{16})[A-Za-z0-9_+/-]++=*+(?![A-Za-z0-9_+/=-])")
_TELLTALES = ("dot", "(at", "[at", "{at", "<at", "( at", "[ at", "{ at")
#: What stands before a value that is surely a secret.
_ASSIGNED = re.compile(r"(?:api[ _-]?key|secret|token|passw(?:or)?d|pwd|access[ _-]?key|private[ _-]?key|bearer|auth\w*)[\"']?\s*(?:[:=]|=>|\bis\b)\s*[\"']?$", re.I)
# Words that often stand before personal data, and before numbers that are none.
_TELLING = re.compile(r"\b(?:e-?mail|key|token|secret|password|passwd|pwd|bearer|mail|contact|write|reach|tel|telephone|phone|mobile|call|fax|cell|card|visa|mastercard|credit|ip|host|server|address)\b", re.I)
_OTHER = re.compile(r"\b(?:order|invoice|id|no|number|ref|version|page|isbn|issn|date|total|price|sum|serial|sku|vol|chapter)\b|[#$€£]", re.I)


def candidates(text: str) -> list[Span]:
    """Spans of looser forms and secrets; those of one or several kinds may overlap."""
    patterns = [*(_NUMBERS if _DIGIT.search(text) else ()), *(_SPACED if "@" in text else ())]
    low = text.lower()
    if any(x in low for x in _TELLTALES):
        patterns += _SPELLED
    found = {(kind, *m.span()) for kind, pattern in patterns for m in pattern.finditer(text)}
    found |= {(4, *m.span()) for m in _SECRET.finditer(text) if _DIGIT.search(m[0]) and any(c.isalpha() for c in m[0])}
    return sorted(found)


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a span, as numbers."""
    kind, start, end = span
    s, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    chars = Counter(s)
    return [
        *(float(kind == k) for k in range(len(KINDS))), len(s), len(d), len(d) / max(1, len(s)), len(groups), min(sizes), max(sizes), sizes[0], sizes[-1],
        s.count(" "), s.count("-"), s.count("."), s.count("("), s.count("/") + s.count("_"), float("@" in s), float(bool(re.search(r"[\[({<]", s))), sum(c.isalpha() for c in s),
        float(luhn(d)) if len(d) > 1 else 0.0, float(len(groups) == 4 and max(sizes) <= 3 and all(int(g) <= 255 for g in groups)), float(len(re.split(r"(?i)\bdot\b|\.", s)[-1].strip(" )]}>")) in (2, 3, 4)),
        float(bool(_TELLING.search(before))), float(bool(_OTHER.search(before[-16:]))), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(bool(re.match(r"[ .,/-]?[0-9]", after))), float(bool(re.search(r"[0-9][ .,/-]?$", before))),
        len(set(d)), float(d[:1] in ("0", "1")), float(len(set(sizes)) == 1), sum(c in "0123456789abcdefABCDEF" for c in s) / max(1, len(s)), sum(c.isupper() for c in s) / max(1, len(s)),
        -sum(n / len(s) * math.log2(n / len(s)) for n in chars.values()), float(before[-1:] in ("'", '"')), float(bool(re.search(r"[:=]\s*[\"']?$", before))),
    ]


def disguised(kind: int, s: str, turn: int) -> str:
    """A base span written as one of the looser forms."""
    if kind == 0:
        name, _, host = s.partition("@")
        at = (" at ", " (at) ", " [at] ", " @ ")[turn % 4]
        return name + at + (host if turn % 4 == 3 else host.replace(".", (" dot ", " (dot) ", " [dot] ")[turn % 3]))
    if kind == 1:
        return s.replace(".", ("[.]", " . ", "(.)")[turn % 3])
    if kind == 2:
        d = _digits(s)
        return (".", "_", "/", "  ")[turn % 4].join(d[i : i + 4] for i in range(0, len(d), 4))
    return s[1:].strip() if turn % 2 else re.sub(r"^[0-9]{1,3} ", "", s[1:].strip())


def broken(kind: int, s: str, turn: int) -> str:
    """The same form with digits that can't be right, or words around the signs of an address that make none."""
    if kind == 0:
        return re.sub(r"[A-Za-z0-9-]+$", ("everything", "afterwards", "7", "something")[turn % 4], s)
    if kind == 3:
        return re.sub(r"[0-9]", lambda m: "0", s) if turn % 2 else s.replace(" ", "").replace("-", "/")
    digits = [i for i, c in enumerate(s) if "0" <= c <= "9"]
    for i in digits[:: 3 if kind == 1 else len(digits)]:
        s = s[:i] + str((int(s[i]) + 5 + turn % 4) % 10) + s[i + 1 :]
    return re.sub(r"[0-9]+", "999", s, count=1) if kind == 1 else s


class Spans:
    """Disjoint spans in order: whether another overlaps one of them takes a search, not a pass."""

    def __init__(self, spans: list[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, span: Span) -> bool:
        at = bisect.bisect_left(self.starts, span[2])
        return at > 0 and self.ends[at - 1] > span[1]

    def add(self, span: Span) -> None:
        at = bisect.bisect_left(self.starts, span[1])
        self.starts.insert(at, span[1])
        self.ends.insert(at, span[2])


def examples(text: str) -> Iterator[tuple[int, int, int, list[float]]]:
    """Labelled rows of a text: kind, label, a number that tells rows of a text apart, and features."""
    base = base_spans(text)
    taken = Spans(base)
    for n, span in enumerate(candidates(text)):
        if not taken.overlaps(span):
            yield span[0], int(span[0] == 4 and bool(_ASSIGNED.search(text[max(0, span[1] - 40) : span[1]]))), 3 * n, describe(text, span)
    for n, (kind, a, b) in enumerate(base):
        turn = int.from_bytes(hashlib.blake2b(text[a:b].encode(), digest_size=2).digest(), "little")
        loose = disguised(kind, text[a:b], turn)
        for label, s in ((1, loose), (0, broken(kind, loose, turn))):
            lead = text[max(0, a - BEFORE) : a]
            made = lead + s + text[b : b + AFTER]
            for span in candidates(made):
                if span[0] == kind and span[1] < len(lead) + len(s) and len(lead) < span[2]:
                    whole = abs(span[1] - len(lead)) <= 1 and abs(span[2] - len(lead) - len(s)) <= 1
                    yield kind, label * whole, 3 * n + 1 + label, describe(made, span)


class Judge:
    """Boosted trees and a threshold for each kind."""

    def __init__(self, trees: BoostedTrees | None = None, thresholds: list[float] | None = None):
        self.trees, self.thresholds = trees, thresholds or [math.inf] * len(KINDS)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """The base spans, and all spans, by kind and start."""
        base = base_spans(text)
        found, taken = list(base), Spans(base)
        new = [] if self.trees is None else [c for c in candidates(text) if not taken.overlaps(c)]
        if new:
            scores = self.trees.predict(np.array([describe(text, c) for c in new]))
            added = Spans()
            for score, c in sorted(zip((-scores).tolist(), new, strict=True)):
                if -score >= self.thresholds[c[0]] and not added.overlaps(c):
                    added.add(c)
                    found.append(c)
        return sorted(base), sorted(found)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_ROW = "kind int, label int, h long, x array<float>"


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """The labelled rows of all documents (kind, label, h, x); h is a hash of the text and the row's place in it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            kinds, labels, hashes, xs = [], [], [], []
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                t = raw.decode(errors="replace") if raw else ""
                digest = hashlib.blake2b(raw or b"", digest_size=16).digest()
                for kind, label, place, x in examples(t):
                    kinds.append(kind)
                    labels.append(label)
                    hashes.append(int.from_bytes(hashlib.blake2b(digest + place.to_bytes(8, "little"), digest_size=8).digest(), "little") >> 1)
                    xs.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(labels, pa.int32()), pa.array(hashes, pa.int64()), pa.array(xs, pa.list_(pa.float32()))], names=["kind", "label", "h", "x"])

    return docs.select(col(text).cast("string").alias("text")).mapInArrow(each, _ROW)


def fit(docs: DataFrame, text: str = "text") -> Judge:
    """Trees from a bounded number of labelled rows of one half of the hashes; thresholds from all rows of the other half."""
    rows = written(labelled(docs, text), "pii-labelled")
    learn = [r for label in (0, 1) for r in rows.where(f"label = {label} AND h % 2 = 0").orderBy("h", "kind", "x").limit(FIT_ROWS).collect()]
    x, y = np.array([r.x for r in learn]), np.array([float(r.label) for r in learn])
    if min(y.sum(), (1 - y).sum()) < 5:
        return Judge()
    trees = BoostedTrees().fit(x, y)
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.minimum((held.value.predict(np.array(batch.column(2).to_pylist())) * STEPS).astype(np.int32), STEPS - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at)], names=["kind", "label", "step"])

    counts = np.zeros((len(KINDS), STEPS, 2))
    for r in rows.where("h % 2 = 1").select("kind", "label", "x").mapInArrow(steps, "kind int, label int, step int").groupBy("kind", "label", "step").count().collect():
        counts[r.kind, r.step, r.label] = r["count"]
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows of at least that score
    thresholds = []
    for right, wrong in ((above[k, :, 1], above[k, :, 0]) for k in range(len(KINDS))):
        ok = np.flatnonzero((right >= PRECISION * (right + wrong)) & (right > 0))
        thresholds.append(max(0.5, ok[0] / STEPS) if len(ok) and right[0] >= 5 else math.inf)
    return Judge(trees, thresholds)


def found(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """All columns of docs, then a struct: counts of base spans by kind and of all spans, base_sha256, spans and the redacted text."""
    names, held = others(docs, (out,)), docs.sparkSession.sparkContext.broadcast(fit(docs, text))
    kind = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,n_spans:bigint,base_sha256:string,spans:string,redacted:string>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge: Judge = held.value
        for batch in pieces(batches):
            rows = []
            for raw in batch.column(batch.num_columns - 2).cast(pa.binary()).to_pylist():
                t = raw.decode(errors="replace") if raw else ""
                base, spans = judge.spans(t)
                counts = Counter(s[0] for s in base)
                rows.append({**{f"n_{KINDS[k]}": counts[k] for k in range(BASE)}, "n_spans": len(spans), "base_sha256": hashlib.sha256(listed(base).encode()).hexdigest(), "spans": listed(spans), "redacted": redacted(t, spans) if spans else t})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, batch.schema.field(batch.num_columns - 1).type)], schema=batch.schema)

    inner = docs.select(*(col(c).alias(f"c{i}") for i, c in enumerate(names)), col(text).cast("string").alias("text"), F.lit(None).cast(kind).alias("pii"))
    return inner.mapInArrow(each, inner.schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("pii").alias(out))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span's kind in its place; of overlapping spans the one that starts first goes."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
