"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

A rule bounds a ratio of two measures of the text, by whole numbers of thousandths, so that no rounding decides. The measures of a
text are one struct: lengths, symbols, capitals, stop words, lines and repeated windows of words. What a measure needs several times (words, windows,
lines) is bound to a lambda's variable, so that it is made once a row and the whole is a single expression without user functions or shuffles.

Cases: a null text counts as empty; an empty text has all measures 0 and fails the rule on words; a ratio with nothing below the line
passes; long texts take n log n steps, and only those with a repeated window are sorted; rows with null ids and repeated rows are measured
like others; an empty table gives no rows; other columns are passed through, but input columns with an output's name are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, others

# The symbols that are counted, and white space.
SYMBOLS = "#*$%&|<>"
_SPACE = r"[\x20\x09-\x0D]+"
#: A stop word may have one of these marks behind it.
MARKS = ".,;:!?)\"'"
#: Words that prose in each language can't do without.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "this", "are", "at", "from"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "eine", "ein", "als"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "dans", "qui", "par", "au", "sur", "pas", "avec"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "las", "del", "un", "por", "con", "no", "una", "su", "para", "al", "es", "lo"),
}
#: Words of a window that may repeat.
WINDOW = 5


class Rule(NamedTuple):
    """The measure `part` over the measure `whole` (None: the number 1) lies from `low` to `high` thousandths (None: no bound).

    Texts of fewer than `words` words pass: a ratio over few words says little.
    """

    name: str
    part: str
    whole: str | None
    low: int | None
    high: int | None
    words: int = 0


#: What every text must pass.
BASE_RULES = (
    Rule("words", "n_words", None, 10_000, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 200),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 14_000),
    Rule("symbols", "n_symbols", "n_words", None, 300),
    Rule("capitals", "n_capitals", "word_chars", None, 400),
    Rule("stop_words", "n_stop_words", "n_words", 20, None, 30),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 500),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window that stands in the text twice or more."""

    def covered(starts: Column) -> Column:
        """Of sorted starts of windows: each adds the words up to the next start, a whole window at most."""
        added = F.transform(starts, lambda at, i: F.least(F.lit(window).cast("long"), (F.get(starts, i + 1) - at).cast("long")))
        return F.aggregate(added, F.lit(0).cast("long"), lambda total, n: total + n)

    def same_as(pairs: Column, pair: Column, i: Column) -> Column:
        return F.coalesce(F.get(pairs, i)["window"] == pair["window"], F.lit(False))

    def from_pairs(pairs: Column) -> Column:
        """Of (window, start), sorted: equal windows are neighbours."""
        twice = F.filter(pairs, lambda pair, i: same_as(pairs, pair, i + 1) | ((i > 0) & same_as(pairs, pair, F.greatest(i - 1, F.lit(0)))))
        return _bound(F.sort_array(F.transform(twice, lambda pair: pair["start"])), covered)

    def from_windows(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("window"), i.alias("start"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_bound(pairs, from_pairs))

    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    windows = F.transform(starts, lambda i: F.array_join(F.slice(words, i, window), " "))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(_bound(windows, from_windows))


def measures(text: Column, stop_words: Sequence[str]) -> Column:
    """A struct of MEASURES, all long."""

    listed = [w + mark for w in stop_words for mark in ("", *MARKS)]

    def of(text: Column) -> Column:
        def kept(characters: str) -> Column:
            """How many characters of the text are of this class."""
            return F.char_length(F.regexp_replace(text, f"[^{characters}]+", ""))

        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        by_lines = _bound(lines, lambda v: F.struct(F.size(v).alias("n_lines"), (F.size(v) - F.size(F.array_distinct(v))).alias("n_dup_lines")))
        by_words = _bound(_words(text), lambda v: F.struct(F.size(v).alias("n_words"), F.char_length(F.array_join(v, "")).alias("word_chars"), repeated_words(v).alias("n_repeat_words")))
        n_stop_words = F.size(F.filter(F.split(F.lower(text), _SPACE), lambda w: w.isin(*listed)))
        by_text = F.struct(kept(re.escape(SYMBOLS)).alias("n_symbols"), kept(r"\p{Lu}").alias("n_capitals"), n_stop_words.alias("n_stop_words"))
        found = F.struct(by_text.alias("text"), by_lines.alias("lines"), by_words.alias("words"))
        held = {"n_symbols": "text", "n_capitals": "text", "n_stop_words": "text", "n_lines": "lines", "n_dup_lines": "lines", "n_words": "words", "word_chars": "words", "n_repeat_words": "words"}
        return _bound(found, lambda s: F.struct(*(s[held[m]][m].cast("long").alias(m) for m in MEASURES)))

    return _bound(F.coalesce(text.cast("string"), F.lit("")), of)


def passes(rule: Rule, measured: Column) -> Column:
    """Whether the measures keep within the rule's bounds: whole numbers on both sides."""
    part, whole = measured[rule.part] * 1000, F.lit(1).cast("long") if rule.whole is None else measured[rule.whole]
    kept = F.lit(True)
    if rule.low is not None:
        kept &= part >= whole * rule.low
    if rule.high is not None:
        kept &= part <= whole * rule.high
    if rule.whole is not None:
        kept |= whole == 0
    return kept | (measured["n_words"] < rule.words) if rule.words else kept


def judged(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES, stop_words: Sequence[str] | None = None) -> DataFrame:
    """All columns of df, then the measures, `failed` (names of the rules that the text breaks), `base_failed` and `kept`."""
    listed = stop_words or sorted({w for words in STOP_WORDS.values() for w in words})
    outputs = (*MEASURES, "failed", "base_failed", "kept")

    def verdict(measured: Column) -> Column:
        broken = F.filter(F.array(*(F.when(~passes(rule, measured), F.lit(rule.name)) for rule in (*base, *rules))), lambda name: name.isNotNull())
        base_failed = F.lit(False)
        for rule in base:
            base_failed |= ~passes(rule, measured)
        return F.struct(*(measured[m].alias(m) for m in MEASURES), broken.alias("failed"), base_failed.alias("base_failed"), (F.size(broken) == 0).alias("kept"))

    whole = _bound(measures(col(text), listed), verdict)
    names = others(df, outputs)
    held = df.select(F.struct(*(col(c) for c in names)).alias("row") if names else F.lit(None).alias("row"), whole.alias("made"))
    return held.select(*(F.col("row").getField(c).alias(c) for c in names), *(F.col("made").getField(c).alias(c) for c in outputs))
