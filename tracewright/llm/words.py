"""Hashes of all words of many texts at once, by numpy: no Python object is made per word."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Texts are hashed in windows of about so many bytes; a longer word widens its window.
WINDOW = 1 << 19

_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every input bit (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of words: sums of byte values times powers of an odd number, shifted to the word's start and mixed.

    Words are runs of bytes other than separators (white space, and ASCII punctuation too if `punctuation`), with A-Z
    lower-cased. `prefixes` gives hashes of the first k bytes as well. After each call with `check`, `checks` holds 32 bits more of every word: a
    hash of its bytes whatever their order, so that of two words with the same 64 bits only ones of the same letters can share both.
    """

    def __init__(self, punctuation: bool = False):
        self.separator = np.zeros(256, bool)
        self.separator[list(SPACES + (PUNCTUATION if punctuation else b""))] = True
        lower = np.arange(256, dtype=np.uint64)
        lower[65:91] += np.uint64(32)
        self.value = mixed((lower + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
        self.letter = mixed((lower + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.checks = np.zeros(0, np.uint32)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            steps = np.full(n, _R, np.uint64)
            back = np.full(n, pow(_R, -1, 1 << 64), np.uint64)
            steps[0] = back[0] = 1
            self.powers, self.inverses = np.multiply.accumulate(steps), np.multiply.accumulate(back)

    def _checks(self, data: np.ndarray) -> np.ndarray:
        """The checks of the words of data, which ends with a separator."""
        sep = self.separator[data]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if len(data) and not sep[0]:
            edge = np.concatenate([[0], edge])
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letter[data], out=sums[1:])
        return (mixed(sums[edge[1::2]] - sums[edge[0::2]]) >> np.uint64(32)).astype(np.uint32)

    def _window(self, data: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Starts, hashes and prefix hashes of the words of data, which ends with a separator."""
        self._grow(len(data) + 1)
        sep = self.separator[data]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if len(data) and not sep[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.powers[: len(data)], out=sums[1:])
        hashed = lambda upto: mixed((sums[upto] - sums[starts]) * self.inverses[starts] + (upto - starts).astype(np.uint64))
        return starts, hashed(ends), [hashed(np.minimum(starts + k, ends)) for k in prefixes]

    def windows(self, texts: list[bytes]) -> Iterable[tuple[int, int, bytes]]:
        """Groups (first text, one past the last, joined bytes); a long text comes in several groups, cut between words."""
        first, held, size = 0, [], 0
        for i, t in enumerate(texts):
            if held and size + len(t) > WINDOW:
                yield first, i, b" ".join(held)
                first, held, size = i, [], 0
            if len(t) <= WINDOW:
                held.append(t)
                size += len(t) + 1
                continue
            data, at = np.frombuffer(t, np.uint8), 0
            while len(t) - at > WINDOW:
                stop = at + WINDOW
                while stop < len(t) and not len(gap := np.flatnonzero(self.separator[data[stop : stop + WINDOW]])):
                    stop += WINDOW
                stop = min(len(t), stop + int(gap[0])) if stop < len(t) else len(t)
                yield i, i + 1, t[at:stop]
                at = stop
            yield i, i + 1, t[at:]
            first, held, size = i + 1, [], 0
        yield first, len(texts), b" ".join(held)

    def hash(self, texts: list[bytes], prefixes: tuple[int, ...] = (), check: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Hashes of the words of all texts in order, the number of words of each text, and hashes of prefixes."""
        counts = np.zeros(len(texts), np.int64)
        hashes, fronts, checks = [], [[] for _ in prefixes], [np.zeros(0, np.uint32)]
        for first, last, joined in self.windows(texts):
            starts, words, heads = self._window(np.frombuffer(joined + b" ", np.uint8), prefixes)
            if last - first == 1:
                counts[first] += len(words)
            elif last > first:
                bounds = np.cumsum([len(t) + 1 for t in texts[first:last]])
                counts[first:last] += np.diff(np.searchsorted(starts, bounds, "left"), prepend=0)
            hashes.append(words)
            if check:
                checks.append(self._checks(np.frombuffer(joined + b" ", np.uint8)))
            for kept, new in zip(fronts, heads, strict=True):
                kept.append(new)
        self.checks = np.concatenate(checks)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return join(hashes), counts, [join(x) for x in fronts]


def chained(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words in order."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15)) ^ words[k : len(words) - n + 1 + k]
    return mixed(out)
