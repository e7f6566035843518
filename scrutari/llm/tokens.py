"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of letters, digits and combining marks of the
lower-cased text; in scripts that don't part words by spaces every character is
a word of its own. Everything is done on code points of the whole batch, so the
cost per character is a handful of vectorised passes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: Scripts without spaces between words, and what else words are made of; the same for RE2's regular expressions.
SINGLE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
WORD = rf"[{SINGLE}]|(?:[^\P{{L}}{SINGLE}]|[^\P{{N}}{SINGLE}]|[^\P{{M}}{SINGLE}])+"
#: Characters whose lower case depends on context or is more than one character, mapped first.
_FIRST = (("İ", "i"), ("Σ", "σ"))


def lower(text: str | None) -> str:
    """A text in lower case, character by character; a null is empty."""
    text = text or ""
    for a, b in _FIRST:
        text = text.replace(a, b)
    return text.lower()


def words_sql(text: str) -> str:
    """The words of a text, in DuckDB's SQL."""
    for a, b in _FIRST:
        text = f"replace({text}, '{a}', '{b}')"
    return f"regexp_extract_all(lower({text}), '{WORD}')"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point what it is (1 part of a word, 2 a word), and its value in hashes."""
    kind = np.zeros(0x110000, np.uint8)
    # Nothing is assigned between, but for private use and surrogates.
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x33500), *range(0xE0100, 0xE01F0)]))
    for k, pattern in ((1, r"[\p{L}\p{N}\p{M}]"), (2, f"[{SINGLE}]")):
        kind[[ord(c) for c in regex.findall(pattern, chars)]] = k
    return kind, mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    hashes: np.ndarray  # uint64 by word
    doc: np.ndarray  # offsets into hashes by text, one more than there are texts
    start: np.ndarray  # of each word in the joined, lower-cased code points
    end: np.ndarray
    sums: np.ndarray  # prefix sums, for the hashes of parts of words
    points: np.ndarray  # the code points
    single: np.ndarray  # by word, whether it is a character of a script without spaces

    def prefix(self, length: int) -> np.ndarray:
        """Hashes of the first ``length`` characters; those of the whole word where it is shorter."""
        return self._between(self.start, np.minimum(self.start + length, self.end))

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * _power(len(self.sums))[1][a])


def words(texts: list[str | None]) -> Words:
    """Words of all texts; a null has none."""
    kinds, value = _tables()
    plain = [lower(t) for t in texts]
    joined = " ".join(plain) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[cp]
    run, own = kind == 1, kind == 2
    begin, stop = run.copy(), run.copy()
    begin[1:] &= ~run[:-1]
    stop[:-1] &= ~run[1:]
    start, end = np.flatnonzero(begin | own), np.flatnonzero(stop | own) + 1
    n = len(cp)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value[cp] * _power(n + 1)[0][:n], out=sums[1:])
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in plain], out=at[1:])
    w = Words(np.empty(0, np.uint64), np.searchsorted(start, at), start, end, sums, cp, own[start])
    w.hashes = w._between(start, end)
    return w


def pieces(texts: list[str], most: int = 1_500_000) -> list[list[str]]:
    """Texts in successive lists of about ``most`` characters, for what needs memory by character."""
    out: list[list[str]] = []
    size = most
    for t in texts:
        if size >= most:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t or "")
    return out
