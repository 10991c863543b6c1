"""Words, white space and word hashes, as SQL expressions and as NumPy code over whole Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space and code points 9 to 13.
SPACES = " \t\n\x0b\f\r"

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random odd 64-bit number for each byte value, and powers of an odd multiplier for positions in a word.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0xD1342543DE82EF95, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_or_empty(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def word_array(c: Column) -> Column:
    """Words between runs of ASCII white space; an empty array if there are none."""
    trimmed = F.btrim(c, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\t-\r ]+"))


def count_words(c: Column) -> Column:
    """The number of words, without building them."""
    return F.regexp_count(c, F.lit(r"[^\t-\r ]+")).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the words are of many texts that lie end to end in ``data``.

    ``bounds`` has the texts' byte offsets (one more than there are texts). Returns the words' first bytes, the bytes
    that are in words, each of these bytes' word, and, per text, the index of its first word (again one more). Texts
    never share a word, even where no white space parts them.
    """
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = bounds[1:-1]
    cut = cut[cut < len(data)]
    begins[cut] |= inside[cut]
    starts = np.flatnonzero(begins)
    letters = np.flatnonzero(inside)
    return starts, letters, np.cumsum(begins)[letters] - 1, np.searchsorted(starts, bounds)


def run_hashes(letters: np.ndarray, firsts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes that lie end to end, from where each begins and how long it is."""
    at = np.arange(len(letters)) - np.repeat(firsts, length)
    value = _BYTE[letters]
    longest = int(length.max())
    value *= (_POWERS if longest <= len(_POWERS) else _powers(longest))[at]  # words of thousands of bytes are rare
    return mix64(np.add.reduceat(value, firsts) + length.astype(np.uint64) * _GOLD)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, with A-Z as a-z, and, per text, the index of its first word (again one more)."""
    starts, letters, _, first = word_spans(data, bounds)
    if len(starts) == 0:
        return np.empty(0, np.uint64), first
    firsts = np.searchsorted(letters, starts)
    return run_hashes(_LOWER[data[letters]], firsts, np.diff(np.append(firsts, len(letters)))), first


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``n``-word shingles, end to end, and the sets' offsets.

    A text of fewer than ``n`` words has its whole word sequence as its one shingle; one without words has none.
    """
    words, first = word_hashes(data, bounds)
    counts = np.diff(first)
    n_texts = len(counts)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(n_texts), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = first[:-1][owner] + offset
    length = np.minimum(counts, n)[owner]
    h = np.zeros(len(owner), np.uint64)
    for k in range(n):
        take = length > k
        h[take] = mix64(h[take] * np.uint64(0xA0761D6478BD642F) + words[start[take] + k] + _GOLD)
    h ^= length.astype(np.uint64)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(n_texts + 1))


def utf8_batches(column, limit: int = 2_000_000):
    """Cuts an Arrow string column into runs of about ``limit`` bytes: (first row, bytes, offsets) each; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, data[offsets[at] : offsets[to]], (offsets[at : to + 1] - offsets[at])
        at = to
