"""Words of whole Arrow batches, found and hashed with numpy.

Texts stay one buffer of UTF-8 bytes. All separators are ASCII, so words are found byte by byte
without decoding. A word is known by a 64-bit hash of its bytes; two different words share one
with a probability of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C13  # odd, and 3 modulo 4
_MASK = (1 << 64) - 1


def byte_class(*ranges: tuple[int, int], inverse: bool = False) -> np.ndarray:
    """Which of the 256 byte values lie in ``ranges`` (ends included)."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return ~table if inverse else table


#: Words between white space: [^\x20\x09-\x0D]+
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D), inverse=True)
#: Words of letters and digits: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F), inverse=True)
#: What stands between single spaces
UNSPACED = byte_class((0x20, 0x20), inverse=True)


@dataclass
class Texts:
    """Rows ``first`` to ``last`` of a batch: their bytes, and where each row's bytes begin."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, row: int) -> str:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().decode("utf-8", "replace")


@dataclass
class Words:
    """``bounds[d]`` to ``bounds[d + 1]`` are the words of row ``d``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Runs of rows of at most ``limit`` bytes, a longer row by itself; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield Texts(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def find_words(texts: Texts, word_bytes: np.ndarray) -> Words:
    """Maximal runs of ``word_bytes`` inside each row."""
    data, offsets = texts.data, texts.offsets
    inside = word_bytes[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


#: White space beyond ASCII, as UTF-8 bytes read as one number.
_WIDE_SPACE = np.array(
    [0xC285, 0xC2A0, 0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080], np.int64
)


def cut_before(texts: Texts, opening: np.ndarray) -> Words:
    """Words that cover each row, cut before every ``opening`` byte that follows no white space.

    With ASCII white space as ``opening``, a word is a run of white space and what stands up to the next one.
    Byte-level tokenizers never join across such a cut, nor do they look beyond it.
    """
    data, offsets = texts.data, texts.offsets
    at = np.flatnonzero(opening[data])
    at = at[at > 0]
    before = data[at - 1]
    keep = SPACED[before]
    wide = np.flatnonzero(before >= 0x80)
    if len(wide):
        last = data[at[wide] - 1].astype(np.int64)
        second = data[at[wide] - 2].astype(np.int64)
        third = data[np.maximum(at[wide] - 3, 0)].astype(np.int64)
        two, three = second << 8 | last, third << 16 | second << 8 | last
        keep[wide] = ~(np.isin(two, _WIDE_SPACE) | np.isin(three, _WIDE_SPACE))
    begins = np.zeros(len(data) + 1, bool)
    begins[at[keep]] = True
    begins[offsets[:-1]] = True  # of an empty last row: the end, which is no start
    starts = np.flatnonzero(begins[:-1])
    ends = np.append(starts[1:], len(data))[: len(starts)]
    return Words(starts, ends, np.searchsorted(starts, offsets))


def word_texts(texts: Texts, words: Words) -> pa.Array:
    """The words of ``cut_before`` as an Arrow array; no word is copied one by one."""
    offsets = np.append(words.starts, len(texts.data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(words.starts), pa.py_buffer(offsets), pa.py_buffer(texts.data))


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``flat[s : s + n]`` of every (s, n), one after another; in blocks, so that places take little room."""
    ends = np.cumsum(counts, dtype=np.int64)
    shifts = starts - ends + counts
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    i, begin = 0, 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, begin + _BLOCK, "right")))
        end = int(ends[j - 1])
        if j == i + 1:  # maybe longer than a block
            out[begin:end] = flat[begin + int(shifts[i]) : end + int(shifts[i])]
        else:
            out[begin:end] = flat[np.arange(begin, end) + np.repeat(shifts[i:j], counts[i:j])]
        i, begin = j, end
    return out


def _byte_values(lower: bool) -> np.ndarray:
    table = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    table = table ^ (table >> np.uint64(31))
    if lower:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, _BLOCK) + 1
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > 4 * _BLOCK:  # an overlong word; its tables are not kept
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


def word_hashes(texts: Texts, words: Words, lower: bool) -> np.ndarray:
    """A 64-bit hash of every word; ``lower`` takes A-Z as a-z."""
    out = np.empty(len(words.starts), np.uint64)
    values, i, n = _VALUES[lower], 0, len(out)
    while i < n:
        begin = words.starts[i]
        j = max(i + 1, int(np.searchsorted(words.ends, begin + _BLOCK, "right")))
        piece = texts.data[begin : words.ends[j - 1]]
        powers, inverse = _power_tables(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * powers[: len(piece)], out=sums[1:])
        starts = words.starts[i:j] - begin
        out[i:j] = (sums[words.ends[i:j] - begin] - sums[starts]) * inverse[starts]
        i = j
    return mix(out)


_FACTORS = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_starts(words: Words, width: int) -> np.ndarray:
    """Which words begin ``width`` words of one row."""
    fits = np.ones(len(words.starts), bool)
    for back in range(1, width):
        at = words.bounds[1:] - back
        fits[at[at >= words.bounds[:-1]]] = False
    return fits


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, over row ends too; see ``window_starts``."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(width * 0x9E37 + 1), np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * _FACTORS[k]
    return mix(total)


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between ``bounds``."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


class Known:
    """What a task has worked out for words so far, by hash; it starts afresh beyond ``limit`` words.

    ``solve`` gets the texts of new words and returns one row of ``columns`` for each.
    """

    def __init__(self, solve, dtypes: list, limit: int = 1 << 20):
        self.solve, self.dtypes, self.limit = solve, dtypes, limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.columns = [np.zeros(0, kind) for kind in self.dtypes]

    def rows(self, texts: Texts, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(each distinct word's place in ``columns``, each word's distinct word)."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        fresh = np.ones(len(distinct), bool)
        inside = place < len(self.keys)
        fresh[inside] = self.keys[place[inside]] != distinct[inside]
        if fresh.sum() + len(self.keys) > self.limit:
            self.clear()
            fresh[:] = True
        if fresh.any():
            raw = texts.data.tobytes()
            at = first[fresh]
            found = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[at], words.ends[at], strict=True)]
            made = self.solve(found)
            where = np.searchsorted(self.keys, distinct[fresh])
            self.columns = [np.insert(c, where, m) for c, m in zip(self.columns, made, strict=True)]
            self.keys = np.insert(self.keys, where, distinct[fresh])
        return np.searchsorted(self.keys, distinct), inverse
