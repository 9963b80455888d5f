"""Quality rules: counts against fixed limits, then distance from the corpus' own languages.

A text's histogram of character classes and of common words is compared to a reference for each
language by Jensen-Shannon distance. The references are means over all distinct texts of the language that
pass the counts, each with equal weight, and the common words are the words with a letter that these use
most. A document goes when it is far from every language. Texts under a minimum length are too short for a
histogram and are judged by the counts alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowward.llm.scratch import Scratch
from flowward.llm.words import (
    SPACED,
    Texts,
    Words,
    byte_class,
    chunks,
    find_words,
    per_row,
    window_hashes,
    window_starts,
    word_hashes,
)

#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"

CLASSES = ("lower", "upper", "digit", "space", "sentence mark", "symbol", "other ASCII", "beyond ASCII")
COLUMNS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "class_distance": pa.float64(),
    "word_distance": pa.float64(),
    "nearest_lang": pa.string(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
}
#: What the shares of one text sum to: whole numbers give the same sums in any order, for 2**33 texts a language.
SCALE = 1 << 30
#: Bits that mark which texts may repeat, sums of words a task gathers before it hands them on, and bytes of a run of
#: texts: what is made from a run takes many times its room.
FILTER_BITS = 1 << 26
GATHERED = 1 << 18
RUN_BYTES = 1 << 20
DDL = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean"}


@dataclass(frozen=True)
class Limits:
    """``min_words`` and ``max_repeat_percent`` are the base rules; the rest is for the distances.

    ``class_words`` and ``histogram_words`` are the least numbers of words for which the histogram of
    classes and that of common words is compared. The distance of common words is a share of the one that
    a text without any of them has. From ``short_words`` to ``histogram_words`` few words are counted, so a text
    goes only beyond ``max_short_distance``, farther than one without any common word.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 32
    max_class_distance: float = 0.25
    max_word_distance: float = 0.95
    class_words: int = 50
    histogram_words: int = 60
    short_words: int = 50
    max_short_distance: float = 1.0


@dataclass(frozen=True)
class References:
    """A row per language: shares of character classes, and of the common words, words without a letter and all others."""

    langs: list[str]
    classes: np.ndarray
    common: list[np.ndarray]
    words: list[np.ndarray]


def _class_table() -> np.ndarray:
    table = np.full(256, 6, np.uint8)
    for place, chars in enumerate(
        ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r", ".,;:?'\"-()", SYMBOLS)
    ):
        table[[ord(c) for c in chars]] = place
    table[0x80:0xC0] = 255  # the first byte stands for the character
    table[0xC0:] = 7
    return table


_CLASS_OF = _class_table()
_CONTINUED = byte_class((0x80, 0xBF))
_LETTER = byte_class((ord("A"), ord("Z")), (ord("a"), ord("z")))
_SYMBOL = byte_class(*((ord(c), ord(c)) for c in SYMBOLS))


def class_counts(texts: Texts) -> np.ndarray:
    """Characters of each class, a row per text."""
    kinds = _CLASS_OF[texts.data]
    return np.stack([per_row(kinds == k, texts.offsets) for k in range(len(CLASSES))], axis=1)


def _repeated_words(words: Words, hashes: np.ndarray, width: int = 3) -> np.ndarray:
    """Words in a window that its text has twice or more."""
    inside = np.zeros(len(hashes) + 1, np.int64)
    window = window_hashes(hashes, width)
    if len(window):
        starts = np.flatnonzero(window_starts(words, width)[: len(window)])
        row = np.searchsorted(words.bounds, starts, "right") - 1
        order = np.lexsort((window[starts], row))
        row, key = row[order], window[starts][order]
        same = (row[1:] == row[:-1]) & (key[1:] == key[:-1])
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        at = starts[order[again]]
        np.add.at(inside, at, 1)
        np.subtract.at(inside, at + width, 1)
    return per_row(np.cumsum(inside[:-1]) > 0, words.bounds)


def _duplicate_lines(texts: Texts, words: Words) -> np.ndarray:
    out = np.zeros(len(texts.offsets) - 1, np.int64)
    breaks = per_row(texts.data == 10, texts.offsets)
    for row in np.flatnonzero((breaks > 0) & (words.counts > 1)):
        raw = texts.data[texts.offsets[row] : texts.offsets[row + 1]].tobytes()
        lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\v\f\r")]
        out[row] = len(lines) - len(set(lines))
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of the rows of ``p`` from ``q``."""
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / middle), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / middle), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


def word_shares(hashes: np.ndarray, words: Words, common: np.ndarray, lettered: np.ndarray) -> np.ndarray:
    """Shares of each word of ``common`` (sorted hashes), of words without a letter, and of all others, a row per text."""
    n, k = len(words.bounds) - 1, len(common)
    counts = np.zeros((n, k + 2), np.int64)
    if k:
        place = np.minimum(np.searchsorted(common, hashes), k - 1)
        hit = np.flatnonzero(common[place] == hashes)
        row = np.searchsorted(words.bounds, hit, "right") - 1
        counts[:, :k] = np.bincount(row * k + place[hit], minlength=n * k).reshape(n, k)
    counts[:, k] = per_row(~lettered, words.bounds)
    counts[:, k + 1] = words.counts - counts[:, : k + 1].sum(axis=1)
    return _shares(counts)


def _from_common(shares: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Distances from ``reference`` as shares of that of a text without its common words."""
    none = np.zeros(len(reference))
    none[-1] = 1
    most = divergence(none, reference)
    return divergence(shares, reference) / most if most > 0 else np.zeros(len(shares))


def _base_failed(n_words: np.ndarray, repeated: np.ndarray, limits: Limits) -> np.ndarray:
    return (n_words < limits.min_words) | (100 * repeated > limits.max_repeat_percent * n_words)


def _with_letter(texts: Texts, words: Words, hashes: np.ndarray) -> np.ndarray:
    """Which words have a letter of any script."""
    ascii_letters, beyond = (np.concatenate([[0], np.cumsum(m)]) for m in (_LETTER[texts.data], texts.data >= 0x80))
    found = ascii_letters[words.ends] > ascii_letters[words.starts]
    open_ = np.flatnonzero(~found & (beyond[words.ends] > beyond[words.starts]))
    if len(open_):
        _, first, inverse = np.unique(hashes[open_], return_index=True, return_inverse=True)
        raw = texts.data.tobytes()
        spans = [raw[words.starts[i] : words.ends[i]].decode("utf-8", "replace") for i in open_[first]]
        found[open_] = np.array([any(c.isalpha() for c in w) for w in spans])[inverse]
    return found


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[firsts], np.add.reduceat(weights[order], firsts) if len(keys) else np.zeros(0, np.int64)


def _merged(sums: dict[str, list]) -> dict[str, list]:
    """The (values, sums) pairs of each language as one pair."""
    joined = {name: _sums(*(np.concatenate(side) for side in zip(*pairs, strict=True))) for name, pairs in sums.items() if pairs}
    return {name: [pair] for name, pair in joined.items()}


def _handed_on(sums: dict[str, list], is_word: bool) -> Iterator[pa.RecordBatch]:
    for name, pairs in _merged(sums).items():
        values, totals = pairs[0]
        langs = pa.array([name], pa.string()).take(pa.array(np.zeros(len(values), np.int64)))
        yield pa.RecordBatch.from_arrays(
            [langs, pa.array(np.full(len(values), is_word)), pa.array(values), pa.array(totals)], ["lang", "is_word", "item", "n"]
        )


def _profile(limits: Limits) -> Callable:
    """A task's sums: characters by language and class, words with a letter by language and hash; all others are class -1."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes_of: dict[str, list] = {}
        words_of: dict[str, list] = {}
        gathered, merged = 0, 0
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names = [v.as_py() for v in langs.dictionary]
            codes = np.asarray(langs.indices.fill_null(-1))
            for texts in chunks(batch.column(1), RUN_BYTES):
                words = find_words(texts, SPACED)
                counts = words.counts
                base = _base_failed(counts, _repeated_words(words, word_hashes(texts, words, lower=False)), limits)
                mine = np.where(base, -1, codes[texts.first : texts.last])
                hashes = word_hashes(texts, words, lower=True)
                lettered = _with_letter(texts, words, hashes)
                classes = np.rint(_shares(class_counts(texts)) * SCALE).astype(np.int64)
                by_word = np.repeat(mine, counts)
                weight = np.repeat(np.rint(SCALE / np.maximum(counts, 1)).astype(np.int64), counts)
                for code in np.unique(mine[mine >= 0]):
                    here = by_word == code
                    bare = weight[here & ~lettered].sum()
                    kinds = np.append(classes[mine == code].sum(axis=0), bare)
                    found = _sums(hashes[here & lettered].view(np.int64), weight[here & lettered])
                    classes_of.setdefault(names[code], []).append((np.append(np.arange(len(kinds) - 1), -1), kinds))
                    words_of.setdefault(names[code], []).append(found)
                    gathered += len(found[0])
            if gathered > merged + GATHERED:
                classes_of, words_of = _merged(classes_of), _merged(words_of)
                gathered = merged = sum(len(pairs[0][0]) for pairs in words_of.values())
                if merged > GATHERED:
                    yield from _handed_on(words_of, True)
                    words_of, gathered, merged = {}, 0, 0
        yield from _handed_on(classes_of, False)
        yield from _handed_on(words_of, True)

    return apply


def distinct_texts(narrow: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lang, text) rows of ``narrow`` without repeats, and the written table they read besides.

    Only texts that may repeat are shuffled. Rows are counted by a hash of language and text; each hash that comes more
    than once sets one of ``FILTER_BITS`` bits, broadcast as at most ``FILTER_BITS`` / 64 numbers. A row whose bit is not set
    has no equal; all others, among them rows that only share a bit, are compared in full.
    """
    hashed = narrow.withColumn("hash", F.xxhash64("lang", "text"))
    repeated = hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    place = f"pmod(hash, {FILTER_BITS}L)"
    bit = f"cast({place} & 63 AS int)"
    word = F.expr(f"shiftright({place}, 6)").alias("word")
    bits = scratch.cut(repeated.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("bits")))
    marked = hashed.withColumn("word", word).join(F.broadcast(bits), "word", "left")
    marked = marked.withColumn("open", F.expr(f"coalesce(shiftright(bits, {bit}) & 1L, 0L) = 1L"))
    single = marked.where("not open").select("lang", "text")
    return single.unionByName(marked.where("open").select("lang", "text").distinct()), bits


def learn_references(docs: DataFrame, limits: Limits = Limits(), lang_col: str = "lang", max_langs: int = 1000) -> References:
    """References of every language of ``docs``, from all its distinct texts that pass the base rules.

    What reaches the driver is a few dozen numbers a language; more than ``max_langs`` languages are refused.
    A text counts once in its language, however many rows have it, and texts weigh alike, however long. Documents
    without a language teach nothing; where none is left to learn from there are no references.
    """
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    narrow = docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "quality")
    each, bits = distinct_texts(narrow.where("lang is not null and text is not null"), scratch)
    sums = each.mapInArrow(_profile(limits), "lang string, is_word boolean, item long, n long")
    sums = sums.groupBy("lang", "is_word", "item").agg(F.sum("n").alias("n"))
    sums = scratch.cut(sums)
    scratch.drop(bits)
    by_count = Window.partitionBy("lang").orderBy(F.col("n").desc(), "item")
    top = (
        sums.where("is_word")
        .withColumn("rank", F.row_number().over(by_count))
        .where(F.col("rank") <= limits.common_words)
        .drop("rank")
    )
    totals = sums.where("is_word or item = -1").groupBy("lang").agg(F.sum("n").alias("n"))
    totals = totals.selectExpr("lang", "cast(null AS boolean) is_word", "cast(null AS long) item", "n")
    most = max_langs * (limits.common_words + 2 + len(CLASSES))
    rows = top.unionByName(totals).unionByName(sums.where("not is_word")).limit(most + 1).collect()
    scratch.drop(sums)
    if len(rows) > most:
        raise ValueError(f"More than {max_langs} languages")
    langs = sorted({r.lang for r in rows})
    classes = np.zeros((len(langs), len(CLASSES)))
    common, shares = [], []
    for place, name in enumerate(langs):
        mine = [r for r in rows if r.lang == name]
        for r in mine:
            if r.is_word is False and r.item >= 0:
                classes[place, r.item] = r.n
        total = sum(r.n for r in mine if r.is_word is None)
        bare = sum(r.n for r in mine if r.is_word is False and r.item == -1)
        found = sorted((int(np.int64(r.item).view(np.uint64)), r.n) for r in mine if r.is_word)
        common.append(np.array([h for h, _ in found], np.uint64))
        counts = np.array([n for _, n in found] + [bare, total - bare - sum(n for _, n in found)], float)
        shares.append(_shares(counts))
    return References(langs, _shares(classes), common, shares)


def measure(texts: Texts, refs: References, limits: Limits) -> dict[str, np.ndarray | list]:
    """All columns of ``COLUMNS`` for a run of texts."""
    words = find_words(texts, SPACED)
    hashes = word_hashes(texts, words, lower=False)
    n_words = words.counts
    inside = SPACED[texts.data] & ~_CONTINUED[texts.data]
    repeated = _repeated_words(words, hashes)
    base = _base_failed(n_words, repeated, limits)
    n = len(n_words)
    class_far, word_far, nearest = np.zeros(n), np.zeros(n), np.full(n, -1)
    if refs.langs:
        counted = _shares(class_counts(texts))
        lowered = word_hashes(texts, words, lower=True)
        by_class = np.stack([divergence(counted, ref) for ref in refs.classes], axis=1)
        lettered = _with_letter(texts, words, lowered)
        by_word = np.stack(
            [_from_common(word_shares(lowered, words, c, lettered), w) for c, w in zip(refs.common, refs.words, strict=True)], axis=1
        )
        nearest = np.argmin(by_class + by_word, axis=1)
        class_far, word_far = by_class.min(axis=1), by_word.min(axis=1)
    short = (n_words >= limits.short_words) & (n_words < limits.histogram_words)
    far = (
        ((class_far > limits.max_class_distance) & (n_words >= limits.class_words))
        | ((word_far > limits.max_word_distance) & (n_words >= limits.histogram_words))
        | ((word_far > limits.max_short_distance) & short)
    )
    names = [*refs.langs, None]
    return {
        "n_words": n_words,
        "word_chars": per_row(inside, texts.offsets),
        "n_symbols": per_row(_SYMBOL[texts.data], texts.offsets),
        "n_dup_lines": _duplicate_lines(texts, words),
        "n_repeat_words": repeated,
        "class_distance": class_far,
        "word_distance": word_far,
        "nearest_lang": [names[k] if w else None for k, w in zip(nearest, n_words, strict=True)],
        "base_failed": base,
        "kept": ~base & ~far,
    }


def _judged(refs: References, limits: Limits, place: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(t, refs, limits) for t in chunks(batch.column(place), RUN_BYTES)]
            if not parts:
                continue
            made = [pa.array(np.concatenate([p[c] for p in parts]), kind, from_pandas=True) for c, kind in COLUMNS.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *COLUMNS])

    return apply


def judge(docs: DataFrame, limits: Limits = Limits(), refs: References | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts, distances and verdict of every row, after its columns ``keep``.

    A null or empty text has no words and fails the base rules; an empty table has no rows. Repeated rows are judged alike. Columns of
    ``keep`` that bear a name of ``COLUMNS`` give way to the new ones. Words are compared in lower case.
    """
    refs = refs or learn_references(docs, limits)
    kept = [c for c in keep if c not in COLUMNS]
    narrow = docs.select(F.col("text").cast("string").alias("__text"), *kept)
    made = StructType.fromDDL(", ".join(f"{c} {DDL[kind]}" for c, kind in COLUMNS.items()))
    schema = StructType([*narrow.schema.fields, *made.fields])
    return narrow.mapInArrow(_judged(refs, limits, 0), schema).drop("__text")


def _passing(refs: References, limits: Limits, place: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in chunks(batch.column(place), RUN_BYTES):
                yield batch.slice(t.first, t.last - t.first).filter(pa.array(measure(t, refs, limits)["kept"]))

    return apply


def drop_poor(docs: DataFrame, limits: Limits = Limits(), refs: References | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns as they were."""
    refs = refs or learn_references(docs, limits)
    return docs.mapInArrow(_passing(refs, limits, docs.columns.index("text")), docs.schema)
