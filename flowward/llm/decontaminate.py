"""Benchmark decontamination with suffix arrays over the training texts.

Each run of some megabytes of documents is a shard. Its suffix array holds, in order, the suffixes that
begin with words some test window begins with; no other suffix can match. Every test suffix is then looked
up by binary search, and matches that follow each other on the same diagonal are joined to the longest
verbatim matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowward.llm.words import (
    ALPHANUMERIC,
    Words,
    chunks,
    find_words,
    window_hashes,
    word_hashes,
)

WINDOW = 13
#: The test texts that one pass compares; a larger test set takes several passes.
BLOCK_BYTES = 8 << 20
SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "longest_match long, match_start long, match_item string, match_item_start long"
)


@dataclass(frozen=True)
class TestWindows:
    """Distinct windows of one width, sorted; ``uses`` are its places in items, ``bounds`` by window."""

    width: int
    keys: np.ndarray
    bounds: np.ndarray
    uses: np.ndarray


@dataclass(frozen=True)
class TestSet:
    """``items`` by number; ``heads`` are the hashes of the first ``head`` words of all windows."""

    items: list[str]
    windows: list[TestWindows]
    head: int
    heads: np.ndarray


def _key(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Suffixes' first ``width`` words as byte strings, which compare word by word."""
    words = hashes[starts[:, None] + np.arange(width)]
    return np.ascontiguousarray(words.astype(">u8")).view(f"S{8 * width}").ravel()


def prepare(items: list[tuple[str, str | None]], width: int = WINDOW) -> TestSet:
    """The windows of test items (id, text): ``width`` words each, a shorter item whole."""
    names, places, keys = [], {}, {}
    column = pa.array([text for _, text in items], pa.string())
    names = [name for name, _ in items]
    for texts in chunks(column):
        words = find_words(texts, ALPHANUMERIC)
        hashes = word_hashes(texts, words, lower=True)
        for row, n in enumerate(words.counts):
            if not n:
                continue
            size = min(int(n), width)
            starts = np.arange(words.bounds[row], words.bounds[row] + n - size + 1)
            keys.setdefault(size, []).append(_key(hashes, starts, size))
            at = np.stack([np.full(len(starts), texts.first + row), starts - words.bounds[row]], axis=1)
            places.setdefault(size, []).append(at)
    windows, head = [], min(3, *keys) if keys else 0
    heads = [np.zeros(0, np.uint64)]
    for size in sorted(keys):
        all_keys, uses = np.concatenate(keys[size]), np.concatenate(places[size])
        order = np.argsort(all_keys, kind="stable")
        distinct, first = np.unique(all_keys[order], return_index=True)
        windows.append(TestWindows(size, distinct, np.append(first, len(order)), uses[order]))
        parts = np.frombuffer(_full(distinct, size), ">u8").reshape(-1, size)[:, :head].astype(np.uint64)
        heads.append(window_hashes(np.ascontiguousarray(parts).ravel(), head)[::head] if len(parts) else heads[0])
    return TestSet(names, windows, head, np.unique(np.concatenate(heads)))


def _full(keys: np.ndarray, size: int) -> bytes:
    """The bytes of fixed-width keys, zeros at the end included."""
    return np.ascontiguousarray(keys.astype(f"S{8 * size}")).view(np.uint8).tobytes()


@dataclass
class Matches:
    """A row per match of a window: document row, word of the shard, width, item, word of the item."""

    row: np.ndarray
    at: np.ndarray
    width: np.ndarray
    item: np.ndarray
    item_at: np.ndarray


def find_matches(words: Words, hashes: np.ndarray, tests: TestSet) -> Matches:
    """All occurrences of test windows in a shard's rows."""
    found: list[tuple] = []
    heads = window_hashes(hashes, tests.head) if tests.windows else np.zeros(0, np.uint64)
    if len(heads):
        place = np.minimum(np.searchsorted(tests.heads, heads), len(tests.heads) - 1)
        starts = np.flatnonzero(tests.heads[place] == heads)
        row = np.searchsorted(words.bounds, starts, "right") - 1
        room = words.bounds[row + 1] - starts
        padded = np.concatenate([hashes, np.zeros(WINDOW * 8, np.uint64)])
        for tested in tests.windows:
            fits = room >= tested.width
            mine, mine_row = starts[fits], row[fits]
            suffixes = _key(padded, mine, tested.width)
            order = np.argsort(suffixes, kind="stable")
            array = suffixes[order]
            low = np.searchsorted(array, tested.keys, "left")
            high = np.searchsorted(array, tested.keys, "right")
            window = np.repeat(np.arange(len(low)), high - low)
            if not len(window):
                continue
            at = order[_ranges(low, high)]
            uses = np.diff(tested.bounds)[window]
            use = tested.uses[_ranges(tested.bounds[window], tested.bounds[window + 1])]
            found.append(
                (
                    np.repeat(mine_row[at], uses),
                    np.repeat(mine[at], uses),
                    np.full(len(use), tested.width),
                    use[:, 0],
                    use[:, 1],
                )
            )
    if not found:
        return Matches(*(np.zeros(0, np.int64) for _ in range(5)))
    return Matches(*(np.concatenate(column) for column in zip(*found, strict=True)))


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from ``low`` to below ``high``, range after range."""
    lengths = high - low
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + lengths, lengths)


def longest_runs(found: Matches) -> tuple[np.ndarray, ...]:
    """Verbatim matches, longest possible: (row, word of the shard, length, item, word of the item)."""
    diagonal = found.at - found.item_at
    order = np.lexsort((found.at, diagonal, found.item, found.row))
    row, at, item, diag = (x[order] for x in (found.row, found.at, found.item, diagonal))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diag[1:] != diag[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(order)) - 1 if len(first) else first
    length = at[last] - at[first] + found.width[order][last]
    return row[first], at[first], length, item[first], found.item_at[order][first]


def _judge_rows(words: Words, found: Matches, tests: TestSet) -> dict[str, list]:
    n_words = words.counts
    marks = np.zeros(words.bounds[-1] + 1 if len(words.bounds) else 1, np.int64)
    np.add.at(marks, found.at, 1)
    np.subtract.at(marks, found.at + found.width, 1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
    n_hit = hit[words.bounds[1:]] - hit[words.bounds[:-1]]
    n = len(n_words)
    items: list[list[str]] = [[] for _ in range(n)]
    longest = [0] * n
    spots: list[tuple] = [(None, None, None)] * n
    if len(found.row):
        pairs = np.unique(np.stack([found.row, found.item], axis=1), axis=0)
        for row, item in pairs:
            items[row].append(tests.items[item])
        items = [sorted(set(names)) for names in items]  # an id may stand for several texts
        row, at, length, item, item_at = longest_runs(found)
        used, place = np.unique(item, return_inverse=True)
        names = [tests.items[k] for k in used]
        rank = {name: k for k, name in enumerate(sorted(set(names)))}
        by_name = np.array([rank[name] for name in names], np.int64)[place]
        order = np.lexsort((item_at, by_name, at, -length, row))
        best = order[np.unique(row[order], return_index=True)[1]]
        for k in best:
            r = row[k]
            longest[r] = int(length[k])
            spots[r] = (int(at[k] - words.bounds[r]), tests.items[item[k]], int(item_at[k]))
    return {
        "n_words": n_words.tolist(),
        "n_hit": n_hit.tolist(),
        "items": items,
        "longest": longest,
        "spots": spots,
        "contaminated": ((n_hit > 0) & (20 * n_hit >= n_words)).tolist(),
    }


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _searcher(test_set: TestSet, place: int, emit: Callable) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in chunks(batch.column(place)):
                words = find_words(texts, ALPHANUMERIC)
                found = find_matches(words, word_hashes(texts, words, lower=True), test_set)
                yield emit(batch.slice(texts.first, texts.last - texts.first), words, found)

    return apply


def _report(tests: TestSet) -> Callable:
    def emit(batch: pa.RecordBatch, words: Words, found: Matches) -> pa.RecordBatch:
        rows = _judge_rows(words, found, tests)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(rows["n_words"], pa.int64()),
                pa.array(rows["n_hit"], pa.int64()),
                pa.array([len(i) for i in rows["items"]], pa.int64()),
                pa.array([digest(i) for i in rows["items"]], pa.string()),
                pa.array(rows["contaminated"], pa.bool_()),
                pa.array(rows["longest"], pa.int64()),
                pa.array([s[0] for s in rows["spots"]], pa.int64()),
                pa.array([s[1] for s in rows["spots"]], pa.string()),
                pa.array([s[2] for s in rows["spots"]], pa.int64()),
            ],
            [c.split()[0] for c in SCHEMA.split(", ")],
        )

    return emit


def _clean(tests: TestSet) -> Callable:
    def emit(batch: pa.RecordBatch, words: Words, found: Matches) -> pa.RecordBatch:
        return batch.filter(pa.array([not c for c in _judge_rows(words, found, tests)["contaminated"]], pa.bool_()))

    return emit


def test_sets(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> list[TestSet]:
    """The windows of a test table (item_id, text), in blocks of at most ``limit`` bytes of text for one pass each.

    A null id goes by the name ``null``; items without words have no windows; equal rows count once.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.col("text").cast("string").alias("text")
    ).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // (limit // 2)) if size > limit else 1
    blocks = []
    for block in range(n):  # one block at a time passes through the driver
        mine = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == block)
        blocks.append(prepare(sorted({(r.id, r.text) for r in mine.toLocalIterator()})))
    return blocks or [prepare([])]


def _one_pass(docs: DataFrame, tests: TestSet) -> DataFrame:
    return docs.mapInArrow(_searcher(tests, 1, _report(tests)), SCHEMA)


def _many_passes(docs: DataFrame, blocks: list[TestSet]) -> DataFrame:
    """One pass a block over all rows; a document's hits of all blocks are put together afterwards."""
    passes = None
    for tests in blocks:
        found = docs.withColumn("key", F.md5("text")).mapInArrow(_searcher(tests, 1, _ranges_found(tests)), RANGES)
        passes = found if passes is None else passes.unionByName(found)
    rows = passes.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"),
        (F.count("*") / len(blocks)).cast("int").alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.min(F.struct((-F.col("longest_match")).alias("shorter"), "match_start", "match_item", "match_item_start")).alias("best"),
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, h: F.struct(
            (a["n"] + F.greatest(F.lit(0), h["to"] - F.greatest(a["to"], h["at"]))).alias("n"),
            F.greatest(a["to"], h["to"]).alias("to"),
        ),
    )["n"]
    return (
        rows.withColumn("n_hit", covered)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
            (-F.col("best.shorter")).alias("longest_match"),
            F.col("best.match_start"),
            F.col("best.match_item"),
            F.col("best.match_item_start"),
            "key",
        )
    )


RANGES = (
    "doc_id long, key string, n_words long, hits array<struct<at: long, to: long>>, items array<string>, "
    "longest_match long, match_start long, match_item string, match_item_start long"
)


def _ranges_found(tests: TestSet) -> Callable:
    def emit(batch: pa.RecordBatch, words: Words, found: Matches) -> pa.RecordBatch:
        rows = _judge_rows(words, found, tests)
        hits: list[list] = [[] for _ in range(batch.num_rows)]
        for row, at, width in np.unique(np.stack([found.row, found.at, found.width], axis=1), axis=0):
            start = int(at - words.bounds[row])
            hits[row].append({"at": start, "to": start + int(width)})
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array(rows["n_words"], pa.int64()),
                pa.array(hits, pa.list_(pa.struct([("at", pa.int64()), ("to", pa.int64())]))),
                pa.array(rows["items"], pa.list_(pa.string())),
                pa.array(rows["longest"], pa.int64()),
                pa.array([s[0] for s in rows["spots"]], pa.int64()),
                pa.array([s[1] for s in rows["spots"]], pa.string()),
                pa.array([s[2] for s in rows["spots"]], pa.int64()),
            ],
            ["doc_id", "key", "n_words", "hits", "items", "longest_match", "match_start", "match_item", "match_item_start"],
        )

    return emit


def decontaminate(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """How much of every document is verbatim benchmark text, one row per input row.

    A word is hit when it lies in an occurrence of 13 consecutive words of an item (a shorter item: of all its
    words). A document is contaminated when at least a twentieth of its words is hit. ``longest_match`` is in
    words, its place given in words of the document and of ``match_item``; ties go to the earliest place,
    then to the least item. Null and empty texts have no words; repeated rows are judged alike; an empty benchmark contaminates nothing;
    other columns are not read. A benchmark of more than ``limit`` bytes takes several passes, and of a match
    that runs through items of different passes only one is named.
    """
    blocks = test_sets(benchmark, limit)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _one_pass(narrow, blocks[0]) if len(blocks) == 1 else _many_passes(narrow, blocks).drop("key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns as they were."""
    blocks = test_sets(benchmark, limit)
    if len(blocks) == 1:
        return docs.mapInArrow(_searcher(blocks[0], docs.columns.index("text"), _clean(blocks[0])), docs.schema)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bad = _many_passes(narrow, blocks).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.md5("text").eqNullSafe(F.col("__key"))
    return docs.join(bad.distinct(), same, "left_anti")
