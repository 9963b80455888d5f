"""Byte-level BPE of whole texts through one table of distinct words.

Texts are cut where the tokenizer can neither join nor look across, the distinct words are counted and each is
encoded once; an id-to-piece join decodes them once. Ids and decoded texts come back by position: the most
frequent words form a table of bounded size that all tasks hold, so that a text becomes a sequence of small
numbers where it is read; all other words of a text are joined to the table of distinct words. Texts are read once
more to be put together, so that their numbers are shuffled, but never written.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowward.llm.scratch import Scratch
from flowward.llm.words import SPACED, Texts, Words, chunks, cut_before, gather, word_hashes, word_texts

#: Bound of the table that tasks hold: words, and bytes of one word. At most 170 MB, commonly 35 MB.
HOT_WORDS = 1 << 20
HOT_BYTES = 48
#: Bytes of texts cut at a time, and word occurrences put together at a time.
RUN_BYTES = 1 << 20
RUN = 1 << 17

SPACE = ~SPACED
ZSTD = pa.Codec("zstd", compression_level=1)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


def piece_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every id of a byte-level vocabulary file, added tokens among them."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    letters = byte_letters()
    pieces = {i: t for t, i in model["model"]["vocab"].items()}
    pieces |= {t["id"]: t["content"] for t in model["added_tokens"]}
    return {
        i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for i, t in pieces.items()
    }


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a vocabulary file; as many rows as it has ids."""
    pieces = piece_bytes(path)
    table = pa.table({"id": pa.array(pieces, pa.int32()), "piece": pa.array(pieces.values(), pa.binary())})
    return spark.createDataFrame(table)


# ---- distinct words --------------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in chunks(batch.column(0)):
            words = cut_before(texts, SPACE)
            if len(words.starts):
                hashes = word_hashes(texts, words, lower=False)
                _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                found = word_texts(texts, words).take(pa.array(first)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([found, pa.array(counts, pa.int64())], ["word", "n"])


def distinct_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): every distinct word of the texts and how often it stands there."""
    texts = docs.select(F.col(text_col).cast("string"))
    return texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _encode_words(path: str) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for texts in chunks(batch.column(0), 1 << 20):
                rows = batch.slice(texts.first, texts.last - texts.first)
                found = [e.ids for e in tokenizer.encode_batch(rows.column(0).to_pylist(), add_special_tokens=False)]
                arrays = [*rows.columns, pa.array(found, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, [*rows.schema.names, "ids"])

    return apply


def _utf8(raw: pa.Array) -> pa.Array:
    """Bytes as text; what is no UTF-8 becomes U+FFFD, as the tokenizer does it."""
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())


def _regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Successive rows (w, ..., id, piece) of one ``w`` as one row (..., ids, decoded)."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        w = held.column("w").to_numpy()
        if len(w) and w[0] != w[-1]:
            complete = int(np.searchsorted(w, w[-1]))  # w only grows
            yield from _regrouped(held.slice(0, complete))
            held = held.slice(complete)
    if held is not None and len(held):
        yield from _regrouped(held)


def _regrouped(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    starts = np.flatnonzero(np.diff(rows.column("w").to_numpy(), prepend=-1))
    real = pa.compute.is_valid(rows.column("id")).to_numpy().astype(np.int64)
    ids = rows.column("id").drop_null().combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(real)])[np.append(starts, len(rows))]
    data, offsets = _flat_bytes(rows.column("piece"))
    offsets = pa.py_buffer(offsets[np.append(starts, len(rows))])
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)])
    kept = rows.drop_columns(["w", "id", "piece"]).take(pa.array(starts)).combine_chunks()
    columns = [kept.column(c).combine_chunks() for c in kept.column_names]
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), ids)
    yield pa.RecordBatch.from_arrays([*columns, lists, _utf8(raw)], [*kept.column_names, "ids", "decoded"])


def decode_ids(table: DataFrame, ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """``table`` with ``decoded``, the text of the array ``ids``, through a join of ids and pieces.

    Special tokens are decoded to their text. A null or empty array gives the empty text (and comes back empty), an
    id that the vocabulary does not have gives nothing; an empty table stays empty. The pieces are broadcast: they
    are as many as the tokenizer that each task holds has ids. Such a join leaves the rows of an array together and
    in order, so they need no shuffle to be put together again.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    pieces = F.broadcast(piece_table(table.sparkSession, tokenizer).withColumnRenamed("id", "__id"))
    kept = [c for c in table.columns if c not in (ids, "decoded")]
    numbered = table.withColumn("w", F.monotonically_increasing_id())
    each = numbered.select("w", *kept, F.posexplode_outer(F.col(ids).cast("array<int>")).alias("pos", "id"))
    # the other columns go with the first id alone: a long text is not repeated with each of its ids
    once = [F.when(F.coalesce("pos", F.lit(0)) == 0, F.col(c)).alias(c) for c in kept]
    each = each.select("w", *once, "id")
    joined = each.join(pieces, each["id"] == pieces["__id"], "left").select("w", *kept, "id", "piece")
    fields = [f"`{c}` {table.schema[c].dataType.simpleString()}" for c in kept]
    back = joined.mapInArrow(_regroup, ", ".join([*fields, "ids array<int>", "decoded string"]))
    return back.withColumnRenamed("ids", ids)


def word_table(docs: DataFrame, scratch: Scratch, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(word, n, ids, other): each distinct word, encoded and decoded once; a written table.

    ``other`` is what its ids decode to, null where that is the word itself.
    """
    counted = distinct_words(docs, text_col)
    encoded = counted.mapInArrow(_encode_words(tokenizer), "word string, n long, ids array<int>")
    # written in between: a task that encodes and decodes has two Python workers, which stay beside those of later stages
    encoded = scratch.cut(encoded, compression="zstd")
    other = F.when(F.col("decoded") != F.col("word"), F.col("decoded"))
    table = decode_ids(encoded, "ids", tokenizer).select("word", "n", "ids", other.alias("other"))
    table = scratch.cut(table, compression="zstd")
    scratch.drop(encoded)
    return table


# ---- the words that tasks hold ---------------------------------------------------------------------------------


def most_frequent(table: DataFrame, limit: int, fits=None, count: str = "n") -> DataFrame:
    """Rows of ``table`` whose ``count`` is so high that no more than ``limit`` rows have it, all ties or none.

    Counts are weighed by steps of 9 %. ``fits`` leaves rows out beforehand.
    """
    chosen = table if fits is None else table.where(fits)
    step = F.floor(F.log2(F.col(count)) * 8)
    steps = chosen.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # 512 rows at most
    least, total = None, 0
    for row in steps:
        total += row["count"]
        if total > limit:
            break
        least = row["step"]
    return chosen.where(F.lit(False) if least is None else step >= least)


class HotWords:
    """The most frequent words, numbered by frequency: their hashes, ids and decoded bytes.

    Every executor keeps what it is sent on its disk, too: that is compressed, and without what follows from the words.
    """

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
        other = rows.column("other")
        ids, id_bounds = _flat_lists(rows.column("ids"))
        self.text, text_bounds = _flat_bytes(pa.compute.coalesce(other, rows.column("word")))
        self.ids = ids.astype(np.min_scalar_type(ids.max(initial=0)))
        self.sizes = [np.diff(b).astype(np.uint16) for b in (id_bounds, text_bounds)]
        # words that do not decode to themselves, and their hashes
        self.changed = np.flatnonzero(pa.compute.is_valid(other).to_numpy())
        self.changed_hashes = _row_hashes(*_flat_bytes(rows.column("word").take(pa.array(self.changed))))
        self._number()

    def _number(self) -> None:
        hashes = _row_hashes(self.text, np.concatenate([[0], np.cumsum(self.sizes[1], dtype=np.int64)]))
        hashes[self.changed] = self.changed_hashes
        order = np.argsort(hashes)
        self.size, self.hashes, self.codes = len(hashes), hashes[order], order.astype(np.uint32)

    def __getstate__(self) -> list[tuple[str, int, bytes]]:
        arrays = (self.text, self.ids, *self.sizes, self.changed, self.changed_hashes)
        return [(a.dtype.str, len(a), ZSTD.compress(a.tobytes(), asbytes=True)) for a in arrays]

    def __setstate__(self, state: list[tuple[str, int, bytes]]) -> None:
        raw = [(np.dtype(kind), n, data) for kind, n, data in state]
        arrays = [np.frombuffer(ZSTD.decompress(data, n * kind.itemsize, asbytes=True), kind) for kind, n, data in raw]
        self.text, self.ids, *self.sizes, self.changed, self.changed_hashes = arrays
        self._number()

    @functools.cached_property
    def bounds(self) -> list[np.ndarray]:
        """Where the ids and the decoded bytes of each word begin."""
        return [np.concatenate([[0], np.cumsum(s, dtype=np.int64)]) for s in self.sizes]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, ``size`` for those that are not here."""
        if not self.size:
            return np.zeros(len(hashes), np.uint32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        return np.where(self.hashes[at] == hashes, self.codes[at], np.uint32(self.size))


def _row_hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The hash of each row's bytes as one word."""
    n = len(bounds) - 1
    return word_hashes(Texts(0, n, data, bounds), Words(bounds[:-1], bounds[1:], np.arange(n + 1)), lower=False)


def _flat_lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(all values, bounds by row) of a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, bounds by row) of a column of bytes or text; null is empty."""
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _coded(hot: HotWords, texts: Texts) -> tuple[Words, np.ndarray, pa.Array, list[int]]:
    """Words and their numbers; then each text's words that tasks do not hold, each once, and how many these are.

    Their order and their numbers, from ``size`` on, follow from the text alone.
    """
    words = cut_before(texts, SPACE)
    distinct, first, inverse = np.unique(word_hashes(texts, words, lower=False), return_index=True, return_inverse=True)
    codes = hot.find(distinct)[inverse]
    cold = np.flatnonzero(codes == hot.size)
    bounds = np.searchsorted(cold, words.bounds)
    rest, n_rest = [np.zeros(0, np.int64)], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n_rest.append(0)
        if b > a:
            kinds, local = np.unique(inverse[cold[a:b]], return_inverse=True)
            codes[cold[a:b]] = hot.size + local
            rest.append(first[kinds])
            n_rest[-1] = len(kinds)
    rare = word_texts(texts, words).take(pa.array(np.concatenate(rest))).cast(pa.string())
    return words, codes, rare, n_rest


def _rare_words(shared) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: HotWords = shared.value
        for batch in batches:
            for texts in chunks(batch.column(2), RUN_BYTES):
                _, _, rare, n_rest = _coded(hot, texts)
                rows = pa.array(np.repeat(np.arange(texts.first, texts.last), n_rest))
                place = np.arange(len(rare)) - np.repeat(np.cumsum(n_rest) - n_rest, n_rest)
                arrays = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place.astype(np.int32)), rare]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "hash", "k", "word"])

    return apply


def _to_codes(shared) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: HotWords = shared.value
        for batch in batches:
            for texts in chunks(batch.column(3), RUN_BYTES):
                words, codes, rare, n_rest = _coded(hot, texts)
                data, ends = _flat_bytes(rare)
                upto = np.concatenate([[0], np.cumsum(n_rest)]).astype(np.int64)
                sizes, n_bytes = np.diff(ends), np.diff(ends[upto])
                bounds = zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True)
                out = [_packed(codes[a:b], sizes[c:d], data[ends[c] : ends[d]]) for a, b, c, d in bounds]
                arrays = [
                    *batch.slice(texts.first, texts.last - texts.first).columns[:3],
                    pa.array(words.counts.astype(np.int32)),
                    pa.array(n_rest, pa.int32()),
                    pa.array(n_bytes.astype(np.int32)),
                    pa.array(out, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "id", "hash", "n_words", "n_rare", "n_bytes", "codes"])

    return apply


def _planes(numbers: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the second ones and so on."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _packed(codes: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> bytes:
    """The numbers of a text's words, and its own words by their sizes and bytes, compressed."""
    return ZSTD.compress(_planes(codes) + _planes(sizes) + data.tobytes(), asbytes=True) if len(codes) else b""


def _unpacked(raw: bytes, n: int, n_rare: int, n_bytes: int) -> list[np.ndarray]:
    if not n:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)]
    data = np.frombuffer(ZSTD.decompress(raw, 4 * (n + n_rare) + n_bytes, asbytes=True), np.uint8)
    planes = [data[: 4 * n], data[4 * n : 4 * (n + n_rare)]]
    numbers = [np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for x in planes]
    return [*numbers, data[4 * (n + n_rare) :]]


def _put_together(shared) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: HotWords = shared.value
        for batch in batches:
            ends = np.cumsum(batch.column("n_words").to_numpy().astype(np.int64))
            first = 0
            while first < batch.num_rows:
                base = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + RUN, "right")))
                yield _texts_of(hot, batch.slice(first, last - first))
                first = last

    return apply


def _texts_of(hot: HotWords, rows: pa.RecordBatch) -> pa.RecordBatch:
    n_words = rows.column("n_words").to_numpy().astype(np.int64)
    n_rare = rows.column("n_rare").to_numpy()
    given = zip(rows.column("codes").to_pylist(), n_words.tolist(), n_rare.tolist(), rows.column("n_bytes").to_pylist(), strict=True)
    codes, sizes, data = (np.concatenate(x) for x in zip(*(_unpacked(*g) for g in given), strict=True))
    word_bounds = np.concatenate([[0], np.cumsum(n_words)])
    # the joined words of each text stand behind the shared ones
    joined = rows.column("joined")
    held = np.diff(_list_bounds(joined))
    if not np.array_equal(held, n_rare):
        raise ValueError("The texts are not the same each time they are read")
    rare = joined.flatten()
    order = np.lexsort((rare.field("k").to_numpy(), np.repeat(np.arange(len(held)), held)))
    rare = rare.take(pa.array(order))
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    words = pa.LargeStringArray.from_buffers(len(sizes), offsets, pa.py_buffer(data))
    words = pa.compute.coalesce(rare.field("other").cast(pa.large_string()), words)
    base = np.cumsum(held) - held
    codes += np.where(codes >= hot.size, np.repeat(base, n_words), 0)

    used, which = np.unique(codes, return_inverse=True)
    shared, own = used[used < hot.size], used[used >= hot.size] - hot.size

    def all_of(side: int, known: np.ndarray, flat: np.ndarray, bounds: np.ndarray):
        sizes = [hot.sizes[side][shared].astype(np.int64), np.diff(bounds)[own]]
        flat = np.concatenate([gather(known, hot.bounds[side][shared], sizes[0]), gather(flat, bounds[own], sizes[1])])
        sizes = np.concatenate(sizes)
        starts = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[which])])[word_bounds]
        return gather(flat, starts[which], sizes[which]), ends

    ids, id_bounds = all_of(0, hot.ids, *_flat_lists(rare.field("ids")))
    text, text_bounds = all_of(1, hot.text, *_flat_bytes(words))
    texts = pa.LargeStringArray.from_buffers(len(held), pa.py_buffer(text_bounds.astype(np.int64)), pa.py_buffer(text))
    lists = pa.ListArray.from_arrays(pa.array(id_bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), lists, texts.cast(pa.string())], ["doc_id", "ids", "decoded"])


def _list_bounds(column: pa.Array) -> np.ndarray:
    """Bounds by row of a column of lists; a null has none."""
    sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
    return np.concatenate([[0], np.cumsum(sizes)])


def encode_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_words: int = HOT_WORDS,
) -> DataFrame:
    """(doc_id, ids, decoded) of every text, one row per input row.

    ``ids`` is what the tokenizer file gives for the whole text without adding special tokens; where a special
    token's text stands in it, that is one id. ``decoded`` is the text of the ids, special tokens included. The table is
    read three times: its texts have to stay the same, their order and partitions need not. Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded each, a null id stays null, other
    columns are not read, an empty table stays empty. A text without white space is one word, however long.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = word_table(narrow, scratch, tokenizer)
    small = F.octet_length("word") <= HOT_BYTES
    hot = most_frequent(table, hot_words, small).select("word", "n", "ids", "other")
    shared = spark.sparkContext.broadcast(HotWords(hot.toArrow()))
    # rows are known by id and text, not by place: another reading may deal them otherwise
    key = [F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("hash")]
    rare = narrow.select(*key, "text").mapInArrow(_rare_words(shared), "id long, hash long, k int, word string")
    rare = rare.join(table.drop("n"), "word").select("id", "hash", "k", "ids", "other")
    rare = scratch.cut(rare, compression="zstd")
    scratch.drop(table)
    joined = rare.groupBy("id", "hash").agg(F.collect_set(F.struct("k", "ids", "other")).alias("joined"))
    kinds = "doc_id long, id long, hash long, n_words int, n_rare int, n_bytes int, codes binary"
    coded = narrow.select("doc_id", *key, "text").mapInArrow(_to_codes(shared), kinds)
    whole = coded.join(joined, ["id", "hash"], "left").drop("id", "hash")
    return whole.mapInArrow(_put_together(shared), "doc_id long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_documents``."""
    found = encode_documents(docs, tokenizer)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
