"""Best-fit packing of tokenized documents into sequences, with bounds that certify each part.

Pieces are dealt into parts of bounded size and packed best-fit decreasing. Dual feasible functions bound
the number of bins of a part from below. A part that meets its bound is done, but for the bins it leaves
ill filled; parts that miss it exchange the pieces of their open bins and pack again.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowward.llm.scratch import Scratch
from flowward.llm.words import SPACED, Known, chunks, find_words, gather, per_row, word_hashes

CAPACITY = 4096
END = 1
PART_PIECES = 20_000
#: Bytes of a run of texts, and words a task remembers: a worker holds them beside what earlier operators left it.
RUN_BYTES = 1 << 20
KNOWN_WORDS = 1 << 19
ROUNDS = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Words of printable ASCII and Latin letters up to U+017F, whose case and classes are the same everywhere.
PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]+")
#: Fixed value: how the tokenizer cuts a lower-cased word, written for the characters of ``PLAIN``.
CUTS = re.compile(
    "('s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]"
    "|[^a-z0-9\x01\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+)"
)
PART_END, WORD_END = "\x00", "\x01"  # no word of PLAIN has them


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


def plain_encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The file's merges for words of ``PLAIN``, with ``PART_END`` for its end-of-word mark, and its ids by rank."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters, suffix = _byte_letters(), model["end_of_word_suffix"]

    def raw(token: str) -> bytes:
        ended = token.endswith(suffix)
        return bytes(letters[c] for c in token.removesuffix(suffix)) + PART_END.encode() * ended

    by_bytes = {raw(token): i for token, i in model["vocab"].items() if not token.startswith("<|")}
    ranks = {bytes([b]): b for b in range(256)}
    for b in range(1, 256):  # a byte joins the mark after it before all else
        ranks[bytes([b]) + PART_END.encode()] = 255 + b
    for merge in model["merges"]:
        first, second = merge if isinstance(merge, list) else merge.split(" ")
        ranks.setdefault(raw(first + second), len(ranks))
    ids = np.full(len(ranks), -1, np.int64)
    for token, rank in ranks.items():
        ids[rank] = by_bytes.get(token, -1)
    encoder = tiktoken.Encoding(
        "plain", pat_str=r"[^\x00\x01]+\x00|\x01", mergeable_ranks=ranks, special_tokens={}
    )
    return encoder, ids


class WordIds:
    """Token ids of whole texts, each distinct word encoded once a task.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in turn.
    Words of ``PLAIN`` go through a faster encoder with the same merges, all others through the tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain, self.ids_of_rank = plain_encoder(path)
        self.flat = np.zeros(0, np.uint32)
        self.known = Known(self._solve, [np.int64, np.int32], limit=KNOWN_WORDS)

    def _plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, numbers of ids by word)."""
        text = CUTS.sub(r"\1" + PART_END, WORD_END.join(words).lower()) + WORD_END
        ranks = self.plain.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        ended = ranks == ord(WORD_END)
        counts = np.diff(np.flatnonzero(ended), prepend=-1) - 1
        return self.ids_of_rank[ranks[~ended]], counts

    def _solve(self, words: list[str]) -> list[np.ndarray]:
        if not len(self.known.keys):
            self.flat = np.zeros(0, np.uint32)
        plain = np.array([PLAIN.fullmatch(w) is not None and not any(s in w for s in self.specials) for w in words], bool)
        counts, parts = np.zeros(len(words), np.int64), []
        starts = np.zeros(len(words), np.int64)
        at = len(self.flat)
        if plain.any():
            ids, counts[plain] = self._plain_ids([w for w, p in zip(words, plain, strict=True) if p])
            parts.append(ids)
            starts[plain] = at + np.cumsum(counts[plain]) - counts[plain]
            at += len(ids)
        for k in np.flatnonzero(~plain):
            ids = np.array(self.tokenizer.encode(words[k], add_special_tokens=False).ids, np.int64)
            parts.append(ids)
            starts[k], counts[k] = at, len(ids)
            at += len(ids)
        self.flat = np.concatenate([self.flat, np.concatenate(parts).astype(np.uint32)])
        return [starts, counts]

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts with ``END`` after each, bounds by text)."""
        for texts in chunks(column, RUN_BYTES):
            words = find_words(texts, SPACED)
            place, which = self.known.rows(texts, words, word_hashes(texts, words, lower=False))
            starts, counts = (c[place][which] for c in self.known.columns)
            sizes = per_row(counts, words.bounds) + 1
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            out = np.empty(bounds[-1], np.uint32)
            inside = np.ones(bounds[-1], bool)
            inside[bounds[1:] - 1] = False
            out[inside] = gather(self.flat, starts, counts)
            out[bounds[1:] - 1] = END
            yield out, bounds


@functools.lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _cut(path: str, capacity: int, with_ids: bool) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _word_ids(path)
        for batch in batches:
            row = 0
            for ids, bounds in encoder.texts(batch.column(1)):
                rows: list[tuple] = []
                kept: list[np.ndarray] = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for piece, start in enumerate(range(a, b, capacity)):
                        mine = ids[start : min(start + capacity, b)]
                        rows.append((row, piece, start - a, len(mine), zlib.crc32(mine.astype("<u4").tobytes())))
                        kept.append(mine)
                    row += 1
                of, *columns = zip(*rows, strict=True)
                arrays = [batch.column(0).take(pa.array(of, pa.int64()))]
                arrays += [pa.array(c, k) for c, k in zip(columns, (pa.int32(), *[pa.int64()] * 3), strict=True)]
                names = [c.split()[0] for c in PIECES.split(", ")]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
                    flat = pa.array(np.concatenate(kept).astype(np.int32))
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), flat))
                    names = [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return apply


def token_pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Each document's ids with ``END`` after them, in pieces of at most ``capacity`` ids.

    Only longer documents are cut. Null and empty texts have just the ``END``; rows without an id, repeated rows
    and rows with the same id are packed each for itself; other columns are not read.
    """
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return narrow.mapInArrow(_cut(tokenizer, capacity, with_ids), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: (bin and offset of every piece, number of bins)."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, n = 0, 0  # bit r is set where a bin has r ids of room
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fitting = free >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                free ^= 1 << left
        else:
            left, chosen, n = capacity, n, n + 1
        bins[k], offsets[k] = chosen, capacity - left
        if left > size:
            if not room[left - size]:
                free |= 1 << (left - size)
            room[left - size].append(chosen)
    return bins, offsets, n


def bins_needed(lengths: np.ndarray, capacity: int) -> int:
    """The best of the lower bounds that dual feasible functions give for these lengths."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    total = int((counts * sizes).sum())
    bound = -(-total // capacity)
    # sizes below e count nothing, those above capacity - e a whole bin
    half = np.arange(1, capacity // 2 + 1)
    sums, above = np.cumsum(counts * sizes), np.cumsum(counts[::-1])[::-1]
    whole = above[capacity - half + 1]
    middle = sums[capacity - half] - sums[half - 1]
    bound = max(bound, int((whole - (-middle // capacity)).max()))
    # floor((k + 1) x) / k, and x itself where (k + 1) x is whole
    for k in range(1, 64):
        steps, rest = np.divmod(sizes * (k + 1), capacity)
        value = np.where(rest == 0, sizes * k, steps * capacity)
        bound = max(bound, -(-int((counts * value).sum()) // (capacity * k)))
    return bound


PACKED = "id long, part long, bin long, offset long, fill long, bins long, bound long"


def _packed(capacity: int) -> Callable:
    def apply(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets, n = best_fit(lengths, capacity)
        fill = np.bincount(bins, lengths, n).astype(np.int64)[bins]
        rows = len(lengths)
        return pa.table(
            {
                "id": table.column("id"),
                "part": table.column("part"),
                "bin": bins,
                "offset": offsets,
                "fill": fill,
                "bins": np.full(rows, n),
                "bound": np.full(rows, bins_needed(lengths, capacity)),
            }
        )

    return apply


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) with sequence_id, offset and certified.

    Sequences are filled without gaps from 0 on. ``certified`` tells whether the part that a piece was last
    packed in needs no fewer sequences by its bound. An empty table stays empty.
    """
    scratch = Scratch(pieces.sparkSession, "packing")
    pieces = pieces.drop("sequence_id", "offset", "certified").withColumn("__id", F.monotonically_increasing_id())
    pieces = scratch.cut(pieces)
    waiting = pieces.select(F.col("__id").alias("id"), "length")
    n, first_part, done = pieces.count(), 0, None
    for turn in range(rounds):
        parts = max(1, -(-n // part_pieces))
        dealt = waiting.withColumn("part", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(parts)) + first_part)
        packed = scratch.cut(dealt.groupBy("part").applyInArrow(_packed(capacity), PACKED))
        # what may still do better: open bins of parts that miss their bound, and ill filled ones of the others
        again = (F.col("fill") < capacity) & (F.col("bins") > F.col("bound"))
        again |= F.col("fill") * 4 <= 3 * capacity
        if turn == rounds - 1 or parts == 1:
            again = F.lit(False)
        kept = packed.where(~again)
        done = kept if done is None else done.unionByName(kept)
        waiting = packed.where(again).select("id").join(waiting, "id")
        first_part += parts
        if turn == rounds - 1 or parts == 1:
            break
        waiting = scratch.cut(waiting)
        n = waiting.count()
        if not n:
            break
    placed = done.select(
        F.col("id").alias("__id"),
        (F.col("part") * (1 << 24) + F.col("bin")).alias("sequence_id"),
        "offset",
        (F.col("bins") == F.col("bound")).alias("certified"),
    )
    return pieces.join(placed, "__id").drop("__id")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``token_pieces`` of all documents, packed."""
    return pack(token_pieces(docs, tokenizer, capacity, with_ids), capacity)
