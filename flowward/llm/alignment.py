"""Tokens of two tokenizers on the same text, aligned by byte ranges.

Each batch is encoded on both sides into frames of (document, first byte). An as-of merge gives every token start
the other side's covering token; the union of both directions is all overlapping pairs, equal ends close groups.
How many documents hold a pair is counted over the corpus; the most frequent pairs go back to the documents from a
table of bounded size, all others through a shuffled join.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowward.llm.bpe import most_frequent, piece_bytes
from flowward.llm.scratch import Scratch
from flowward.llm.words import Known, Texts, byte_class, chunks, cut_before, gather, per_row, word_hashes

#: Pairs that are joined by broadcast: at most so many rows of three longs.
HOT_PAIRS = 1 << 18
RUN_BYTES = 2 << 20
SPACE = byte_class((0x20, 0x20))
MARK = "▁"

ALIGNED = (
    "doc_id long, n_a long, n_b long, groups array<struct<a: array<int>, b: array<int>>>, "
    "n_links long, pairs array<struct<a: int, b: int, n: int>>"
)


def _lengths(pieces: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(pieces) + 1, np.int64)
    for i, raw in pieces.items():
        out[i] = len(raw)
    return out


class Side:
    """One tokenizer: the ids of words that begin with a space, and the bytes of its ids."""

    pieces: dict[int, bytes]

    def ids(self, words: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def solve(self, words: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """(ids by word, which words their bytes give back)."""
        found = self.ids(words)
        whole = [b"".join(map(self.pieces.__getitem__, f)) == w.encode() for f, w in zip(found, words, strict=True)]
        return found, np.array(whole, bool)


class ByteSide(Side):
    """A byte-level BPE file; the texts of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces = piece_bytes(path)

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


class PieceSide(Side):
    """A sentencepiece BPE model, which itself puts a space before what it encodes."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.pieces[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(MARK, " ").encode()

    def ids(self, words: list[str]) -> list[list[int]]:
        # the encoder gives no token for the empty text, though it puts its space before any other
        lone = self.model.piece_to_id(MARK)
        return [found if w != " " else [lone] for w, found in zip(words, self.model.encode([w[1:] for w in words]), strict=True)]


class Aligner:
    """Both sides of whole texts; each distinct word is encoded once a task.

    Neither tokenizer joins across the start of a run of spaces, so a text's ids are its words' ids in turn.
    """

    def __init__(self, a: str, b: str):
        self.sides = (ByteSide(a), PieceSide(b))
        self.lengths = [_lengths(s.pieces) for s in self.sides]
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.known = Known(self._solve, [np.int64, np.int64, np.int64, np.int64, bool], limit=1 << 20)

    def _solve(self, words: list[str]) -> list[np.ndarray]:
        if not len(self.known.keys):
            self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        columns, whole = [], np.ones(len(words), bool)
        for k, side in enumerate(self.sides):
            found, ok = side.solve(words)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            columns += [len(self.flat[k]) + np.cumsum(counts) - counts, counts]
            self.flat[k] = np.concatenate([self.flat[k], *[np.array(f, np.int32) for f in found]])
            whole &= ok
        return [*columns, whole]

    def tokens(self, texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
        """By side (ids of all texts in turn, bounds by text); a text that either side does not give back has none."""
        words = cut_before(texts, SPACE)
        place, which = self.known.rows(texts, words, word_hashes(texts, words, lower=False))
        a_start, a_count, b_start, b_count, whole = (c[place][which] for c in self.known.columns)
        broken = per_row(~whole, words.bounds) > 0
        kept = ~np.repeat(broken, words.counts)
        out = []
        for flat, starts, counts in zip(self.flat, (a_start, b_start), (a_count, b_count), strict=True):
            sizes = per_row(np.where(kept, counts, 0), words.bounds)
            out.append((gather(flat, starts[kept], counts[kept]), np.concatenate([[0], np.cumsum(sizes)])))
        return out

    def align(self, doc_ids: pa.Array, texts: Texts) -> pa.RecordBatch:
        """One row of ``ALIGNED`` by text; ``texts`` have their leading space."""
        rows = np.arange(len(doc_ids))
        frames, ends = [], []
        (a, a_bounds), (b, b_bounds) = self.tokens(texts)
        for ids, bounds, lengths in ((a, a_bounds, self.lengths[0]), (b, b_bounds, self.lengths[1])):
            end = np.cumsum(lengths[ids])
            frames.append(pd.DataFrame({"doc": np.repeat(rows, np.diff(bounds)), "at": end - lengths[ids], "token": np.arange(len(ids))}))
            ends.append(end)
        first, second = frames
        # bytes are counted through the whole batch, so that both frames are sorted by place
        over_a = pd.merge_asof(first, second, on="at", by="doc", suffixes=("_a", "_b"))
        over_b = pd.merge_asof(second, first, on="at", by="doc", suffixes=("_b", "_a"))
        covering = over_b["token_a"].to_numpy(np.int64)
        inner = first["at"].to_numpy()[covering] != second["at"].to_numpy()  # equal starts are in both directions
        link_a = np.concatenate([over_a["token_a"].to_numpy(np.int64), covering[inner]])
        link_b = np.concatenate([over_a["token_b"].to_numpy(np.int64), over_b["token_b"].to_numpy(np.int64)[inner]])
        link_doc = np.concatenate([over_a["doc"].to_numpy(np.int64), over_b["doc"].to_numpy(np.int64)[inner]])
        n_links = np.bincount(link_doc, minlength=len(rows)).astype(np.int64)

        shared = np.intersect1d(ends[0], ends[1], assume_unique=True)
        a_cuts = np.searchsorted(ends[0], shared) + 1
        b_cuts = np.searchsorted(ends[1], shared) + 1
        group_bounds = np.searchsorted(a_cuts, a_bounds, "right")
        groups = pa.StructArray.from_arrays([_lists(a, a_cuts), _lists(b, b_cuts)], ["a", "b"])

        width = len(self.lengths[1])
        code = (link_doc * len(self.lengths[0]) + a[link_a]) * width + b[link_b]
        code, n = np.unique(code, return_counts=True)
        doc, pair = np.divmod(code, len(self.lengths[0]) * width)
        ids_a, ids_b = np.divmod(pair, width)
        fields = [pa.array(x.astype(np.int32)) for x in (ids_a, ids_b, n)]
        pairs = pa.StructArray.from_arrays(fields, ["a", "b", "n"])
        arrays = [
            doc_ids,
            pa.array(np.diff(a_bounds)),
            pa.array(np.diff(b_bounds)),
            _listed(groups, group_bounds),
            pa.array(n_links),
            _listed(pairs, np.searchsorted(doc, np.arange(len(rows) + 1))),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_a", "n_b", "groups", "n_links", "pairs"])


def _listed(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _lists(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return _listed(pa.array(ids), np.concatenate([[0], cuts]))


@functools.lru_cache(maxsize=2)
def _aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def _aligned(a: str, b: str) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a, b)
        for batch in batches:
            for texts in chunks(batch.column(1), RUN_BYTES):
                yield aligner.align(batch.column(0).slice(texts.first, texts.last - texts.first), texts)

    return apply


def align_tokens(
    docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each text's tokens by ``a`` (byte-level BPE of space and text) and ``b`` (a sentencepiece BPE model), aligned.

    One row per input row: the numbers ``n_a`` and ``n_b`` of tokens, ``groups`` of all their ids in order, cut where
    tokens of both sides end, ``n_links`` pairs of tokens whose bytes overlap, and ``pairs`` (a, b, n), the distinct linked ids with their
    numbers of links. A text that is null, empty or not given back byte by byte by both sides has no tokens. Repeated
    rows are aligned each, a null id stays null, other columns are not read, an empty table stays empty.
    """
    a = a or public_tokenizers.path("byte_bpe_50k.json")
    b = b or public_tokenizers.path("piece_bpe_32k.model")
    text = F.col(text_col).cast("string")
    spaced = F.when(F.length(text) > 0, F.concat(F.lit(" "), text))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), spaced.alias("text")).mapInArrow(_aligned(a, b), ALIGNED)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, docs, best): in how many rows of ``pairs`` (a, b) stands, and whether no other pair of that a has more."""
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("docs"))
    # as many rows a window as the other side has ids
    return counted.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def alignment_digests(
    docs: DataFrame, a: str | None = None, b: str | None = None, hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of ``align_tokens``.

    ``count_sum`` sums over a text's links how many texts hold the link's pair of ids; ``n_best`` are the links whose
    pair is the most frequent one of its first id. Texts without tokens have zeros and an empty digest.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    # Spark writes [{"a":[1,2],"b":[3]},{"a":[4],"b":[5]}] in one go; an expression evaluated on each group takes twice as long
    listed = F.to_json("groups")
    for written, sign in ((']},{"a":[', ";"), ('],"b":[', "|"), ('[{"a":[', ""), ("]}]", "")):
        listed = F.replace(listed, F.lit(written), F.lit(sign))
    narrow = align_tokens(docs, a, b).select(
        "doc_id",
        "n_a",
        "n_b",
        F.size("groups").cast("long").alias("n_groups"),
        "n_links",
        F.when(F.size("groups") > 0, F.sha2(listed, 256)).otherwise("").alias("groups_sha256"),
        "pairs",
    )
    narrow = scratch.cut(narrow.withColumn("row", F.monotonically_increasing_id()), compression="zstd")
    pairs = narrow.select("row", F.inline("pairs"))
    counts = scratch.cut(pair_counts(pairs))
    hot = F.broadcast(most_frequent(counts, hot_pairs, count="docs"))  # hot_pairs rows at most
    sums = (
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("docs")).alias("count_sum"),
    )
    known = pairs.join(hot, ["a", "b"]).groupBy("row").agg(*sums)
    others = pairs.join(hot, ["a", "b"], "left_anti").join(counts, ["a", "b"]).groupBy("row").agg(*sums)
    both = known.unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = narrow.drop("pairs").join(both, "row", "left")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        "groups_sha256",
    )
