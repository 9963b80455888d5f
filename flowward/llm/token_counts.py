"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton names every vocabulary piece that ends at a character; dynamic programming carries
only the best score and its number of pieces. Text is cut before each space as the tokenizer does it, so each
distinct word is worked out once a task. Ties go as in the tokenizer: of equal scores the longest piece wins.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowward.llm.words import UNSPACED, Known, chunks, find_words, per_row, word_hashes

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
SCHEMA = "doc_id long, n_tokens long, score double"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter:
    """Best segmentations of words: their scores and numbers of pieces."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.bytes = {int(p[3:5], 16) for p, _ in pieces if len(p) == 6 and p[:3] == "<0x" and p[5] == ">"}
        self.known = Known(self._solve, [np.int64, np.float64], limit=1 << 21)

    def count(self, text: str) -> tuple[float, int]:
        """(score, pieces) of one word that begins with ``SPACE``."""
        n = len(text)
        best, pieces, single = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        runs = [0] * (n + 1)  # bytes of the unknown run that ends here
        whole = [True] * (n + 1)
        done = 0
        for last, (length, score) in self.auto.iter(text):
            end = last + 1
            while done < last:
                done += 1
                if not single[done]:
                    self._unknown_at(done, text, best, pieces, runs, whole)
            if length == 1:
                single[end] = True
            reached = best[end - length] + score
            if best[end] is None or reached > best[end]:
                best[end], pieces[end], runs[end] = reached, pieces[end - length] + 1, 0
        while done < n:
            done += 1
            if not single[done]:
                self._unknown_at(done, text, best, pieces, runs, whole)
        return best[n], pieces[n]

    def _unknown_at(self, end: int, text: str, best: list, pieces: list, runs: list, whole: list) -> None:
        """A character that is no piece: its bytes, or one unknown piece a run if some byte is no piece either."""
        reached = best[end - 1] + self.unknown
        if best[end] is not None and reached <= best[end]:
            return
        raw = text[end - 1].encode("utf-8", "replace")
        before = runs[end - 1]
        ok = (whole[end - 1] if before else True) and all(b in self.bytes for b in raw)
        earlier = pieces[end - 1] - ((before if whole[end - 1] else 1) if before else 0)
        best[end], runs[end], whole[end] = reached, before + len(raw), ok
        pieces[end] = earlier + (runs[end] if ok else 1)

    def _solve(self, words: list[str]) -> list[list]:
        found = [self.count(SPACE + w) for w in words]
        return [[p for _, p in found], [s for s, _ in found]]

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of tokens, scores) of the texts."""
        lone_score, lone_count = self.count(SPACE)
        marked = SPACE.encode()
        for texts in chunks(column):
            if marked in texts.data.tobytes():  # the mark itself counts as a space
                rows = [texts.text(r).replace(SPACE, " ") for r in range(len(texts.offsets) - 1)]
                texts = next(chunks(pa.array(rows, pa.string()), limit=1 << 40))
            words = find_words(texts, UNSPACED)
            place, which = self.known.rows(texts, words, word_hashes(texts, words, lower=False))
            counts, scores = (c[place][which] for c in self.known.columns)
            filled = np.diff(texts.offsets) > 0
            head = np.zeros(len(filled), bool)
            head[filled] = texts.data[texts.offsets[:-1][filled]] != 0x20
            # a space before each word belongs to it; other spaces stand alone
            lone = per_row(texts.data == 0x20, texts.offsets) + head - words.counts
            score = np.bincount(np.repeat(np.arange(len(lone)), words.counts), scores, len(lone))
            yield per_row(counts, words.bounds) + lone * lone_count, score + lone * lone_score


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def _counted(path: str) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            parts = list(counter.texts(batch.column(1)))
            if parts:
                tokens, scores = (np.concatenate(p) for p in zip(*parts, strict=True))
                arrays = [batch.column(0), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "score"])

    return apply


def count_tokens(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) of every text, one row per input row.

    The tokenizer is the unigram model with the pieces and scores of the file ``model``: spaces become U+2581,
    one is put before a text that begins without, text is cut before each, characters that are no piece become
    their bytes. Null and empty texts have no tokens and score 0. Repeated rows are counted each; a null id
    stays null; other columns are not read.
    """
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_counted(model), SCHEMA)
