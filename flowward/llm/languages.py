"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit a binary classifier on hashed byte n-grams tells languages
with a one from those with a zero; decoding sums the loss of each bit, weighted by how often its
classifier is right, and takes the nearest codeword. A second codeword nearly as near marks ambiguity.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowward.llm.words import Texts, byte_class, chunks

BINS = 1 << 14
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, runner_up string, ambiguous boolean"


@dataclass(frozen=True)
class Model:
    """``codes`` a row of +1 and -1 per language; ``weights`` a row per bit over all bins and one that is not used."""

    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


def _letters() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    for low, up in zip(range(0x61, 0x7B), range(0x41, 0x5B), strict=True):
        table[low] = table[up] = low
    return table


_LETTER = _letters()
_ASCII_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
_BEYOND = byte_class((0x80, 0xFF))


def gram_bins(texts: Texts) -> list[np.ndarray]:
    """The bin of the two and of the three bytes that begin at each byte; ``BINS`` where they leave the text.

    Letters count in lower case, and whatever is no letter as a space.
    """
    data = _LETTER[texts.data].astype(np.uint32)
    spare = np.full(len(data), BINS, np.int64)
    code, out = data.copy(), []
    for width in (2, 3):
        code = code[:-1] * np.uint32(0x01000193) if len(code) else code
        code = code ^ data[width - 1 :][: len(code)]
        bins = spare.copy()
        mixed = code * np.uint32(0x9E3779B1)
        bins[: len(code)] = mixed >> np.uint32(18)
        for back in range(1, width):
            at = texts.offsets[1:] - back
            bins[at[at >= texts.offsets[:-1]]] = BINS
        blank = data[: len(code)] == 0x20
        for k in range(1, width):
            blank &= data[k : k + len(code)] == 0x20
        bins[: len(code)][blank] = BINS
        out.append(bins)
    return out


def has_letter(texts: Texts) -> np.ndarray:
    ascii_letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[texts.data])])[texts.offsets]
    found = np.diff(ascii_letters) > 0
    beyond = np.concatenate([[0], np.cumsum(_BEYOND[texts.data])])[texts.offsets]
    for row in np.flatnonzero(~found & (np.diff(beyond) > 0)):
        found[row] = any(c.isalpha() for c in texts.text(row))
    return found


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """All two-sided splits of up to seven languages; random codewords for more."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 7:
        bits = [b for b in itertools.product((1, -1), repeat=n) if b[0] == 1 and -1 in b]
        return np.array(bits, float).T
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        codes = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        if np.any(np.abs(codes.sum(axis=0)) == n):
            continue
        apart = (codes.shape[1] - codes @ codes.T) / 2 + np.eye(n) * codes.shape[1]
        if apart.min() > far:
            best, far = codes, apart.min()
    return best


def bit_weights(counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Log odds of each bin, every language weighing the same; ``counts`` a row per language."""
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    rows = []
    for bit in codes.T:
        rows.append(np.log(shares[bit > 0].mean(axis=0)) - np.log(shares[bit < 0].mean(axis=0)))
    weights = np.zeros((codes.shape[1], BINS + 1), np.float32)
    if rows:
        weights[:, :BINS] = rows
    return weights


def margins(texts: Texts, weights: np.ndarray) -> np.ndarray:
    """Each bit's summed log odds over the root of the number of n-grams, a row per text."""
    grams = gram_bins(texts)
    rows = len(texts.offsets) - 1
    out, used = np.zeros((rows, len(weights))), np.zeros(rows)
    for bins in grams:
        used += np.diff(np.concatenate([[0], np.cumsum(bins < BINS)])[texts.offsets])
        for k, weight in enumerate(weights):
            out[:, k] += np.diff(np.concatenate([[0.0], np.cumsum(weight[bins], dtype=np.float64)])[texts.offsets])
    return out / np.sqrt(np.maximum(used, 1))[:, None]


def decode(margin: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest codeword, its share against all others, the next nearest)."""
    loss = np.zeros((len(margin), len(model.langs)))
    for k, trust in enumerate(model.trust):
        loss += trust * np.logaddexp(0, -margin[:, k, None] * model.codes[None, :, k])
    order = np.argsort(loss, axis=1, kind="stable")
    shares = np.exp(loss.min(axis=1, keepdims=True) - loss)
    score = 1 / shares.sum(axis=1)
    return order[:, 0], score, order[:, min(1, len(model.langs) - 1)]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per language and bin of a task; given out in between where there are very many languages."""
    sums: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for name, total in sums.items():
            at = np.flatnonzero(total)
            columns = [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bin", "n"])
        sums.clear()

    for batch in batches:
        names = batch.column(0).to_pylist()
        for texts in chunks(batch.column(1)):
            mine = names[texts.first : texts.last]
            local = {name: k for k, name in enumerate(dict.fromkeys(mine))}
            of_byte = np.repeat([local[n] for n in mine], np.diff(texts.offsets))
            total = np.zeros(len(local) * (BINS + 1), np.int64)
            for bins in gram_bins(texts):
                total += np.bincount(of_byte * (BINS + 1) + bins, minlength=len(total))
            for name, k in local.items():
                found = total[k * (BINS + 1) : (k + 1) * (BINS + 1) - 1]
                sums[name] = sums[name] + found if name in sums else found
        if len(sums) > 256:
            yield from rows()
    yield from rows()


def _right_bits(model: Model) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: k for k, name in enumerate(model.langs)}
        right, n = np.zeros(len(model.codes[0]), np.int64), 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for texts in chunks(batch.column(1)):
                truth = model.codes[[place[m] for m in names[texts.first : texts.last]]]
                right += (margins(texts, model.weights) * truth > 0).sum(axis=0)
                n += len(truth)
        columns = [pa.array(np.arange(len(right)), pa.int32()), pa.array(right, pa.int64()), pa.array([n] * len(right), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["bit", "right", "n"])

    return apply


def train(rows: DataFrame, max_langs: int = 256) -> Model:
    """A model from all rows (lang, text) with a language; more than ``max_langs`` languages are refused.

    The driver gets one count per language and bin. No rows give a model without languages.
    """
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    counted = rows.mapInArrow(_gram_counts, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = counted.limit(max_langs * BINS + 1).toPandas()
    langs = sorted(table["lang"].unique())
    if len(langs) > max_langs:
        raise ValueError(f"More than {max_langs} languages")
    counts = np.zeros((len(langs), BINS))
    counts[np.searchsorted(langs, table["lang"].to_numpy(str)) if langs else [], table["bin"].to_numpy(int)] = table["n"]
    codes = codewords(len(langs))
    model = Model(langs, codes, bit_weights(counts, codes), np.ones(codes.shape[1]))
    if codes.shape[1] == 0:
        return model
    right = rows.mapInArrow(_right_bits(model), "bit int, right long, n long")
    sums = right.groupBy("bit").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).toPandas().sort_values("bit")
    # log odds of a right answer, as in boosting; a classifier no better than chance counts nothing
    share = np.clip((sums["right"] + 1) / (sums["n"] + 2), 0.5, 0.999).to_numpy()
    return Model(langs, codes, model.weights, np.log(share / (1 - share)) / 2)


def _identified(model: Model, least_gap: float) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            for texts in chunks(batch.column(2)):
                known = has_letter(texts) & (len(model.langs) > 0)
                if model.langs:
                    best, score, second = decode(margins(texts, model.weights), model)
                else:
                    best = second = np.zeros(len(known), int)
                    score = np.zeros(len(known))
                part = batch.slice(texts.first, texts.last - texts.first)
                other = np.where(known & (second != best), second, len(model.langs))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(names[np.where(known, best, len(model.langs))], pa.string()),
                        pa.array(np.where(known, score, 0.0), pa.float64()),
                        pa.array([names[k] if k < len(model.langs) else None for k in other], pa.string()),
                        pa.array(known & (score < least_gap), pa.bool_()),
                    ],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )

    return apply


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The fold that is never learnt from; a row without an id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: Model | None = None, sure: float = 0.9) -> DataFrame:
    """The language of every text, one row per input row; without a ``model`` it learns from the rows of the other folds.

    A null text, or one without a letter, is ``und`` with score 0, and so is all if there was nothing to learn from.
    ``score`` is the nearest codeword's share of all, ``ambiguous`` is a score under ``sure``. Repeated rows get the
    same answer, rows without an id are judged but not learnt from; languages are never read for a prediction.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")
    )
    if model is None:
        model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return narrow.mapInArrow(_identified(model, sure), SCHEMA)
