"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A permutation of all shingles gives two values of a document's signature: its least and its greatest
hash. Bands of the signature propose pairs; every link is confirmed on the two full sets before it
counts. Documents with equal sets are one node from the start. Inside a bucket nodes are compared with
one hub; of the others only those pairs are compared that are still apart and differ from the hub in the
same elements, so that a group of copies costs its size and not its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowward.llm.components import connected
from flowward.llm.scratch import Scratch
from flowward.llm.words import (
    SPACED,
    Texts,
    Words,
    chunks,
    find_words,
    mix,
    window_hashes,
    window_starts,
    word_hashes,
)


@dataclass(frozen=True)
class Shape:
    """``width`` words a shingle; linked at ``percent`` similarity; ``bands`` of ``rows`` values each.

    With 64 bands of 6 a pair of similarity 0.75 goes unseen with a probability of 4 in a million, one of
    0.8 with 5 in a billion. ``bands * rows / 2`` permutations are evaluated.
    """

    width: int = 5
    percent: int = 75
    bands: int = 64
    rows: int = 6
    seed: int = 11


def shingle_hashes(texts: Texts, words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles in their order, and the rows' bounds."""
    hashes = word_hashes(texts, words, lower=True)
    counts = words.counts
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(bounds[-1], np.uint64)
    long = window_hashes(hashes, width)
    row = np.repeat(counts >= width, n)
    out[row] = long[window_starts(words, width)[: len(long)]]
    for short in range(1, width):
        at = np.flatnonzero(counts == short)
        if len(at):
            out[bounds[at]] = window_hashes(hashes, short)[words.bounds[at]]
    return out, bounds


def signatures(shingles: np.ndarray, bounds: np.ndarray, shape: Shape) -> np.ndarray:
    """Least and greatest hash under each permutation, a row per non-empty set."""
    rng = np.random.default_rng(shape.seed)
    n = shape.bands * shape.rows // 2
    factors = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((2 * n, len(starts)), np.uint32)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    step = 1 << 16
    # runs of rows that stay in the processor's cache
    first = 0
    ends = np.append(starts[1:], len(values))
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + step, "right")))
        part = values[starts[first] : ends[last - 1]]
        at = starts[first:last] - starts[first]
        for k in range(n):
            hashed = part * factors[k]
            hashed += shifts[k]
            np.minimum.reduceat(hashed, at, out=out[k, first:last])
            np.maximum.reduceat(hashed, at, out=out[n + k, first:last])
        first = last
    return out.T


def band_keys(signature: np.ndarray, shape: Shape) -> np.ndarray:
    """A 64-bit key per band; bands are of least values, or of greatest ones."""
    banded = signature.reshape(len(signature), shape.bands, shape.rows).astype(np.uint64)
    factors = np.random.default_rng(shape.seed + 1).integers(0, 1 << 62, shape.rows, dtype=np.uint64)
    factors = factors * np.uint64(2) + np.uint64(1)
    return mix((banded * factors).sum(axis=2, dtype=np.uint64) + np.arange(shape.bands, dtype=np.uint64))


def _distinct(shingles: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(shingles[a:b])


def _set_key(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


#: Bytes of a run of texts: its shingles and signatures take many times their room.
RUN_BYTES = 1 << 20

FEATURES = "doc_id long, text_key string, n_shingles long, set_key binary, bands array<long>"


def _featured(shape: Shape) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in chunks(batch.column(2), RUN_BYTES):
                words = find_words(texts, SPACED)
                shingles, bounds = shingle_hashes(texts, words, shape.width)
                sets = list(_distinct(shingles, bounds))
                keys = band_keys(signatures(shingles, bounds, shape), shape).view(np.int64)
                filled = np.diff(bounds) > 0
                offsets = np.concatenate([[0], np.cumsum(filled * shape.bands)]).astype(np.int32)
                part = batch.slice(texts.first, texts.last - texts.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_set_key(s) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                    ],
                    ["doc_id", "text_key", "n_shingles", "set_key", "bands"],
                )

    return apply


def _sets(shape: Shape) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in chunks(batch.column(0), RUN_BYTES):
                words = find_words(texts, SPACED)
                sets = list(_distinct(*shingle_hashes(texts, words, shape.width)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_set_key(s) for s in sets], pa.binary()),
                        pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()),
                    ],
                    ["set_key", "members"],
                )

    return apply


STARS = "hub long, node long, linked boolean, differing long, n long, hub_n long, differences array<long>"
LINKS = "a long, b long"


def _pair_sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
        yield tuple(np.frombuffer(x.as_buffer(), "<u8") for x in (a, b))


def _linked(shape: Shape, differing: int, total: int) -> bool:
    """Whether sets of ``total`` elements together, ``differing`` of them in one only, are similar enough."""
    return 100 * (total - differing) >= shape.percent * (total + differing)


def _against_hub(shape: Shape) -> Callable:
    """Exact comparison of hubs and members; the differing elements are given where others will need them."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, differing, sizes, lists = [], [], [], []
            for (hub, member), alone in zip(_pair_sets(batch), batch.column("alone").to_pylist(), strict=True):
                different = np.setxor1d(hub, member, assume_unique=True)
                linked.append(_linked(shape, len(different), len(hub) + len(member)))
                differing.append(len(different))
                sizes.append((len(member), len(hub)))
                lists.append(different[:0] if alone else different)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *lists]).astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("a"),
                    batch.column("b"),
                    pa.array(linked, pa.bool_()),
                    pa.array(differing, pa.int64()),
                    pa.array([s[0] for s in sizes], pa.int64()),
                    pa.array([s[1] for s in sizes], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                [c.split()[0] for c in STARS.split(", ")],
            )

    return apply


def _similar_pairs(shape: Shape) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                _linked(shape, len(np.setxor1d(a, b, assume_unique=True)), len(a) + len(b)) for a, b in _pair_sets(batch)
            ]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return apply


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("text_key"), text.alias("text"))


class NearDuplicates:
    """One run over ``docs``: ``classes()`` gives each row's class, ``links`` confirmed pairs of nodes."""

    def __init__(self, docs: DataFrame, shape: Shape = Shape()):
        self.shape = shape
        self.docs = _narrow(docs)
        self.scratch = Scratch(docs.sparkSession, "near-dups")
        features = self.scratch.cut(self.docs.mapInArrow(_featured(shape), FEATURES))
        self.nodes = self._numbered(features)
        self.features = features.drop("bands")
        members = self._members()
        stars = self._stars(members)
        self.scratch.drop(members)
        direct = stars.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
        self.links = direct.unionByName(self._left_apart(stars, connected(direct, self.scratch)))

    def _numbered(self, features: DataFrame) -> DataFrame:
        """Distinct sets as numbered nodes; ``first_id`` is the least id of their documents."""
        sets = features.where("set_key is not null").groupBy("set_key")
        nodes = sets.agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        return self.scratch.cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    def _members(self) -> DataFrame:
        """(band, node, n, hub) of all buckets of two nodes or more.

        The hub is the node that meets most others, over all its bands: the one a group of copies is made of.
        """
        banded = self.nodes.select("node", F.explode("bands").alias("band"))
        # sums are written before they are joined, so that Spark can split a bucket that many nodes share
        sizes = self.scratch.cut(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"))
        met = self.scratch.cut(banded.join(sizes, "band"))
        scores = met.groupBy("node").agg(F.sum(F.col("size") - 1).alias("score"))
        scored = met.join(scores, "node")
        hubs = scored.groupBy("band").agg(F.max(F.struct("score", -F.col("node"))).alias("hub"))
        hubs = self.scratch.cut(hubs.select("band", (-F.col("hub.col2")).alias("hub")))
        members = self.scratch.cut(met.select("band", "node").join(hubs, "band"))
        self.scratch.drop(sizes, met, hubs)
        return members

    def _with_sets(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with both full sets; of all texts, those of the pairs' nodes are read again."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = self.scratch.cut(self.nodes.join(wanted, "node", "left_semi").select("node", "set_key", "first_id"))
        ids = wanted.select(F.col("first_id").alias("wanted_id")).distinct()
        texts = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
        sets = texts.mapInArrow(_sets(self.shape), "set_key binary, members binary")
        sets = self.scratch.cut(sets.join(wanted, "set_key").select("node", "members").dropDuplicates(["node"]))
        self.scratch.drop(wanted)
        self.sets = sets
        return pairs.join(sets.toDF("b", "members_b"), "b").join(sets.toDF("a", "members_a"), "a")

    def _stars(self, members: DataFrame) -> DataFrame:
        """Every hub against the nodes of its buckets."""
        pairs = members.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        pairs = self.scratch.cut(pairs)
        alone = self.scratch.cut(pairs.groupBy("a").agg((F.count("*") < 2).alias("alone")))
        compared = self._with_sets(pairs.join(alone, "a")).mapInArrow(_against_hub(self.shape), STARS)
        stars = self.scratch.cut(compared)
        self.scratch.drop(pairs, alone, self.sets)
        return stars

    def _left_apart(self, stars: DataFrame, labels: DataFrame) -> DataFrame:
        """Links between nodes of one bucket that the hub does not bring together; exact.

        Let D be the elements in which a node differs from the hub. Two nodes of n and n' elements are linked
        only if their D share at least k = (|D| + |D'| - (1 - s) / (1 + s) (n + n')) / 2 elements, at similarity
        s, and k is positive where one of them is not linked with the hub. So, with elements in the order of how
        few nodes of the hub have them, the first |D| - k + 1 of each must meet, and early enough for k of them.

        Only elements in which different components meet count. Where they do, nodes outside the element's largest
        component are compared with all others; the nodes of that one are not compared with each other.
        """
        share = (100 - self.shape.percent) / (100 + self.shape.percent)
        known = stars.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        known = known.select("hub", "node", "component", "linked", F.col("differing").alias("d"), "n", "hub_n", "differences")
        found = known.withColumn("e", F.explode("differences")).drop("differences")
        parts = found.groupBy("hub", "e", "component").agg(F.count("*").alias("size"))
        main = F.max(F.struct("size", "component"))["component"].alias("main")
        seen = parts.groupBy("hub", "e").agg(F.sum("size").alias("df"), F.count("*").alias("parts"), main)
        seen = self.scratch.cut(seen.where("parts > 1").drop("parts"))
        shared = found.join(seen, ["hub", "e"])
        kept = shared.withColumn("rest", F.count("*").over(Window.partitionBy("hub", "node")))
        order = Window.partitionBy("hub", "node").orderBy("df", "e")
        placed = kept.withColumn("pos", F.row_number().over(order) - 1)
        # elements that no other component has stand before all these
        placed = placed.withColumn("pos", F.col("pos") + F.col("d") - F.col("rest"))
        most = F.floor((F.col("d") + (F.col("n") - F.col("hub_n")) * share) / 2) + 1
        most = F.when(F.col("linked"), most).otherwise(F.greatest(most, F.floor(F.col("n") * (100 / self.shape.percent - 1)) + 2))
        placed = placed.where(F.col("pos") < most)
        placed = self.scratch.cut(placed.select("hub", "e", "node", "d", "n", "pos", "component", "main"))
        x, y = placed.where("component != main").alias("x"), placed.alias("y")
        need = (F.col("x.d") + F.col("y.d") - (F.col("x.n") + F.col("y.n")) * share) / 2
        room = 1 + F.least(F.col("x.d") - F.col("x.pos") - 1, F.col("y.d") - F.col("y.pos") - 1)
        sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * self.shape.percent
        pairs = x.join(
            y,
            (F.col("x.hub") == F.col("y.hub"))
            & (F.col("x.e") == F.col("y.e"))
            & (F.col("x.component") != F.col("y.component"))
            & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
            & (room + 1e-6 >= need)
            & sizes,
        )
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        pairs = self.scratch.cut(pairs)
        links = self.scratch.cut(self._with_sets(pairs).mapInArrow(_similar_pairs(self.shape), LINKS))
        self.scratch.drop(seen, placed, pairs, self.sets)
        return links

    def classed(self) -> DataFrame:
        """Each row's class with the class's node; texts without words have no node."""
        labels = connected(self.links, self.scratch)
        nodes = self.nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = self.scratch.cut(nodes.groupBy("component").agg(F.min("first_id").alias("component_id")))
        named = nodes.join(least, "component").select("set_key", "component_id", "component")
        filled = self.features.join(named, "set_key").select("doc_id", "text_key", "n_shingles", "component_id", "component")
        empty = self.features.where("set_key is null")
        nothing = F.lit(None).cast("long").alias("component")
        empty = empty.select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), nothing)
        return filled.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    def classes(self) -> DataFrame:
        return self.classed().drop("component")


def near_duplicates(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Each row's class of near-duplicates: doc_id, text_key, n_shingles, component_id and kept.

    Words stand between white space, A-Z count as a-z. Texts without words (null and empty ones too) have no
    shingles and are linked with nothing; under five words the whole text is one shingle. ``component_id`` is the
    least doc_id of the class and ``kept`` marks its document. Rows with equal id and text are one document: they
    get the same answer. Rows without an id take part; a class with none but such has a null component_id, and all
    of them are kept. Other columns are not read; an empty table gives an empty result.
    """
    return NearDuplicates(docs, shape).classes()


def drop_near_duplicates(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates, with all its columns as they were.

    It is a row of the class's least doc_id, of a class without ids any; of several texts with that id the one with
    the least digest, and of rows equal in id and text one. Texts without words are no class: rows with an id and
    such a text stay once for each text, rows with neither all stay.
    """
    run = NearDuplicates(docs, shape)
    documents = run.classed().groupBy("doc_id", "text_key", "component").agg(
        F.count("*").alias("rows"), F.first("kept").alias("kept")
    )
    documents = run.scratch.cut(documents)
    of_class = documents.where("kept and component is not null")
    least = of_class.groupBy("component").agg(F.min("text_key").alias("least_key"))
    judged = documents.join(least, "component", "left").select(
        F.col("doc_id").alias("__id"),
        F.col("text_key").alias("__key"),
        (F.col("component").isNull() | (F.col("kept") & (F.col("text_key") == F.col("least_key")))).alias("__stays"),
        ((F.col("rows") > 1) & (F.col("doc_id").isNotNull() | F.col("component").isNotNull())).alias("__repeated"),
    )
    judged = run.scratch.cut(judged.where("not __stays or __repeated"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.md5(F.col("text").cast("string")).eqNullSafe(F.col("__key"))
    repeated = judged.where("__stays")
    if repeated.isEmpty():
        return docs.join(judged, same, "left_anti")
    number = "__row"
    while number in {c.lower() for c in docs.columns}:
        number += "_"
    # numbers are settled by writing: a task that runs again gives its rows the same ones
    rows = docs.join(repeated, same, "left_semi").withColumn(number, F.monotonically_increasing_id())
    rows = run.scratch.cut(rows)
    firsts = rows.groupBy(F.col("doc_id").cast("long"), F.md5(F.col("text").cast("string"))).agg(F.min(number).alias("__first"))
    once = rows.join(firsts.select("__first"), F.col(number) == F.col("__first"), "left_semi").drop(number)
    return docs.join(judged, same, "left_anti").unionByName(once)
