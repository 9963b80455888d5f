"""Fitting of MLlib's random forest: counts by numpy over blocks of binned rows, level by level, for many trees at once."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowward.session import cut_lineage, discard, remove_path, scratch_path

#: MLlib's number of bins a feature.
BINS = 32
#: And of classes.
CLASSES = 100
#: Rows of a block, and rows that are counted at once.
BLOCK, AT_ONCE = 1 << 16, 1 << 20
#: Counts of 32 bits that a task holds, and nodes whose counts are one row of the shuffle.
CELLS, NODES = 1 << 25, 512

_COUNTS = "tree int, part int, width int, counts binary"
_SPLITS = "tree int, part int, splits binary"
_NODES = """treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint,
    gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"""


@dataclass
class _Level:
    """Nodes of one tree and depth: feature and last bin of the left side (-1 for a leaf), children's places a level below."""

    counts: np.ndarray
    feature: np.ndarray = field(default=None)
    last: np.ndarray = field(default=None)
    gain: np.ndarray = field(default=None)
    #: Of the nodes to split at this level: their places, and by side the number of the child among those to split, or -1.
    open: np.ndarray = field(default=None)
    below: np.ndarray = field(default=None)
    #: Place of the left child, -1 for a leaf.
    kids: np.ndarray = field(default=None)


def fit_forest(df: DataFrame, features: Sequence[str], label: str, trees: int, depth: int, seed: int) -> PipelineModel:
    """MLlib's forest by MLlib's rules: Poisson draws of rows for each tree, Gini gain, a new draw of features at every
    node, at most 32 bins a feature, leaves of one parent that agree are joined.

    Every row is read for every level. Bins end at exact middles up to 32 distinct values and at approximate
    quantiles of all rows beyond. Features must be numbers; a label that is no class is refused.
    """
    spark = df.sparkSession
    rows = df.select(*[F.col(f"`{f}`").cast("double").alias(f"_{i}") for i, f in enumerate(features)], F.col(f"`{label}`").cast("double").alias("y"))
    rows = cut_lineage(rows, "forest")
    try:
        ends, classes = _bins(rows, len(features))
        blocks = cut_lineage(rows.mapInArrow(_binned(ends), "block bigint, n bigint, x binary, y binary"), "forest")
    finally:
        discard(rows)
    try:
        grown = _grown(blocks, len(features), classes, trees, depth, seed)
    finally:
        discard(blocks)
    one = spark.range(classes).select(*[F.lit(0.0).alias(f) for f in features], F.col("id").cast("double").alias(label))
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return PipelineModel([assembler, _as_model(spark, forest.fit(assembler.transform(one)), grown, ends)])


def _bins(rows: DataFrame, width: int) -> tuple[list[np.ndarray], int]:
    """Ends of each feature's bins but the last, and the number of classes."""
    names = [f"_{i}" for i in range(width)]
    few: list[set | None] = [set() for _ in range(width + 1)]
    for row in rows.mapInArrow(_few_values, "feature int, found array<double>").collect():
        known, found = few[row["feature"]], row["found"]
        known = None if known is None or found is None else known | {*found}
        few[row["feature"]] = known if known is not None and len(known) <= (BINS if row["feature"] < width else CLASSES) else None
    labels = few.pop()
    if not labels or any(v < 0 or v >= CLASSES or v != int(v) for v in labels):
        raise ValueError(f"There must be rows to train on, and labels must be whole numbers from 0 to {CLASSES - 1}")
    many = [c for c, known in zip(names, few) if known is None]
    at = [i / BINS for i in range(1, BINS)]
    ranks = rows.agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in many], *[F.max(c).alias(f"{c}_top") for c in many]).first() if many else {}
    ends = []
    for c, known in zip(names, few):
        if known is None:
            ends.append(np.array(sorted({v for v in ranks[c] if v < ranks[f"{c}_top"]})))
        else:
            values = sorted(known)
            ends.append(np.array([a + (b - a) / 2 if math.isfinite(b - a) else a for a, b in itertools.pairwise(values)]))
    return ends, int(max(labels)) + 1


def _few_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's distinct values by column, none if they are many; a label that is no number is -1."""
    few: dict[int, set | None] = {}
    for batch in batches:
        for i, column in enumerate(batch.columns if batch.num_rows else []):
            known = few.get(i, set())
            if known is not None:
                values = np.unique(np.nan_to_num(column.to_numpy(zero_copy_only=False).astype("float64"), nan=-1, posinf=np.inf, neginf=-np.inf))
                known = None if len(values) > CLASSES else known | {*values.tolist()}
                few[i] = known if known is not None and len(known) <= CLASSES else None
    found = [None if v is None else [*v] for v in few.values()]
    yield pa.RecordBatch.from_arrays([pa.array([*few], pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["feature", "found"])


def _binned(ends: list[np.ndarray]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = itertools.count(TaskContext.get().partitionId() << 32), [], 0

        def block() -> pa.RecordBatch:
            x, y = (np.concatenate(a) for a in zip(*held))
            columns = [([next(number)], pa.int64()), ([len(y)], pa.int64()), ([x.tobytes()], pa.binary()), ([y.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], ["block", "n", "x", "y"])

        for batch in batches:
            *columns, y = [c.to_numpy() for c in batch.columns]
            x = np.column_stack([np.searchsorted(e, c).astype("uint8") for e, c in zip(ends, columns)])
            held.append((x, y.astype("uint8")))
            n += len(y)
            if n >= BLOCK:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    return apply


def _grown(blocks: DataFrame, width: int, classes: int, trees: int, depth: int, seed: int) -> list[list[_Level]]:
    """Levels of each tree, from the root on."""
    tried = 1 if width == 1 else width if trees == 1 else math.ceil(math.sqrt(width))
    shape = (tried, BINS, classes)
    grown: list[list[_Level]] = [[_Level(np.zeros((1, classes), "int64"), open=np.zeros(1, "int64"))] for _ in range(trees)]
    cells = math.prod(shape)
    most = max(CELLS // 4 // cells // NODES, 1) * NODES
    for level in range(depth):
        todo = [(t, lo) for t in range(trees) if len(grown[t]) > level for lo in range(0, len(grown[t][level].open), most)]
        found: dict[int, list[np.ndarray]] = {t: [] for t, _ in todo}
        while todo:
            room, some = CELLS, {}
            while todo and todo[0][0] not in some:
                t, lo = todo[0]
                n = min(most, len(grown[t][level].open) - lo)
                room -= cells * n
                if some and room < 0:
                    break
                some[t] = lo, lo + n
                todo.pop(0)
            for t, splits in _split(blocks, grown, some, level, width, shape, seed).items():
                found[t].append(splits)
        for t, splits in found.items():
            _descend(grown[t], np.concatenate(splits), level + 1 == depth, classes)
    return grown


def _split(blocks: DataFrame, grown, some: dict[int, tuple[int, int]], level: int, width: int, shape: tuple[int, ...], seed: int) -> dict[int, np.ndarray]:
    """The best splits of some trees' open nodes, of each tree those from one number to another."""
    ways = {
        t: ([(np.maximum(k.feature[k.open], 0).astype("uint8" if width < 256 else "int32"), k.last[k.open], k.below) for k in grown[t][:level]], lo, hi)
        for t, (lo, hi) in some.items()
    }
    sizes = {t: len(grown[t][level].open) for t in some}
    counted = blocks.mapInArrow(_counted(ways, sizes, level, width, shape, seed, NODES), _COUNTS)
    spark = blocks.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = sum(-(-(hi - lo) // NODES) for lo, hi in some.values())
    spread = counted.repartition(min(parts, keys), "tree", "part").sortWithinPartitions("tree", "part")
    out: dict[int, dict[int, np.ndarray]] = {t: {} for t in some}
    for row in spread.mapInArrow(_best(sizes, level, width, shape, seed, NODES), _SPLITS).collect():
        out[row["tree"]][row["part"]] = np.frombuffer(row["splits"]).reshape(-1, 3 + 2 * shape[2])
    # A tree that drew no row is a root without rows.
    nothing = np.array([[0.0, -1, -1, *[0] * (2 * shape[2])]])
    return {t: np.concatenate([v for _, v in sorted(found.items())]) if found else nothing for t, found in out.items()}


def _tried(seed: int, tree: int, level: int, nodes: int, width: int, tried: int) -> np.ndarray:
    """The features looked at in each node."""
    return np.random.default_rng([seed % 2**64, tree, level, 1]).random((nodes, width)).argsort(axis=1)[:, :tried].astype("int32")


#: Of 2**32 even draws, those from each of these on are one more row: a Poisson draw of mean 1.
_DRAWS = [min(int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32), 2**32 - 1) for k in range(12)]


def _drawn(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often the tree takes each row of a block."""
    draws = np.random.Generator(np.random.SFC64([seed % 2**64, tree, block >> 32, block & 0xFFFFFFFF])).integers(0, 2**32, n, "uint32")
    times = np.zeros(n, "uint8")
    for least in _DRAWS:
        times += draws >= np.uint32(least)
    return times


def _counted(ways: dict, sizes: dict, level: int, width: int, shape: tuple[int, ...], seed: int, chunk: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tried, _, classes = shape
        looked = {t: _tried(seed, t, level, sizes[t], width, tried)[lo:hi] for t, (_, lo, hi) in ways.items()}
        sums: dict[int, np.ndarray] = {}

        def count(held: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
            x, y = np.concatenate([a for _, a, _ in held]), np.concatenate([b for _, _, b in held])
            for t, (steps, lo, hi) in ways.items():
                times = np.concatenate([_drawn(seed, t, number, len(b)) for number, _, b in held])
                row = np.flatnonzero(times) * width
                times, node, cls = times[times > 0], np.zeros(len(row), "int32"), y[times > 0]
                for feature, last, below in steps:
                    node = below[2 * node + (x[row + feature[node]] > last[node])]
                    kept = node >= 0
                    if not kept.all():
                        node, row, times, cls = node[kept], row[kept], times[kept], cls[kept]
                if hi - lo < sizes[t]:
                    kept = (node >= lo) & (node < hi)
                    node, row, times, cls = node[kept] - lo, row[kept], times[kept], cls[kept]
                size = (hi - lo) * math.prod(shape)
                mine = sums.setdefault(t, np.zeros(size, "uint32"))
                # A row that is taken twice is counted a second time, and so on.
                while len(node):
                    for j in range(tried):
                        key = ((node.astype("int64") * tried + j) * BINS + x[row + looked[t][node, j]]) * classes + cls
                        if len(key) * 8 < size:
                            keys, n = np.unique(key, return_counts=True)
                            mine[keys] += n.astype("uint32")
                        else:
                            mine += np.bincount(key, minlength=size).astype("uint32")
                    more = times > 1
                    node, row, times, cls = node[more], row[more], times[more] - 1, cls[more]

        held, n = [], 0
        for batch in batches:
            for number, x, y in zip(batch["block"], batch["x"], batch["y"]):
                held.append((number.as_py(), np.frombuffer(x.as_buffer(), "uint8"), np.frombuffer(y.as_buffer(), "uint8")))
                n += len(held[-1][2])
                if n >= AT_ONCE:
                    count(held)
                    held, n = [], 0
        if held:
            count(held)
        step = chunk * math.prod(shape)
        for t, all_counts in sums.items():
            for part, i in enumerate(range(0, len(all_counts), step), ways[t][1] // chunk):
                some = all_counts[i : i + step]
                top = int(some.max())
                if top:
                    kind = "uint8" if top < 1 << 8 else "uint16" if top < 1 << 16 else "uint32"
                    columns = [([t], pa.int32()), ([part], pa.int32()), ([np.dtype(kind).itemsize], pa.int32()), ([some.astype(kind).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], ["tree", "part", "width", "counts"])

    return apply


def _best(sizes: dict, level: int, width: int, shape: tuple[int, ...], seed: int, chunk: int):
    kinds = {1: "uint8", 2: "uint16", 4: "uint32"}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b["tree"].to_pylist(), b["part"].to_pylist(), b["width"].to_pylist(), b["counts"]))
        for (t, part), same in itertools.groupby(rows, lambda r: r[:2]):
            sums = 0
            for _, _, size, counts in same:
                sums = sums + np.frombuffer(counts.as_buffer(), kinds[size]).astype("int64")
            looked = _tried(seed, t, level, sizes[t], width, shape[0])[part * chunk : (part + 1) * chunk]
            splits = best_splits(sums.reshape(-1, *shape), looked)
            yield pa.RecordBatch.from_arrays(
                [pa.array([t], pa.int32()), pa.array([part], pa.int32()), pa.array([splits.tobytes()], pa.binary())], ["tree", "part", "splits"]
            )

    return apply


def _gini(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=-1, keepdims=True)
    return 1 - (np.divide(counts, total, out=np.zeros(counts.shape), where=total > 0) ** 2).sum(axis=-1)


def best_splits(counts: np.ndarray, looked: np.ndarray) -> np.ndarray:
    """Per node its gain, the feature and the last bin on the left (-1 without a gain), and both sides' rows by class."""
    left = counts.cumsum(axis=2)[:, :, :-1]
    whole = counts.sum(axis=2)[:, :1]
    right = whole[:, :, None] - left
    rows, l, r = whole.sum(axis=-1)[:, :, None], left.sum(axis=-1), right.sum(axis=-1)
    gain = _gini(whole)[:, :, None] - (l * _gini(left) + r * _gini(right)) / np.maximum(rows, 1)
    gain[(l == 0) | (r == 0)] = -1
    n, bins = len(counts), gain.shape[2]
    best = gain.reshape(n, -1).argmax(axis=1)
    each, j, b = np.arange(n), best // bins, best % bins
    won = gain[each, j, b]
    split = won > 0
    return np.column_stack([won, np.where(split, looked[each, j], -1), np.where(split, b, -1), left[each, j, b], right[each, j, b]])


def _descend(levels: list[_Level], splits: np.ndarray, last: bool, classes: int) -> None:
    """Take over the splits of the deepest level's open nodes and add the level below."""
    here = levels[-1]
    if len(levels) == 1:
        here.counts[0] = (splits[0, 3:].reshape(2, classes).sum(axis=0)).astype("int64")
    n = len(here.counts)
    here.feature, here.last, here.gain = np.full(n, -1, "int32"), np.full(n, -1, "int16"), np.full(n, -1.0)
    here.gain[here.open], here.feature[here.open], here.last[here.open] = splits[:, 0], splits[:, 1], splits[:, 2]
    cut = splits[:, 1] >= 0
    here.gain[here.open[~cut]] = -1
    counts = splits[cut, 3:].reshape(-1, classes).astype("int64")
    mixed = (counts > 0).sum(axis=1) > 1
    go_on = np.zeros(len(counts), bool) if last else mixed
    below = np.full((len(splits), 2), -1, "int32")
    below[cut] = np.where(go_on, go_on.cumsum() - 1, -1).reshape(-1, 2)
    here.below = below.reshape(-1)
    # Open nodes that got no split are leaves; they keep their place.
    if len(counts):
        levels.append(_Level(counts, open=np.flatnonzero(go_on).astype("int32")))
        if not go_on.any():
            levels[-1].feature = levels[-1].last = levels[-1].gain = np.full(len(counts), -1)


def _as_model(spark: SparkSession, empty: RandomForestClassificationModel, grown: list[list[_Level]], ends: list[np.ndarray]) -> RandomForestClassificationModel:
    """The trees in MLlib's written form, read as its model."""
    path = scratch_path(spark, "model")
    classes = grown[0][0].counts.shape[1]
    try:
        empty.write().save(path)
        for t in range(0, len(grown), 8):
            packed = [(t + k, flat_tree(levels).tobytes()) for k, levels in enumerate(grown[t : t + 8])]
            table = spark.createDataFrame(packed, "treeID int, nodes binary").repartition(len(packed), "treeID")
            table.mapInArrow(_node_rows(ends, classes), _NODES).write.mode("append" if t else "overwrite").parquet(f"{path}/data")
        return RandomForestClassificationModel.load(path)
    finally:
        remove_path(spark, path)


def flat_tree(levels: list[_Level]) -> np.ndarray:
    """One row a node, children after parents: feature, last bin, gain, left and right child, rows by class.

    A node whose children are leaves with one prediction becomes a leaf.
    """
    leaf = None
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k]
        split = np.flatnonzero(here.feature >= 0)
        if len(split):
            says = levels[k + 1].counts.argmax(axis=1).reshape(-1, 2)
            same = leaf.reshape(-1, 2).all(axis=1) & (says[:, 0] == says[:, 1])
            here.kids = np.full(len(here.counts), -1)
            here.kids[split] = 2 * np.arange(len(split))
            here.kids[split[same]] = -1
        else:
            here.kids = np.full(len(here.counts), -1)
        leaf = here.kids < 0
    out, kept, at = [], np.array([0]), 1
    for k, here in enumerate(levels):
        if not len(kept):
            break
        kids = here.kids[kept]
        inner = kids >= 0
        children = np.full((len(kept), 2), -1)
        children[inner] = at + np.arange(2 * inner.sum()).reshape(-1, 2)
        fields = [np.where(inner, here.feature[kept], -1), np.where(inner, here.last[kept], -1), np.where(inner, here.gain[kept], -1)]
        out.append(np.column_stack([*fields, children, here.counts[kept]]).astype("float64"))
        kept = (kids[inner][:, None] + np.arange(2)).reshape(-1)
        at += len(kept)
    return np.concatenate(out)


def _node_rows(ends: list[np.ndarray], classes: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, packed in zip(batch["treeID"].to_pylist(), batch["nodes"]):
                nodes = np.frombuffer(packed.as_buffer()).reshape(-1, 5 + classes)
                for i in range(0, len(nodes), 10_000):
                    some = nodes[i : i + 10_000]
                    counts, impurity = some[:, 5:], _gini(some[:, 5:])
                    rows = [
                        {
                            "id": i + k, "prediction": float(counts[k].argmax()), "impurity": impurity[k], "impurityStats": counts[k].tolist(),
                            "rawCount": int(counts[k].sum()), "gain": gain, "leftChild": int(left), "rightChild": int(right),
                            "split": {"featureIndex": int(f), "leftCategoriesOrThreshold": [float(ends[int(f)][int(b)])] if f >= 0 else [], "numCategories": -1},
                        }
                        for k, (f, b, gain, left, right) in enumerate(some[:, :5].tolist())
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array([tree] * len(rows), pa.int32()), pa.array(rows, _STRUCT)], ["treeID", "nodeData"])

    return apply


_STRUCT = pa.struct(
    [("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64())]
    + [("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32())]
    + [("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))]
)
