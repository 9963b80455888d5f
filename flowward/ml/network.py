"""Fitting of MLlib's dense network: L-BFGS on the driver, gradients by numpy over blocks of rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from flowward.session import cut_lineage, discard

#: Rows whose layers are worked out together; they stay in a core's cache.
CHUNK = 2048
#: Partial sums that the driver adds by itself.
DIRECT = 64
#: MLlib's settings: remembered steps, relative tolerance, steps over which the loss must fall by it.
MEMORY, TOLERANCE, STALLED = 10, 1e-6, 20

_SUMS = "n bigint, loss double, gradient binary"


def fit_network(df: DataFrame, features: Sequence[str], label: str, layers: Sequence[int], epochs: int, seed: int) -> PipelineModel:
    """MLlib's network of ``layers``, from MLlib's first weights for ``seed``, after ``epochs`` steps of L-BFGS at most.

    Every row counts alike in every step. Rows are written once in blocks of 32-bit numbers, in which the
    layers are worked out; sums over rows and the steps have 64 bits. The stopping rules are MLlib's.
    Features must be numbers; a label that is none of the classes is refused.
    """
    spark, assembler = df.sparkSession, VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    one = spark.range(1).select(*[F.lit(0.0).alias(c) for c in (*features, label)])

    def model(**weights) -> PipelineModel:
        network = MultilayerPerceptronClassifier(featuresCol="_features", labelCol=label, layers=list(layers), maxIter=0, seed=seed, **weights)
        return Pipeline(stages=[assembler, network]).fit(one)

    numbers = df.select(*[F.col(f"`{f}`").cast("double").alias(f"_{i}") for i, f in enumerate(features)], F.col(f"`{label}`").cast("double").alias("label"))
    blocks = cut_lineage(numbers.mapInArrow(_packed(layers[-1]), "n bigint, x binary, y binary"), "network")
    try:
        first, parts = model().stages[-1].weights.toArray(), blocks.rdd.getNumPartitions()
        weights = minimize(lambda w: _summed(blocks, parts, layers, w), first, epochs)
    finally:
        discard(blocks)
    fitted = model(initialWeights=Vectors.dense(weights))
    network = fitted.stages[-1]
    network._java_obj.clear(network._java_obj.getParam("initialWeights"))
    network.clear(network.initialWeights)
    network._set(maxIter=epochs)
    return fitted


def _packed(classes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, label = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            y = label.astype("float64")
            if not np.isin(y, np.arange(classes)).all():
                raise ValueError(f"Labels must be whole numbers from 0 to {classes - 1}")
            x = np.column_stack(columns).astype("float32")
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(y)], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in (x, y.astype("int32"))]], ["n", "x", "y"]
            )

    return pack


def _summed(blocks: DataFrame, parts: int, layers: Sequence[int], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross-entropy over all rows, and its gradient."""
    sums = blocks.mapInArrow(_gradients(tuple(layers), weights), _SUMS)
    if parts > DIRECT:
        sums = sums.repartition(round(parts**0.5)).mapInArrow(_added(len(weights)), _SUMS)
    n, loss, gradient = 0, 0.0, np.zeros(len(weights))
    for row in sums.collect():
        n, loss = n + row["n"], loss + row["loss"]
        gradient += np.frombuffer(row["gradient"])
    if n == 0:
        raise ValueError("There is no row to train on")
    return loss / n, gradient / n


def _sums(n: int, loss: float, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([n], pa.int64()), pa.array([loss], pa.float64()), pa.array([gradient.tobytes()], pa.binary())], ["n", "loss", "gradient"]
    )


def _gradients(layers: tuple[int, ...], weights: np.ndarray):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, gradient = 0, 0.0, np.zeros(len(weights))
        own = unrolled(weights.astype("float32"), layers)
        for batch in batches:
            for x, y in zip(batch["x"], batch["y"]):
                rows, classes = np.frombuffer(x.as_buffer(), "float32").reshape(-1, layers[0]), np.frombuffer(y.as_buffer(), "int32")
                n += len(classes)
                for i in range(0, len(classes), CHUNK):
                    loss += add_gradient(own, rows[i : i + CHUNK], classes[i : i + CHUNK], unrolled(gradient, layers))
        if n:
            yield _sums(n, loss, gradient)

    return apply


def _added(size: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, gradient = 0, 0.0, np.zeros(size)
        for batch in batches:
            for k, part, sums in zip(batch["n"], batch["loss"], batch["gradient"]):
                n, loss = n + k.as_py(), loss + part.as_py()
                gradient += np.frombuffer(sums.as_buffer())
        if n:
            yield _sums(n, loss, gradient)

    return apply


def unrolled(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of each layer's matrix (inputs x outputs) and bias in MLlib's weight vector."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def add_gradient(own, x: np.ndarray, y: np.ndarray, sums) -> float:
    """The rows' summed cross-entropy; adds its gradient by matrix and bias to ``sums``."""
    outputs = [x]
    for matrix, bias in own[:-1]:
        z = outputs[-1] @ matrix
        z += bias
        with np.errstate(over="ignore"):
            np.exp(np.negative(z, out=z), out=z)
        z += 1
        outputs.append(np.reciprocal(z, out=z))
    z = outputs[-1] @ own[-1][0] + own[-1][1]
    z -= z.max(axis=1, keepdims=True)
    each = np.arange(len(y))
    chosen = z[each, y].astype("float64")
    total = np.exp(z, out=z).sum(axis=1, keepdims=True)
    loss = float((np.log(total[:, 0].astype("float64")) - chosen).sum())
    z /= total
    z[each, y] -= 1
    for k in range(len(own) - 1, -1, -1):
        sums[k][0][...] += outputs[k].T @ z
        sums[k][1][...] += z.sum(axis=0)
        if k:
            z = z @ own[k][0].T
            z *= outputs[k]
            z *= np.subtract(1, outputs[k], out=outputs[k])
    return loss


@dataclass
class _Point:
    step: float
    value: float
    slope: float
    gradient: np.ndarray


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS with a strong Wolfe line search; ``f`` gives a value and its gradient."""
    value, gradient = f(x)
    start, values, past, failed = abs(value), deque([np.inf], STALLED), deque(maxlen=MEMORY), False
    for k in range(steps):
        values.append(value)
        if abs(max(values) - value) <= TOLERANCE * start or np.linalg.norm(gradient) <= max(TOLERANCE * abs(value), 1e-8):
            break
        way = -_curved(gradient, past)
        found = _searched(f, x, way, value, gradient, 1 / np.linalg.norm(way) if not past else 1.0)
        if found is None:
            if failed or not past:
                break
            failed = True
            past.clear()
            continue
        failed, moved, turned = False, found.step * way, found.gradient - gradient
        if moved @ turned > 0:
            past.append((moved, turned))
        x, value, gradient = x + moved, found.value, found.gradient
    return x


def _curved(gradient: np.ndarray, past) -> np.ndarray:
    """The gradient times the inverse curvature that the remembered steps show."""
    way, shares = gradient.copy(), []
    for moved, turned in reversed(past):
        shares.append((moved @ way) / (moved @ turned))
        way -= shares[-1] * turned
    if past:
        moved, turned = past[-1]
        way *= (moved @ turned) / (turned @ turned)
    for (moved, turned), share in zip(past, reversed(shares)):
        way += (share - (turned @ way) / (moved @ turned)) * moved
    return way


def _searched(f, x: np.ndarray, way: np.ndarray, value: float, gradient: np.ndarray, step: float) -> _Point | None:
    """A step along ``way`` that lowers the value and flattens the slope enough; else the lowest one tried, if any is lower."""
    slope = float(gradient @ way)
    if not slope < 0:
        return None
    low, high, best = _Point(0.0, value, slope, gradient), None, None
    for _ in range(20):
        got, turned = f(x + step * way)
        here = _Point(step, got, float(turned @ way), turned)
        if np.isfinite(got) and got < (value if best is None else best.value):
            best = here
        if not np.isfinite(got) or got > value + 1e-4 * step * slope or got >= low.value and low.step > 0:
            high = here
        elif abs(here.slope) <= -0.9 * slope:
            return here
        else:
            if here.slope * ((high.step - low.step) if high else 1.0) >= 0:
                high = low
            low = here
        step = _between(low, high) if high else step * 1.5
        if high and abs(high.step - low.step) <= 1e-9 * max(high.step, low.step):
            break
    return best


def _between(low: _Point, high: _Point) -> float:
    """The lowest point of the parabola through both, well inside."""
    width = high.step - low.step
    bend = high.value - low.value - low.slope * width
    share = -low.slope * width / (2 * bend) if np.isfinite(bend) and bend > 0 else 0.5
    return low.step + width * min(max(share, 0.1), 0.9)
