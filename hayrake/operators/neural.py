"""Small networks trained by full passes: gradients are summed per task, Spark adds the sums, the driver holds weights only.

A step is one job over a stage table.  Every task runs forward and backward over its Arrow batches and gives one row per gradient
cell; sums are whole numbers in fixed point, so a step is the same however rows are dealt.  AdamW moves the weights on the driver,
whose number is fixed by the layers and not by the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = float(1 << 30)
_BEND = np.sqrt(2 / np.pi)


@dataclass
class AdamW:
    rate: float
    decay: float = 0.01
    beta1: float = 0.9
    beta2: float = 0.999
    tiny: float = 1e-8
    step: int = 0
    first: list | None = None
    second: list | None = None

    def move(self, weights: list[np.ndarray], gradients: list[np.ndarray]) -> list[np.ndarray]:
        """New weights: decay apart from the gradient, moments without bias."""
        self.step += 1
        self.first = self.first or [np.zeros_like(w) for w in weights]
        self.second = self.second or [np.zeros_like(w) for w in weights]
        out = []
        for k, (w, g) in enumerate(zip(weights, gradients, strict=True)):
            self.first[k] = self.beta1 * self.first[k] + (1 - self.beta1) * g
            self.second[k] = self.beta2 * self.second[k] + (1 - self.beta2) * g * g
            m, v = self.first[k] / (1 - self.beta1**self.step), self.second[k] / (1 - self.beta2**self.step)
            out.append(w * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + self.tiny))
        return out


def summed(table: DataFrame, of_batch: Callable[[pa.RecordBatch], tuple[float, float, list[np.ndarray]]], shapes: list[tuple]) -> tuple[float, float, list[np.ndarray]]:
    """Loss, weight and gradients of all rows, from ``of_batch``'s sums of a batch."""
    sizes = [int(np.prod(s)) for s in shapes]

    def run(batches):
        total = np.zeros(2 + sum(sizes))
        for b in batches:
            loss, weight, gradients = of_batch(b)
            total[:2] += loss, weight
            total[2:] += np.concatenate([g.ravel() for g in gradients])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.rint(total[at] * SCALE).astype(np.int64))], names=["cell", "v"])

    found = table.mapInArrow(run, "cell bigint, v bigint").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(2 + sum(sizes))
    flat[found["cell"].to_numpy()] = found["v"].to_numpy() / SCALE
    parts = np.split(flat[2:], np.cumsum(sizes)[:-1])
    return float(flat[0]), float(flat[1]), [p.reshape(s) for p, s in zip(parts, shapes, strict=True)]


# ---------------------------------------------------------------- perceptron


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit in its tanh form, and its slope."""
    t = np.tanh(_BEND * (x + 0.044715 * x**3))
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * _BEND * (1 + 3 * 0.044715 * x * x)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def perceptron_gradients(weights: list[np.ndarray], x: np.ndarray, target: np.ndarray, w: np.ndarray, drop: np.ndarray | None = None) -> tuple[float, list[np.ndarray]]:
    """Weighted soft cross-entropy of a batch, and its gradients; ``drop`` scales the hidden units."""
    w1, b1, w2, b2 = weights
    before = x @ w1 + b1
    hidden, slope = gelu(before)
    if drop is not None:
        hidden, slope = hidden * drop, slope * drop
    p = _softmax(hidden @ w2 + b2)
    loss = float((-(target * np.log(np.maximum(p, 1e-300))).sum(1) * w).sum())
    up = (p * target.sum(1, keepdims=True) - target) * w[:, None]
    down = (up @ w2.T) * slope
    return loss, [x.T @ down, down.sum(0), hidden.T @ up, up.sum(0)]


@dataclass
class Perceptron:
    weights: list[np.ndarray]
    labels: list[str]
    losses: list[float]


def perceptron_rows(inputs: DataFrame, targets: DataFrame, key: str, label: str, labels: list[str], buckets: int) -> DataFrame:
    """(key, at, x, share, weight): hashed terms of each text, its shares of the labels in their order, its evidence weight.

    One row per text; terms are hashed into ``buckets``, so none is left out.  ``labels`` are the classes, whose number is small.
    """
    hashed = inputs.groupBy(key, F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("at")).agg(F.sum("x").alias("x"))
    rows = hashed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("cells"))
    numbers = F.create_map(*[F.lit(v) for k, name in enumerate(labels) for v in (name, k)])
    wide = targets.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(numbers[F.col(label)].alias("k"), F.col("share")))).alias("shares"), F.sum("weight").alias("weight"))
    share = F.transform(F.sequence(F.lit(0), F.lit(len(labels) - 1)), lambda k: F.coalesce(F.element_at("shares", k), F.lit(0.0)))
    return rows.join(wide, key, "left").select(F.col(key).alias("key"), F.col("cells.at").alias("at"), F.col("cells.x").alias("x"), F.when(F.col("shares").isNotNull(), share).alias("share"), "weight")


def _dense(b: pa.RecordBatch, buckets: int) -> np.ndarray:
    at, x = b.column("at"), b.column("x")
    out = np.zeros((b.num_rows, buckets))
    rows = np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy()))
    np.add.at(out, (rows, at.flatten().to_numpy()), x.flatten().to_numpy())
    return out


def fit_perceptron(rows: DataFrame, labels: list[str], buckets: int, hidden: int = 384, steps: int = 35, rate: float = 0.0015, decay: float = 0.01, dropout: float = 0.15, seed: int = 7) -> Perceptron:
    """One hidden layer of GELU units on soft labels; ``rows`` as in ``perceptron_rows``, read once a step.

    Which units are dropped depends on seed, step and key only.
    """
    rng = np.random.default_rng(seed)
    c = len(labels)
    weights = [rng.uniform(-1, 1, s) / np.sqrt(n) for s, n in (((buckets, hidden), buckets), ((hidden,), buckets), ((hidden, c), hidden), ((c,), hidden))]
    shapes, mover, losses = [w.shape for w in weights], AdamW(rate, decay), []
    for step in range(steps):

        def of_batch(b, weights=weights, step=step):
            x, w = _dense(b, buckets), b.column("weight").to_numpy()
            target = np.array(b.column("share").to_pylist()).reshape(-1, c)
            draws = [np.random.default_rng(zlib.crc32(f"{seed}:{step}:{k}".encode())).uniform(size=hidden) for k in b.column("key").to_pylist()]
            drop = (np.array(draws).reshape(-1, hidden) >= dropout) / (1 - dropout) if dropout else None
            loss, gradients = perceptron_gradients(weights, x, target, w, drop)
            return loss, float(w.sum()), gradients

        loss, weight, gradients = summed(rows.where("share is not null"), of_batch, shapes)
        if weight == 0:
            break
        losses.append(loss / weight)
        weights = mover.move(weights, [g / weight for g in gradients])
    return Perceptron(weights, labels, losses)


def perceptron_probabilities(model: Perceptron, rows: DataFrame, buckets: int) -> DataFrame:
    """(key, label, p) of every row and class."""

    def run(batches):
        for b in batches:
            w1, b1, w2, b2 = model.weights
            p = _softmax(gelu(_dense(b, buckets) @ w1 + b1)[0] @ w2 + b2)
            keys = b.column("key").take(pa.array(np.repeat(np.arange(b.num_rows), len(model.labels))))
            yield pa.RecordBatch.from_arrays([keys, pa.array(model.labels * b.num_rows), pa.array(p.ravel())], names=["key", "label", "p"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, label string, p double")


# ---------------------------------------------------------------- contrastive projection


def projection_gradients(p: np.ndarray, q: np.ndarray, d: np.ndarray, same: np.ndarray, temperature: float, teacher: float) -> tuple[float, np.ndarray]:
    """Sum over a block's queries of the in-batch softmax loss and of the distance from the given vectors, and its gradient.

    ``same`` marks all documents of the block that are right for a query; the others are its negatives.
    """
    z = q @ p
    size = np.linalg.norm(z, axis=1, keepdims=True)
    u = z / np.maximum(size, 1e-12)
    s = u @ d.T / temperature
    e = np.exp(s - s.max(1, keepdims=True))
    right = (e * same).sum(1, keepdims=True)
    whole = e.sum(1, keepdims=True)
    unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    loss = float((-np.log(right / whole)).sum() + teacher * (1 - (u * unit).sum(1)).sum())
    du = (e / whole - e * same / right) @ d / temperature - teacher * unit
    dz = (du - u * (du * u).sum(1, keepdims=True)) / np.maximum(size, 1e-12)
    return loss, q.T @ dz


def projection_blocks(pairs: DataFrame, block: int = 128, seed: int = 7) -> DataFrame:
    """(block, rows): pairs (query, item, q, d) dealt into blocks by a hash, about ``block`` rows each.

    A block is a batch of the loss: its size is bounded by the parameter, whatever query or item is frequent.
    """
    n = pairs.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).alias("blocks"))
    at = F.pmod(F.xxhash64(F.lit(seed), F.col("query").cast("string"), F.col("item").cast("string")), F.col("blocks"))
    dealt = pairs.crossJoin(n).withColumn("block", at)
    return dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("query", "item", "q", "d"))).alias("rows"))


def fit_projection(blocks: DataFrame, size: int, steps: int = 30, rate: float = 0.002, decay: float = 0.0, temperature: float = 0.05, teacher: float = 0.2) -> tuple[np.ndarray, list[float]]:
    """A linear map of query vectors, started from the identity; document vectors stay as they are."""
    weights, mover, losses = [np.eye(size)], AdamW(rate, decay), []
    for _ in range(steps):

        def of_batch(b, p=weights[0]):
            total, count, gradient = 0.0, 0, np.zeros_like(p)
            for rows in b.column("rows").to_pylist():
                q, d = (np.array([r[c] for r in rows], float) for c in ("q", "d"))
                names = np.array([str(r["query"]) for r in rows])
                items = np.array([str(r["item"]) for r in rows])
                right = {(a, i) for a, i in zip(names, items, strict=True)}
                same = np.array([[(a, i) in right for i in items] for a in names], float)
                loss, g = projection_gradients(p, q, d, same, temperature, teacher)
                total, count, gradient = total + loss, count + len(rows), gradient + g
            return total, float(count), [gradient]

        loss, count, (gradient,) = summed(blocks, of_batch, [(size, size)])
        if count == 0:
            break
        losses.append(loss / count)
        weights = mover.move(weights, [gradient / count])
    return weights[0], losses


def projected(vectors: DataFrame, column: str, p: np.ndarray) -> DataFrame:
    """The rows with ``column`` mapped and brought to length 1."""
    schema, at = vectors.schema, vectors.columns.index(column)

    def run(batches):
        for b in batches:
            v = np.array(b.column(at).to_pylist(), float).reshape(b.num_rows, -1) @ p if b.num_rows else np.empty((0, p.shape[1]))
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            out = pa.array(list(v), b.column(at).type) if b.num_rows else b.column(at)
            yield pa.RecordBatch.from_arrays([out if k == at else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    return vectors.mapInArrow(run, schema)
