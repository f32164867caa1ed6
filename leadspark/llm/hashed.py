"""Hashed byte n-grams and a linear scorer on them, for any text classifier here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import map_batches, record

#: Bits of a hashed n-gram.
BITS = 20


def grams(text: bytes, width: int) -> np.ndarray:
    """The hashes of all runs of `width` bytes."""
    b = np.frombuffer(text, np.uint8)
    n = len(b) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = b[:n].astype(np.uint32)
    for k in range(1, width):
        h *= np.uint32(0x01000193)
        h ^= b[k : k + n]
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - BITS)
    return h


def document_frequencies(docs: DataFrame, column: str, width: int, target: str, least: int) -> pa.Table:
    """hash, total, positive: how many of the docs hold each n-gram, and the sum of their targets; those in at least
    `least` docs. At most 2^BITS rows."""

    def make():
        total, positive = np.zeros(1 << BITS), np.zeros(1 << BITS)

        def each(batch: pa.RecordBatch) -> None:
            for text, y in zip(batch.column(column), batch.column(target).to_numpy(), strict=True):
                found = np.unique(grams(text.as_buffer().to_pybytes(), width))
                total[found] += 1
                positive[found] += y

        def finish() -> pa.RecordBatch:
            found = np.flatnonzero(total)
            return record(hash=found, total=total[found], positive=positive[found])

        return each, finish

    counted = map_batches(docs.select(column, F.col(target).cast("double").alias(target)), make, "hash long, total double, positive double")
    return counted.groupBy("hash").agg(F.sum("total").alias("total"), F.sum("positive").alias("positive")).where(F.col("total") >= least).toArrow()


def select(counts: pa.Table, n: float, positives: float, most: int) -> np.ndarray:
    """The hashes that tell most about the target, by the chi-square of holding them; ties to the smaller hash."""
    h, t, p = (counts[c].to_numpy() for c in ("hash", "total", "positive"))
    rate = positives / max(n, 1)
    chi = (p - t * rate) ** 2 / np.maximum(t * rate * (1 - rate) * (1 - t / max(n, 1) * 0.999), 1e-9)
    keep = np.lexsort((h, -chi))[:most]
    return np.sort(h[keep]).astype(np.int64)


@dataclass
class Linear:
    """Logistic score of a text: for each selected n-gram, weights of log(1 + count) and of count / sqrt(length)."""

    width: int
    slot: np.ndarray  # by hash: place among the selected ones, or -1
    weights: np.ndarray  # two blocks of n, then the intercept

    @classmethod
    def blank(cls, width: int, selected: np.ndarray) -> Linear:
        slot = np.full(1 << BITS, -1, np.int16)
        slot[selected] = np.arange(len(selected))
        return cls(width, slot, np.zeros(2 * len(selected) + 1))

    def features(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, log counts and densities."""
        at = self.slot[grams(text, self.width)]
        places, times = np.unique(at[at >= 0], return_counts=True)
        return places.astype(np.int64), np.log1p(times), times / np.sqrt(10 + len(at) / 6)

    def logit(self, text: bytes) -> float:
        places, logs, dense = self.features(text)
        n = len(self.weights) // 2
        return float(self.weights[places] @ logs + self.weights[n + places] @ dense + self.weights[-1])

    def probability(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -40, 40))))

    def fit(self, docs: DataFrame, column: str, target: str, order: str, penalty: float = 1.0, rounds: int = 100) -> None:
        """docs: a sample of bounded size; only the selected features of each text reach the driver, in the order of
        the column `order`, so that the same rows give the same weights. The log loss with a penalty on the squares of
        the weights is convex; limited-memory BFGS takes some tens of steps to its minimum."""
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def make():
            model = shared.value

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = [model.features(t.as_buffer().to_pybytes()) for t in batch.column(column)]
                return record(y=batch.column(target), o=batch.column(order), places=pa.array([x[0] for x in found], pa.list_(pa.int32())), logs=pa.array([x[1].astype(np.float32) for x in found], pa.list_(pa.float32())), dense=pa.array([x[2].astype(np.float32) for x in found], pa.list_(pa.float32())))

            return each

        thin = docs.select(column, F.col(target).cast("double").alias(target), F.col(order).cast("long").alias(order))
        rows = map_batches(thin, make, "y double, o long, places array<int>, logs array<float>, dense array<float>").toArrow().sort_by("o")
        y = rows["y"].to_numpy()
        if not len(y):
            return
        n = len(self.weights) // 2
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(rows["places"]).to_numpy())))
        flat = lambda c: rows[c].combine_chunks().flatten().to_numpy()
        places, logs, dense = flat("places"), flat("logs"), flat("dense")
        row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(ends))

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            sums = np.concatenate(([0.0], np.cumsum(logs * w[places] + dense * w[n + places])))
            z = sums[ends[1:]] - sums[ends[:-1]] + w[-1]
            error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
            e = error[row]
            g = np.concatenate([np.bincount(places, logs * e, n), np.bincount(places, dense * e, n), [error.sum()]])
            g[:-1] += penalty * w[:-1]
            return (float((np.logaddexp(0, z) - y * z).sum()) + penalty / 2 * float(w[:-1] @ w[:-1])) / len(y), g / len(y)

        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        start = self.weights.copy()
        start[-1] = np.log(rate / (1 - rate))
        self.weights = minimise(loss, start, rounds)


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int, held: int = 10, enough: float = 1e-5) -> np.ndarray:
    """The minimum of a smooth convex function, which returns its value and gradient, by limited-memory BFGS: the last
    `held` steps stand for the curvature, and a step is halved until the value falls by a share of the slope."""
    value, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(g).max() < enough:
            break
        d, shares = -g, []
        for s, t, scale in reversed(steps):
            shares.append(scale * (s @ d))
            d = d - shares[-1] * t
        if steps:
            s, t, _ = steps[-1]
            d = d * ((s @ t) / (t @ t))
        for (s, t, scale), share in zip(steps, reversed(shares), strict=True):
            d = d + (share - scale * (t @ d)) * s
        slope, size = float(g @ d), 1.0 if steps else 1 / max(float(np.abs(g).sum()), 1e-12)
        while True:
            new = w + size * d
            v, h = loss(new)
            if v <= value + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, t = new - w, h - g
        if v > value:
            break
        w, value, g = new, v, h
        if s @ t > 1e-12:
            steps = [*steps, (s, t, 1 / (s @ t))][-held:]
    return w
