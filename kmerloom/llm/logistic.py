"""Logistic regression on hashed features of a bounded sample: fitted in one task, applied in all.

Features are strings; each counts at the place that its hash names. Coefficients are those of standardised features, with
a penalty on their squares, and the fit takes limited-memory quasi-Newton steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS, MEMORY, TOLERANCE = 40, 10, 1e-6


def places(features: Column, size: int) -> Column:
    """The place of each feature of an array column."""
    return F.transform(features, lambda x: F.pmod(F.hash(x), F.lit(size)))


def minimum(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Where a convex function is least; `value` gives the function and its gradient."""
    f, g = value(x)
    moved: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        d, alphas = -g, []
        for s, y, r in reversed(moved):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * y
        if moved:
            s, y, _ = moved[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(moved, reversed(alphas)):
            d = d + (a - r * (y @ d)) * s
        slope, t = g @ d, 1.0 if moved else 1.0 / max(np.abs(g).sum(), 1e-12)
        while True:
            new = x + t * d
            f2, g2 = value(new)
            if f2 <= f + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = new - x, g2 - g
        if s @ y > 1e-12:
            moved = [*moved[-(MEMORY - 1) :], (s, y, 1.0 / (s @ y))]
        gained, x, f, g = f - f2, new, f2, g2
        if gained <= TOLERANCE * max(abs(f), 1e-12):
            break
    return x


def coefficients(at: np.ndarray, ends: np.ndarray, label: np.ndarray, weight: np.ndarray, size: int, penalty: float) -> np.ndarray:
    """The coefficients of the places, and the intercept last. Row i has the places at[ends[i]:ends[i + 1]], one or more."""
    weight = weight / weight.sum()
    cell, times = np.unique(np.repeat(np.arange(len(label), dtype=np.int64), np.diff(ends)) * size + at, return_counts=True)
    row, at = cell // size, cell % size
    ends = np.searchsorted(row, np.arange(len(label) + 1))
    mean = np.bincount(at, weight[row] * times, size)
    variance = np.bincount(at, weight[row] * times * times, size) - mean * mean
    scale = np.divide(1.0, np.sqrt(np.maximum(variance, 0)), out=np.zeros(size), where=variance > 1e-9)  # a feature that never varies has no coefficient
    held, sign = scale[at] * times, 2 * label - 1

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        margin = (np.add.reduceat(held * x[:-1][at], ends[:-1]) + x[-1]) * sign
        loss = weight @ np.logaddexp(0, -margin) + penalty / 2 * (x[:-1] @ x[:-1])
        pull = -sign * weight * np.exp(-np.logaddexp(0, margin))
        return float(loss), np.append(np.bincount(at, held * pull[row], size) + penalty * x[:-1], pull.sum())

    ones = float(weight @ label)
    start = np.append(np.zeros(size), np.log(ones / (1 - ones)))
    found = minimum(value, start)
    return np.append(found[:-1] * scale, found[-1])


def fitted(examples: DataFrame, size: int, penalty: float) -> np.ndarray | None:
    """The coefficients for `examples` (label, weight, features); none if they have but one label. All examples go to one task: their number must be bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)) for b in batches if b.num_rows]
        label = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0)
        if len(np.unique(label)) == 2:
            at = np.concatenate([p[2].flatten().to_numpy() for p in parts])
            ends = np.cumsum(np.r_[0, np.concatenate([np.diff(p[2].offsets.to_numpy()) for p in parts])])
            found = coefficients(at, ends, label, np.concatenate([p[1] for p in parts]), size, penalty)
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["coefficients"])

    rows = examples.select("label", "weight", places(F.col("features"), size).alias("at")).coalesce(1).mapInArrow(run, "coefficients BINARY")
    found = rows.collect()  # one row or none
    return np.frombuffer(found[0][0], np.float64) if found else None


def probability(features: Column, found: np.ndarray, spark_context: object) -> Column:
    """The probability of label 1 for an array column of features."""
    shared = spark_context.broadcast(found)

    @F.arrow_udf(T.DoubleType())
    def score(at: pa.Array) -> pa.Array:
        x = shared.value
        if not len(at):
            return pa.array([], pa.float64())
        ends = at.offsets.to_numpy()
        flat = at.flatten().to_numpy()
        margin = np.add.reduceat(x[:-1][flat], ends[:-1] - ends[0]) + x[-1]
        return pa.array(1 / (1 + np.exp(-margin)))

    return score(places(features, len(found) - 1))
