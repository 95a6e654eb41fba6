"""Hashed linear classifiers: features, training on a bounded sample, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import held_out, utf8


def sample(documents: DataFrame, labels: DataFrame, column: str, rows: int, seed: int, features: Callable[[], Callable[[bytes], tuple]], schema: str) -> list[Row]:
    """(y, calibrate, and what features()(text) gives, by schema) of at most `rows` labelled ids of each label: those whose hash is smallest.

    Held-out ids are never chosen. The ids are chosen from labels alone, 2 * rows of them at most, so they are broadcast to the
    documents. An id has one text, the lowest of its rows' texts, and the features are made where the text is: what comes to the
    driver is a bounded number of bounded rows, in an order that no partitioning changes. The bound
    is the classifiers' documented parameter. Rows with a null id or text teach nothing. A quarter of the texts are for calibration.
    """
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = features()
        for batch in batches:
            made = []
            for text, y in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                h = xxhash.xxh64_intdigest(text)
                made.append((h - (1 << 63), y, h % 4 == 0, *make(text)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    kinds = T._parse_datatype_string(f"h long, y int, calibrate boolean, {schema}")
    arrow = to_arrow_schema(kinds)
    marks = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(column).cast("int").alias("y")).distinct()
    chosen = [marks.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    found = texts.select("text", "y").mapInArrow(part, kinds).collect()
    return sorted(found, key=lambda r: (r["h"], r["y"]))


def presence(rows: list[np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all rows in one array, and where each row begins."""
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return (np.concatenate(rows) if rows else np.empty(0)).astype(np.int32), starts


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(idx: np.ndarray, val: np.ndarray, starts: np.ndarray, y: np.ndarray, dim: int, l2: float, steps: int = 80, pairs: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by L-BFGS; both classes weigh alike.

    pairs: (indices, signed values, starts, strength): rows that are the difference of the features of a
    sentence and of its counterfactual; the mean squared change of the score is penalised with that strength.
    """
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    if pairs:
        p_idx, p_val, p_starts, strength = pairs
        p_row, n_pairs = np.repeat(np.arange(len(p_starts) - 1), np.diff(p_starts)), max(1, len(p_starts) - 1)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, z = x[:-1], _sums(x[:-1][idx] * val, starts) + x[-1]
        err = (sigmoid(z) - y) * share
        value = float((share * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + l2 / 2 * (w @ w))
        g = np.bincount(idx, err[row] * val, dim) + l2 * w
        if pairs and len(p_idx):
            change = _sums(w[p_idx] * p_val, p_starts)
            value += strength / n_pairs * float(change @ change)
            g += np.bincount(p_idx, (2 * strength / n_pairs) * change[p_row] * p_val, dim)
        return value, np.concatenate([g, [err.sum()]])

    x = np.zeros(dim + 1)
    value, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = g.copy(), []
        for s, t, r in reversed(past):
            alphas.append(r * (s @ d))
            d -= alphas[-1] * t
        if past:
            d *= 1 / (past[-1][2] * (past[-1][1] @ past[-1][1]))
        for (s, t, r), alpha in zip(past, reversed(alphas), strict=True):
            d += (alpha - r * (t @ d)) * s
        step, slope = 1.0 if past else 1 / max(1e-12, float(np.abs(g).sum())), float(g @ d)
        for _ in range(30):
            new = x - step * d
            new_value, new_g = loss(new)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = new - x, new_g - g
        if s @ t > 1e-12:
            past = [*past[-7:], (s, t, 1 / float(s @ t))]
        done = value - new_value < 1e-7
        x, value, g = new, new_value, new_g
        if done:
            break
    return x[:-1], float(x[-1])


def platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b of the calibrated probability sigmoid(a * z + b), by Newton's method on smoothed targets."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z / (np.abs(z).max() or 1), np.ones_like(z)], 1)
    c = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(x @ c)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t))
        c -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(c[0] / (np.abs(z).max() or 1)), float(c[1])
