"""Toxicity: a counterfactual-regularised classifier.

A logistic regression over the presence of hashed words and of word beginnings. For every labelled
sentence that names a group, the counterfactual names another group of the same kind; the squared
change of the score is part of the loss, so a neutral mention of a group does not raise a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out
from .linear import fit, platt, presence, sample, sigmoid

#: Identity terms that stand for one another, by kind.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "queer"), ("black", "white", "asian", "latino", "indigenous"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"), ("immigrant", "refugee", "citizen", "foreigner"),
    ("immigrants", "refugees", "citizens", "foreigners"), ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly"),
)
DIM, SAMPLE, THRESHOLD, STRENGTH, SEED = 1 << 18, 4000, 0.3, 4.0, 5
#: Features of fewer training texts, or whose shares among toxic and other texts differ by fewer standard errors, say nothing.
LEAST_DF, LEAST_Z = 3, 3.0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


class Features:
    """Indices of a text's features: its words, and the first 4, 5 and 6 letters of longer words."""

    LIMIT = 200_000

    def __init__(self, dim: int = DIM) -> None:
        self.dim, self.known = dim, {}

    def word(self, w: str) -> tuple[int, ...]:
        found = self.known.get(w)
        if found is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            parts = [f"={w}", *[f"{w[:n]}-" for n in (4, 5, 6) if len(w) >= n]]
            found = self.known[w] = tuple(xxhash.xxh64_intdigest(p) % self.dim for p in parts)
        return found

    @staticmethod
    def words(text: bytes) -> set[str]:
        return set(re.findall(r"[^\W\d_]+", text.decode("utf-8", "replace").lower()))

    def of(self, words: set[str]) -> np.ndarray:
        return np.unique(np.fromiter((i for w in words for i in self.word(w)), np.int64)) if words else np.empty(0, np.int64)


def packed(indices: np.ndarray) -> bytes:
    return indices.astype(np.int32).tobytes()


def counterfactuals(words: set[str]) -> Iterator[set[str]]:
    """The word set with each group's name swapped for the next one of its kind."""
    for kind in IDENTITY:
        if found := words & set(kind):
            turn = {w: kind[(kind.index(w) + 1) % len(kind)] for w in found}
            yield {turn.get(w, w) for w in words}


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE, dim: int = DIM, strength: float = STRENGTH, seed: int = SEED) -> Model:
    """Learns from at most `rows` texts of each label, never from held-out ones; a quarter of them calibrates. The driver gets the
    features' numbers only, 4 bytes for each distinct one and `dim` of them a text at most, never a text.

    Without rows of both labels every text scores 0.
    """
    def made():
        features = Features(dim)

        def one(text: bytes) -> tuple[bytes, list[bytes], list[bytes]]:
            words = features.words(text)
            own = features.of(words)
            others = [features.of(x) for x in counterfactuals(words)]
            return packed(own), [packed(np.setdiff1d(own, x)) for x in others], [packed(np.setdiff1d(x, own)) for x in others]

        return one

    some = sample(documents, labels, "toxic", rows, seed, made, "own binary, gone array<binary>, come array<binary>")
    y = np.array([r["y"] for r in some], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0), 0.0, 0.0, -35.0)
    found = [np.frombuffer(r["own"], np.int32) for r in some]
    calibrate = np.array([r["calibrate"] for r in some])
    if len(set(y[~calibrate].tolist())) < 2:
        calibrate[:] = False
    count = [np.bincount(np.concatenate([f for f, c, v in zip(found, calibrate, y, strict=True) if not c and v == x] or [np.empty(0, np.int32)]), minlength=dim) for x in (0, 1)]
    n0, n1 = (max(1, int(((y == x) & ~calibrate).sum())) for x in (0, 1))
    pooled = (count[0] + count[1]) / (n0 + n1)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n0 + 1 / n1))
    useful = (count[0] + count[1] >= LEAST_DF) & (np.abs(count[1] / n1 - count[0] / n0) >= LEAST_Z * error)
    found = [f[useful[f]] for f in found]
    idx, starts = presence([f for f, c in zip(found, calibrate, strict=True) if not c], dim)
    deltas, values = [], []
    for r, c in zip(some, calibrate, strict=True):
        if not c:
            for less, more in zip(r["gone"], r["come"], strict=True):
                gone, come = np.frombuffer(less, np.int32), np.frombuffer(more, np.int32)
                deltas.append(np.concatenate([gone, come]))
                values.append(np.concatenate([np.ones(len(gone)), -np.ones(len(come))]))
    pairs = None
    if deltas:
        p_idx, p_starts = presence(deltas, dim)
        pairs = (p_idx, np.concatenate(values), p_starts, strength)
    w, b = fit(idx, np.ones(len(idx)), starts, y[~calibrate], dim, 1e-4, pairs=pairs)
    z = np.array([w[f].sum() + b for f in found])
    held = calibrate if len(set(y[calibrate].tolist())) == 2 else np.ones(len(y), bool)
    slope, offset = platt(z[held], y[held])
    return Model(w.astype(np.float32), b, slope, offset)


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, score, predicted) of every row; doc is a struct of its own columns. Whole texts; no shuffle.

    A null or empty text scores as one without any feature. Repeated rows come out each.
    """
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))
    weights, bias, slope, offset, dim = model.weights, model.bias, model.slope, model.offset, len(model.weights) or DIM

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(dim)
        for batch in batches:
            z = np.array([weights[features.of(features.words((t or "").encode("utf-8", "replace")))].sum() if len(weights) else 0.0 for t in batch.column(0).field("text").to_pylist()])
            p = sigmoid(slope * (z + bias) + offset)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=["doc", "score", "predicted"])

    return rows.mapInArrow(part, T.StructType(list(rows.schema.fields)).add("score", "double").add("predicted", "integer"))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(documents.select("doc_id", "text"), train(documents, labels, **how), threshold)
    return out.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", "predicted")
