"""Language identification with hyperdimensional profiles.

Each letter class has a random vector of +1 and -1. A trigram's vector binds (multiplies) its
letters' vectors, the first rolled by two places, the second by one; a text's vector bundles (adds)
those of its trigrams; a language's prototype bundles its texts. A text gets the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out

#: Places of a vector; letter classes (0 is what stands between words); seed of the letters' vectors.
DIM, CLASSES, SEED = 2048, 64, 17
SHARPNESS = 24.0
#: Texts that are bundled together; vectors at hand (8 kB each, four times while they are made); languages whose counts a task holds (2 MB each).
TEXTS, VECTORS, LANGUAGES = 64, 1024, 32
#: Below three times the noise of DIM places a cosine says nothing; a text that shares no trigram with a prototype seldom comes above it.
LEAST_COSINE = 3 * DIM**-0.5


def letters(dim: int = DIM, seed: int = SEED) -> np.ndarray:
    return (np.random.default_rng(seed).integers(0, 2, (CLASSES, dim)) * 2 - 1).astype(np.float32)


def letter_class(x: str) -> int:
    """a-z take 1-26, other letters 27-63 by a rule, the rest 0."""
    if not x.isalpha():
        return 0
    y = x.lower()
    return ord(y) - 96 if len(y) == 1 and "a" <= y <= "z" else 27 + (ord(y[0]) * 2654435761 >> 7) % 37


def letter_classes() -> np.ndarray:
    """Class of every code point of the first plane."""
    return np.array([letter_class(chr(c)) for c in range(0x10000)], np.uint8)


class Profiler:
    """Trigrams and vectors of texts. vectors are made when first asked for; there are at most 64**3."""

    def __init__(self, dim: int = DIM, seed: int = SEED) -> None:
        third = letters(dim, seed)
        self.letters, self.classes, self.dim = (np.roll(third, 2, 1), np.roll(third, 1, 1), third), letter_classes(), dim

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the trigrams of a whole text and their counts; runs of other than letters count as one space."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        c = self.classes[np.where(points < 0x10000, points, 0)]
        beyond = np.nonzero(points >= 0x10000)[0]
        if len(beyond):
            found, at = np.unique(points[beyond], return_inverse=True)
            c[beyond] = np.array([letter_class(chr(x)) for x in found.tolist()], np.uint8)[at]
        if not c.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keep = (c > 0) | (np.concatenate([[1], c[:-1]]) > 0)
        c = np.concatenate([[0], c[keep], [0]]).astype(np.int64)
        codes = c[:-2] * CLASSES * CLASSES + c[1:-1] * CLASSES + c[2:]
        if len(codes) > 20_000:
            counts = np.bincount(codes, minlength=CLASSES**3)
            found = np.nonzero(counts)[0]
            return found, counts[found]
        return np.unique(codes, return_counts=True)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        first, second, third = self.letters
        return first[codes // CLASSES**2] * second[codes // CLASSES % CLASSES] * third[codes % CLASSES]

    def bundled(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A vector for each text's codes and counts: the counts by code times the codes' vectors, so many codes at a time."""
        codes = np.unique(np.concatenate([c for c, _ in texts]))
        out = np.zeros((len(texts), self.dim), np.float32)
        for at in range(0, len(codes), VECTORS):
            some = codes[at : at + VECTORS]
            counts = np.zeros((len(texts), len(some)), np.float32)
            for k, (c, n) in enumerate(texts):
                i, j = np.searchsorted(c, (some[0], some[-1] + 1))
                counts[k, np.searchsorted(some, c[i:j])] = n[i:j]
            out += counts @ self.vectors(some)
        return out


def learn(documents: DataFrame, dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes by lang, from the rows whose lang is not null and that are not held out.

    Each task adds up its trigram counts by language and sends one vector for each; only those few
    vectors, as many as there are languages, come to the driver. A task holds the counts of LANGUAGES of them at most and
    sends its sums when there are more. Every row counts.
    """
    def part(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(dim, seed), {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, counts in sums.items():
                codes = np.nonzero(counts)[0]
                yield pa.RecordBatch.from_pydict({"lang": [lang], "vector": [profiler.bundled([(codes, counts[codes])])[0].astype(float).tolist()]})
            sums.clear()

        for batch in rows:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, counts = profiler.trigrams(text)
                if len(codes):
                    if lang not in sums:
                        if len(sums) == LANGUAGES:
                            yield from sent()
                        sums[lang] = np.zeros(CLASSES**3, np.int64)
                    sums[lang][codes] += counts  # each code is there once
        yield from sent()

    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
    parts = rows.mapInArrow(part, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("at", "x"))
    sums = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    return {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in sums.collect()}  # dim numbers a language


def tag(documents: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM, seed: int = SEED) -> DataFrame:
    """(doc, lang_pred, score, cosine) of every row; doc is a struct of the row's own columns, whatever their names.

    score is the softmax of the cosines (times SHARPNESS) at the language chosen: 0 to 1. A text that is
    null, empty or without a letter is `und` with score 0, and so is every text if there is no prototype.
    Ties go to the language that sorts first. Whole texts count; repeated rows come out each. No shuffle.
    """
    names = sorted(prototypes)
    unit = np.array([prototypes[x] / (np.linalg.norm(prototypes[x]) or 1) for x in names], np.float32).reshape(len(names), dim)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))

    def part(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(dim, seed)
        for batch in rows:
            texts, n = batch.column(0).field("text"), batch.num_rows
            pred, score, cosine = ["und"] * n, [0.0] * n, [0.0] * n
            for at in range(0, n, TEXTS):  # so many texts' trigrams at once, however large the batch
                found = [profiler.trigrams(text or "") for text in texts.slice(at, TEXTS).to_pylist()]
                spoken = [k for k, (codes, _) in enumerate(found) if len(codes) and names]
                if not spoken:
                    continue
                v = profiler.bundled([found[k] for k in spoken])
                c = v @ unit.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                e = np.exp(SHARPNESS * (c - c.max(1, keepdims=True)))
                for k, best, row, share in zip(spoken, c.argmax(1).tolist(), c, e / e.sum(1, keepdims=True), strict=True):
                    pred[at + k], score[at + k], cosine[at + k] = names[best], float(share[best]), float(row[best])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(cosine, pa.float64())], names=["doc", "lang_pred", "score", "cosine"])

    return rows.mapInArrow(part, T.StructType(list(rows.schema.fields)).add("lang_pred", "string").add("score", "double").add("cosine", "double"))


def identify(documents: DataFrame, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cosine: learns from documents, then predicts every row of it."""
    tagged = tag(documents.select("doc_id", "text"), learn(documents, dim, seed), dim, seed)
    return tagged.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score", "cosine")


def keep_identified(documents: DataFrame, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """The documents with a language, with all their columns: `und` goes, and what no prototype comes near. A null lang becomes the predicted one."""
    kept = tag(documents, learn(documents)).where((F.col("lang_pred") != "und") & (F.col("cosine") >= least_cosine))
    return kept.select(*[F.coalesce("doc.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"doc.`{c}`").alias(c) for c in documents.columns])
