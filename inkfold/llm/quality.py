"""Quality rules: fixed base rules, and a calibrated hashed n-gram classifier beyond them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, mixed, utf8, windows
from .linear import fit, platt, presence, sample, sigmoid
from .toxicity import Model

#: Features in each half (words, characters); training texts of each label; least probability of a kept row.
DIM, SAMPLE, KEEP, SEED = 1 << 16, 1500, 0.5, 9
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def base(text: bytes, hashes: WordHashes) -> tuple[tuple[int, int, int, int, int], np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text, and its words' hashes."""
    raw = np.frombuffer(text, np.uint8)
    h = hashes.of(text.split())
    chars = int(((raw & 0xC0) != 0x80).sum()) - int(_SPACE[raw].sum())
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")] if b"\n" in text else []
    w = windows(h, 3)
    repeated = 0
    if len(w) > 1:
        _, where, counts = np.unique(w, return_inverse=True, return_counts=True)
        if len(counts) < len(w):
            at = np.zeros(len(h), bool)
            twice = counts[where] > 1
            for i in range(3):
                at[i : i + len(w)] |= twice
            repeated = int(at.sum())
    return (len(h), chars, int(_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeated), h


def frequencies(text: bytes, h: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: shares of the words and word pairs, and of the runs of 3 and 4 bytes; each half sums to 2."""
    mask = np.uint64(dim - 1)
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    words = [mixed(h) & mask, windows(h, 2) & mask]
    with np.errstate(over="ignore"):
        three = raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16)
        four = three[:-1] | raw[3:] << np.uint64(24)
        chars = [mixed(three + np.uint64(1 << 40)) & mask, mixed(four + np.uint64(1 << 41)) & mask]
    parts = [*words, *[c + np.uint64(dim) for c in chars]]
    return np.concatenate(parts).astype(np.int64), np.concatenate([np.full(len(p), 1 / max(1, len(p))) for p in parts])


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE, dim: int = DIM, seed: int = SEED) -> Model:
    """Learns from at most `rows` texts of each quality label; a quarter of them calibrates the probability. The driver gets the
    features only, 8 bytes for each distinct one and 2 * dim of them a text at most, never a text.

    Without rows of both labels everything that passes the base rules is kept.
    """
    def made():
        hashes = WordHashes()

        def one(text: bytes) -> tuple[bytes, bytes]:
            i, v = frequencies(text, hashes.of(text.split()), dim)
            u, where = np.unique(i, return_inverse=True)
            return u.astype(np.int32).tobytes(), np.bincount(where, v, len(u)).astype(np.float32).tobytes()

        return one

    some = sample(documents, labels, "quality", rows, seed, made, "at binary, share binary")
    y = np.array([r["y"] for r in some], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0), 0.0, 0.0, 35.0)
    idx, val = [np.frombuffer(r["at"], np.int32) for r in some], [np.frombuffer(r["share"], np.float32) for r in some]
    calibrate = np.array([r["calibrate"] for r in some])
    learn = ~calibrate if len(set(y[~calibrate].tolist())) == 2 else np.ones(len(y), bool)
    flat, starts = presence([x for x, c in zip(idx, learn, strict=True) if c], dim)
    w, b = fit(flat, np.concatenate([x for x, c in zip(val, learn, strict=True) if c]), starts, y[learn], 2 * dim, 1e-7)
    z = np.array([float((w[i] * v).sum()) + b for i, v in zip(idx, val, strict=True)])
    held = calibrate if len(set(y[calibrate].tolist())) == 2 else np.ones(len(y), bool)
    slope, offset = platt(z[held], y[held])
    return Model(w.astype(np.float32), b, slope, offset)


def judge(documents: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """(doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept) of every row.

    doc is a struct of the row's own columns, so clashing names do no harm. A null text has no words
    and fails; so does an empty one. quality is the calibrated probability, from the whole text; a row is
    kept when the base rules pass it and quality >= keep. Repeated rows come out each. No shuffle.
    """
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))
    weights, bias, slope, offset, dim = model.weights, model.bias, model.slope, model.offset, len(model.weights) // 2

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, failed, quality = [], [], []
            for text in utf8(batch.column(0).field("text")):
                found, h = base(text or b"", hashes)
                counts.append(found)
                failed.append(found[0] < MIN_WORDS or 100 * found[4] > REPEAT_PERCENT * found[0])
                z = bias
                if dim and text:
                    i, v = frequencies(text, h, dim)
                    z += float(weights[i] @ v)
                quality.append(float(sigmoid(np.float64(slope * z + offset))))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(5)]
            kept = [not f and q >= keep for f, q in zip(failed, quality, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(failed, pa.bool_()), pa.array(quality, pa.float64()), pa.array(kept, pa.bool_())], names=["doc", *names, "base_failed", "quality", "kept"])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType(list(rows.schema.fields))
    for n in names:
        schema = schema.add(n, "long")
    return rows.mapInArrow(part, schema.add("base_failed", "boolean").add("quality", "double").add("kept", "boolean"))


def rules(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id and the judgement of every row."""
    out = judge(documents.select("doc_id", "text"), train(documents, labels, **how))
    return out.select("doc.doc_id", *out.columns[1:])
