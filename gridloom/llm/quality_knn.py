"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms of a text are its words and, in a block of their own, shapes: each word with letters and digits folded to classes,
words that repeat the one before, and the share of different words in steps. Both blocks are hashed, weighted by
log tf and idf, and scaled to length one. A bounded sample of labelled rows gives the idf and a truncated SVD; its vectors and
labels are broadcast. Every document is projected, its cosines with all labelled vectors are computed exactly
in blocks, and the K nearest vote by a power of their likeness.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, spark_of, texts
from .toxicity import fold, labelled

#: Labelled rows that the model is fitted on, at most; the smallest by hash of their id.
MAX_TRAIN = 3_000
WORDS, SHAPES = 2048, 1024
DIMS = 48
NEIGHBOURS = 15
POWER = 8
WORD_WEIGHT = 0.3
BLOCK = 128


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # terms x dims
    vectors: np.ndarray  # rows x dims, of length one
    labels: np.ndarray
    mean: float


class Terms(dict):
    """Word to its two hashed terms, packed; kept up to a number."""

    def __missing__(self, word: str) -> int:
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "0", re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a" if m[0][0].islower() or len(m[0]) == 1 else "Aa", word)))
        code = zlib.crc32(word.lower().strip(".,;:!?").encode("utf-8", "surrogatepass")) % WORDS << 16 | zlib.crc32(shape.encode("utf-8", "surrogatepass")) % (SHAPES - 64)
        if len(self) > 200_000:
            self.clear()
        self[word] = code
        return code


def counts(text: str, terms: Terms) -> np.ndarray:
    """Term counts of a text: words, then shapes; the last 64 shapes are measures in steps."""
    out = np.zeros(WORDS + SHAPES, np.float32)
    words = text.split()
    n = len(words)
    if n:
        codes = np.fromiter(map(terms.__getitem__, words), np.int64, n)
        out[:WORDS] = np.bincount(codes >> 16, minlength=WORDS)
        out[WORDS:] = np.bincount(codes & 0xFFFF, minlength=SHAPES)
        different = len(set(words)) / n
        again = float(np.mean(codes[1:] == codes[:-1])) if n > 1 else 0.0
        out[-64 + min(19, int(different * 20))] = n
        out[-40 + min(19, int(again * 20))] = n
    out[-20 + min(15, n.bit_length())] = max(1, n) ** 0.5
    return out


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x) * idf
    w, s = x[:, :WORDS], x[:, WORDS:]
    w = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9) * WORD_WEIGHT
    s = s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-9)
    return np.hstack([w, s]).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def truncated_basis(a: np.ndarray, dims: int, rounds: int = 4) -> np.ndarray:
    """Right singular vectors by randomized subspace iteration with a fixed start."""
    rng = np.random.default_rng(7)
    q = rng.standard_normal((a.shape[1], min(dims + 10, *a.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
    return (q @ vt.T)[:, :dims].astype(np.float32)


def fit(train: DataFrame) -> Model:
    """The model of rows (text, y). Without rows every score is 0.5."""

    def make():
        terms = Terms()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for t in b.column(1).to_pylist():
                x = counts(t, terms)
                at = np.flatnonzero(x)
                rows.append(at.astype(np.int32).tobytes() + x[at].tobytes())
            return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

        return step

    rows = sorted(map_batches(train, make, "doc_id long, y int, x binary").collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    width = WORDS + SHAPES
    if not rows:
        return Model(np.ones(width, np.float32), np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    x = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        half = len(r["x"]) // 2
        x[i, np.frombuffer(r["x"][:half], np.int32)] = np.frombuffer(r["x"][half:], np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.2).astype(np.float32)
    a = weighted(x, idf)
    basis = truncated_basis(a, DIMS)
    y = np.array([float(r["y"] == 1) for r in rows])
    return Model(idf, basis, unit(a @ basis).astype(np.float32), y, float(y.mean()))


def vote(model: Model, x: np.ndarray) -> np.ndarray:
    """Score of each row of term counts. Of equal cosines at the last place any may vote; their labels count alike, as their weights are equal."""
    if not len(model.vectors):
        return np.full(len(x), model.mean)
    q = unit(weighted(x, model.idf) @ model.basis)
    cosines = q @ model.vectors.T
    k = min(NEIGHBOURS, cosines.shape[1])
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-3).astype(np.float64) ** POWER
    return (weight * model.labels[near]).sum(1) / weight.sum(1)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row.

    A null text is empty: it is judged by its length alone. Repeated rows and rows of one id are scored each by itself; an empty table gives none.
    """
    small_batches(spark_of(docs))
    held = spark_of(docs).sparkContext.broadcast(model)

    def make():
        terms, m = Terms(), held.value

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts_ = [t or "" for t in b.column(1).to_pylist()]
            out = [vote(m, np.stack([counts(t, terms) for t in texts_[i : i + BLOCK]])) for i in range(0, len(texts_), BLOCK)]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out), pa.float64())], ["doc_id", "score"])

        return step

    return map_batches(texts(docs, id_col, text_col), make, "doc_id long, score double")


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned outside fold 0 of 5, for every document."""
    model = fit(labelled(docs, labels, "quality", fold(5) == 0, MAX_TRAIN))
    return score(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
