"""Toxicity by maximum-scoring segment search.

Fit: on a bounded sample of labelled rows, each word and each prefix of it gets a log-odds ratio of toxic against
other documents, smoothed by an informative Dirichlet prior, with its z-score. A word scores the log-odds of its
most certain significant form, any other word a fixed penalty. A linear scan (Ruzzo and Tompa) finds all
maximal segments of positive score. Their scores are calibrated by the extreme-value law: lambda solves sum p e^(lambda s) = 1 over
the scores of clean text, K is the rate of segments there above their median score, and a segment is significant when the number
expected by chance, K m e^(-lambda S), is small. A logistic curve over calibrated scores alone - what the best segment is worth, how many are
significant, what those are worth together, and by how much the r-th best of all segments is above what the law expects of the r-th - gives
the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, spark_of, stored, texts

#: Labelled rows that the model is fitted on, at most; the smallest by hash of their id.
MAX_TRAIN = 8_000
#: Bound of the broadcast: the most certain forms, were there more.
MAX_FEATURES = 100_000
MIN_SUPPORT = 4
MIN_Z = 4.0
PREFIXES = range(3, 9)
PRIOR = 50.0
PENALTY = -0.6
SIGNIFICANT = 0.05
WORD = re.compile(r"[^\W\d_]+")


def forms(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in PREFIXES if n < len(word))]


@dataclass
class Model:
    scores: dict[str, tuple[float, float]]  # form: log-odds, z
    rate: float  # lambda of the extreme-value law
    k: float
    weights: list[float]


def maximal_segments(scores: list[tuple[int, float]], n: int, penalty: float = PENALTY) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of n tokens, of which ``scores`` names the positive ones in order.

    The list of Ruzzo and Tompa: each candidate keeps the running total before it and at its end, and a link back to the last
    candidate with a smaller total before it; what the link skips can never be joined again, which makes the scan linear. Between
    positive tokens the total falls by the penalty a token, so that only positive tokens need a step.
    """
    found: list[tuple[int, int, float, float]] = []  # start, end, total before, total at the end
    back: list[int] = []
    total, at = 0.0, 0
    for place, s in scores:
        total += penalty * (place - at)
        left, start = total, place
        total += s
        at = place + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = back[j]
            if j < 0 or found[j][3] >= total:
                break
            start, left = found[j][0], found[j][2]
            at_, j = j, back[j]
            del found[at_:], back[at_:]
        found.append((start, at, left, total))
        back.append(j)
    return [(a, b, r - left) for a, b, left, r in found]


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.known: dict[str, float] = {}

    def word(self, w: str) -> float:
        """Log-odds of the most certain form that counts, else 0."""
        best, z = 0.0, 0.0
        for f in forms(w):
            if (x := self.m.scores.get(f)) and x[1] > z:
                best, z = x
        return best

    def positives(self, text: str) -> tuple[list[tuple[int, float]], int]:
        words = WORD.findall(text.lower())
        known = self.known
        if len(known) > 300_000:
            known.clear()
        out = []
        for i, w in enumerate(words):
            s = known.get(w)
            if s is None:
                s = known[w] = self.word(w)
            if s:
                out.append((i, s))
        return out, len(words)

    def evidence(self, text: str) -> tuple[list[float], list[tuple[int, int, float]], int, int]:
        """Features of a document, its significant segments, its numbers of words and of segments."""
        positives, n = self.positives(text)
        segments = maximal_segments(positives, n)
        chance = math.log(self.m.k * max(1, n))  # log of the segments of score 0 or more that a clean text of n words has
        worth = [(a, e, self.m.rate * s - chance) for a, e, s in segments]  # minus the log of the number expected by chance
        limit = -math.log(SIGNIFICANT)
        sure = [(a, e, s) for (a, e, s), w in zip(segments, worth, strict=True) if w[2] >= limit]
        values = [w[2] for w in worth]
        best = max(0.0, max(values, default=0.0))
        # all segments together: their sum against what the law expects of as many of a clean text, order by order
        ranked = sorted(values, reverse=True)
        total = sum(v + math.log(r) for r, v in enumerate(ranked, 1) if v + math.log(r) > 0)
        return [1.0, min(best, 20.0), math.log1p(len(sure)), math.log1p(sum(v for v in values if v >= limit)), math.log1p(total)], sure, n, len(segments)

    def score(self, features: list[float]) -> float:
        x = sum(a * b for a, b in zip(self.m.weights, features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def labelled(docs: DataFrame, labels: DataFrame, label: str, skip: F.Column, most: int) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled rows outside ``skip`` (a predicate on doc_id); the label of an id given twice is the larger."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~skip)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return stored(texts(docs).join(F.broadcast(rows), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y"), "labelled")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> list[float]:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, g)
    return [float(v) for v in w]


def solve_rate(values: list[float], shares: list[float]) -> float:
    """lambda > 0 with sum p e^(lambda s) = 1; the mean of s is negative."""
    low, high = 0.0, 1.0
    f = lambda t: sum(p * math.exp(min(700.0, t * s)) for p, s in zip(shares, values, strict=True)) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(1e-3, high)


def fit(train: DataFrame) -> Model:
    """The model of rows (text, y). Without any toxic row every score is near the rate of toxic rows."""

    def count():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            toxic, other = Counter(), Counter()
            for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                (toxic if y else other).update({f for w in set(WORD.findall(t.lower())) for f in forms(w)})
            seen = list(toxic.keys() | other.keys())
            return pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([toxic[f] for f in seen], pa.int64()), pa.array([other[f] for f in seen], pa.int64())], ["form", "t", "o"])

        return step

    sums = map_batches(train, count, "form string, t long, o long").groupBy("form").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    nt, no = sizes.get(1, 0), sum(n for y, n in sizes.items() if y != 1)
    prior = (F.col("t") + F.col("o")) / F.lit(float(max(1, nt + no))) * PRIOR
    odds = lambda x, n: F.log((F.col(x) + prior) / (F.lit(n + PRIOR) - F.col(x) - prior + 1e-9))
    ranked = sums.filter(F.col("t") >= MIN_SUPPORT).withColumn("d", odds("t", nt) - odds("o", no)).withColumn("z", F.col("d") / F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("o") + prior)))
    top = ranked.filter((F.col("z") >= MIN_Z) & (F.col("d") > 1)).orderBy(F.desc("z"), "form").limit(MAX_FEATURES).collect()
    model = Model({r["form"]: (r["d"], r["z"]) for r in top}, 1.0, 0.1, [0.0] * 5)

    def survey():
        scorer = Scorer(model)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scorer.positives(t) for t in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(2), pa.array([n for _, n in rows], pa.int64()), pa.array([[s for _, s in p] for p, _ in rows], pa.list_(pa.float64())), pa.array([[s[2] for s in maximal_segments(p, n)] for p, n in rows], pa.list_(pa.float64()))], ["y", "n", "hits", "segments"])

        return step

    clean = [r for r in map_batches(train, survey, "y int, n long, hits array<double>, segments array<double>").filter("y = 0").collect()]
    words = max(1, sum(r["n"] for r in clean))
    hits = Counter(round(s, 2) for r in clean for s in r["hits"])
    rest = words - sum(hits.values())
    model.rate = solve_rate([PENALTY, *hits], [rest / words, *(c / words for c in hits.values())]) if hits else 1.0
    levels = sorted(s for r in clean for s in r["segments"])
    if levels:
        middle = levels[len(levels) // 2]
        above = len(levels) - len(levels) // 2
        model.k = min(1.0, above / words * math.exp(min(30.0, model.rate * middle)))

    def measure():
        scorer = Scorer(model)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(2), pa.array([scorer.evidence(t)[0] for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

        return step

    rows = map_batches(train, measure, "y int, x array<double>").collect()
    if rows:
        model.weights = logistic(np.array([r["x"] for r in rows]), np.array([float(r["y"] == 1) for r in rows]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_words, segments (start, end, score of each significant passage) for every row.

    A null text is empty: it has no segments and the score of a text without any. Repeated rows and rows of one id are scored each by itself.
    """
    small_batches(spark_of(docs))
    held = spark_of(docs).sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def make():
        scorer = Scorer(held.value)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scorer.evidence(t or "") for t in b.column(1).to_pylist()]
            segments = [[{"start": a, "end": e, "score": s} for a, e, s in r[1]] for r in rows]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(r[0]) for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(segments, kind)], ["doc_id", "score", "n_words", "segments"])

        return step

    return map_batches(texts(docs, id_col, text_col), make, "doc_id long, score double, n_words long, segments array<struct<start:long,end:long,score:double>>")


def fold(modulus: int) -> F.Column:
    """crc32 of doc_id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_segments: learned outside fold 2 of 4, for every document."""
    model = fit(labelled(docs, labels, "toxic", fold(4) == 2, MAX_TRAIN))
    return score(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("segments").cast("long").alias("n_segments"))
