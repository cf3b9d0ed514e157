"""Retrieval: rankings (query_id, chunk_id, rank from 1) by sparse n-grams, dense vectors, fusion, reranking.

Queries are the small, stated side. Scores are sums over an equi-join on grams, so that only pairs that share a gram
exist; the chunks a query shares nothing with are ranked after them only on request (``all_chunks``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import coded_frequencies, grams, squeezed, trigram_codes
from ..session import importable, small_batches, stored

#: Query-side rows up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: Distinct grams of all chunks, and numbers of a dense query matrix, up to which tasks get them whole (64 MB each).
BROADCAST_GRAMS, BROADCAST_CELLS = 4_000_000, 8_000_000
#: Texts that are multiplied with all queries at once, numbers that a block of products holds at most, pairs that are summed again at once.
BLOCK, BLOCK_CELLS, PAIRS = 256, 2_000_000, 50_000
NO_TEXT = "the hybrid needs a dense part"


def ranked(scores: DataFrame, top: int | None = None) -> DataFrame:
    """Ranks by falling score, ties by chunk id. A top-k cut goes into the window as a group limit."""
    out = scores.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    return out.filter(F.col("rank") <= top) if top else out


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Halves away from zero, as SQL does."""
    v = np.abs(x) * 10.0**places
    low = np.floor(v)
    return np.copysign((low + (v - low >= 0.5)) / 10.0**places, x)


class Best:
    """Each query's first ``top`` pairs of those seen so far, by falling rounded score and then by id."""

    def __init__(self, n_queries: int, top: int, places: int):
        self.top, self.places, self.margin = top, places, 2 * 10.0**-places
        self.kth = np.full(n_queries, -np.inf)
        self.held: list[list[tuple[float, object]]] = [[] for _ in range(n_queries)]

    def add(self, ids: list, scores: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, seen: np.ndarray | None = None) -> None:
        """``scores``: a row a query, a column an id; off by far less than the last place where ``exact`` gives them again. ``seen``: pairs that count."""
        near = scores >= self.kth[:, None] - self.margin
        if seen is not None:
            near &= seen
        if scores.shape[1] > self.top and np.count_nonzero(near) > 4 * self.top * len(scores):  # only those that can be among the first
            near &= scores >= np.partition(np.where(near, scores, -np.inf), -self.top, axis=1)[:, -self.top, None] - self.margin
        qs, at = np.nonzero(near)
        if not len(qs):
            return
        s = np.concatenate([rounded(exact(qs[k : k + PAIRS], at[k : k + PAIRS]) if exact else scores[qs[k : k + PAIRS], at[k : k + PAIRS]], self.places) for k in range(0, len(qs), PAIRS)])
        own, first = np.unique(qs, return_index=True)
        ends = [*first[1:].tolist(), len(qs)]
        for q, lo, hi in zip(own.tolist(), first.tolist(), ends, strict=True):
            found = self.held[q] + [(-x, ids[k]) for x, k in zip(s[lo:hi].tolist(), at[lo:hi].tolist(), strict=True)]
            found.sort()
            self.held[q] = found[: self.top]
            if len(found) >= self.top:
                self.kth[q] = -self.held[q][-1][0]

    def rows(self, query_ids: list) -> tuple[list, list, list]:
        """query_id, chunk_id, score."""
        got = [(i, c, -s) for i, h in zip(query_ids, self.held, strict=True) for s, c in h]
        return tuple(map(list, zip(*got, strict=True))) if got else ([], [], [])


class Retriever:
    """rank(queries (query_id, q), chunks (chunk_id, text)) -> query_id, chunk_id, rank."""

    name = "retriever"

    def rank(self, queries: DataFrame, chunks: DataFrame, top: int | None = None) -> DataFrame:
        raise NotImplementedError


def shared_grams(queries: DataFrame, chunks: DataFrame, top: int | None = None) -> DataFrame:
    """query_id, chunk_id, score: how many distinct trigrams pairs share, of those that share any; with ``top`` only those that can be among a query's first.

    Tasks meet the stated queries with whole texts, so that no row a gram exists; queries of too many grams are joined instead.
    """
    spark = chunks.sparkSession
    importable(spark)
    small_batches(spark)
    asked = queries.select("query_id", F.expr(squeezed("q")).alias("t"))
    rows = asked.limit(BROADCAST_ROWS + 1).collect()
    sets = [np.unique(trigram_codes(r["t"])) for r in rows]
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]))
    if len(rows) > BROADCAST_ROWS or len(rows) * len(used) > BROADCAST_CELLS:
        own = lambda df, key, text: df.select(key, F.explode(F.array_distinct(grams(text))).alias("gram"))
        return own(queries, "query_id", "q").join(own(chunks, "chunk_id", "text"), "gram").groupBy("query_id", "chunk_id").agg(F.count("*").alias("score"))
    matrix = np.zeros((len(rows), len(used)), np.float32)
    for k, g in enumerate(sets):
        matrix[k, np.searchsorted(used, g)] = 1
    held = spark.sparkContext.broadcast((used, matrix, [r["query_id"] for r in rows]))
    schema = queries.select("query_id").limit(0).crossJoin(chunks.select("chunk_id").limit(0)).withColumn("score", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        used, matrix, ids = held.value
        ids, best = pa.array(ids, kind[0].type), np.zeros((len(ids), top or 0), np.float32)
        for b in batches if len(used) else ():
            for lo in range(0, b.num_rows, BLOCK):
                chunk_ids = b.column(0).slice(lo, BLOCK)
                dense = np.zeros((len(chunk_ids), len(used)), np.float32)
                for k, t in enumerate(b.column(1).slice(lo, BLOCK)):
                    g = np.unique(trigram_codes(t.as_py()))
                    at = np.minimum(np.searchsorted(used, g), len(used) - 1)
                    dense[k, at[used[at] == g]] = 1
                s = matrix @ dense.T
                near = s > 0
                if top:  # a pair behind as many others of its task goes
                    best = np.partition(np.concatenate([best, s], axis=1), -top, axis=1)[:, -top:]
                    near &= s >= best.min(axis=1)[:, None]
                q, c = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), chunk_ids.take(pa.array(c)), pa.array(s[q, c].astype(np.int64))], schema=kind)

    return chunks.select("chunk_id", F.expr(squeezed("text")).alias("t")).mapInArrow(run, schema)


@dataclass
class CharTfidf(Retriever):
    """Cosine of raw term frequency times ln((1 + N) / (1 + df)) + 1 over character n-grams, fitted on the chunks."""

    n: int = 3
    all_chunks: bool = False
    name: str = "char-tfidf"

    def counts(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        return texts.select(key, F.explode(grams(text, self.n)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))

    def weights(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chunk_id, gram, w) of length one, and (gram, idf)."""
        tf = self.counts(chunks, "chunk_id", "text")
        n = chunks.agg(F.count("*").alias("n"))
        idf = tf.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
        return self._unit(tf.join(idf, "gram"), "chunk_id"), idf

    @staticmethod
    def _unit(w: DataFrame, key: str) -> DataFrame:
        w = w.select(key, "gram", (F.col("tf") * F.col("idf")).alias("w"))
        norm = w.groupBy(key).agg(F.greatest(F.sqrt(F.sum(F.col("w") * F.col("w"))), F.lit(1e-9)).alias("norm"))
        return w.join(norm, key).select(key, "gram", (F.col("w") / F.col("norm")).alias("w"))

    def scores(self, queries: DataFrame, chunks: DataFrame) -> DataFrame:
        wanted = self.counts(queries, "query_id", "q")
        tf = self.counts(chunks, "chunk_id", "text")
        n = chunks.agg(F.count("*").alias("n"))
        df = tf.groupBy("gram").agg(F.count("*").alias("df"))
        idf = df.crossJoin(F.broadcast(n)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
        weighted = tf.join(idf, "gram")
        norm = weighted.groupBy("chunk_id").agg(F.greatest(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)), F.lit(1e-9)).alias("norm"))
        query_weights = self._unit(wanted.join(idf, "gram"), "query_id").withColumnRenamed("w", "wq")
        hits = weighted.join(small(query_weights), "gram").groupBy("query_id", "chunk_id").agg(F.sum(F.col("wq") * F.col("tf") * F.col("idf")).alias("dot"))
        return hits.join(norm, "chunk_id").select("query_id", "chunk_id", (F.col("dot") / F.col("norm")).alias("score"))

    def best(self, queries: DataFrame, chunks: DataFrame, top: int, places: int = 9) -> DataFrame:
        """query_id, chunk_id, score (rounded): all pairs that can be among each query's first ``top``, which tasks find from whole texts.

        Two passes over the texts, one for the frequencies; no row a gram or a pair exists. Where the grams or queries are
        too many for each task to hold, the pairs are those of scores().
        """
        spark = chunks.sparkSession
        importable(spark)
        small_batches(spark)
        plain = lambda: self.scores(queries, chunks).withColumn("score", F.round("score", places))
        if self.n != 3:
            return plain()
        df = stored(coded_frequencies(chunks, "text"), "frequencies")
        n_grams, asked = df.count(), queries.select("query_id", F.expr(squeezed("q")).alias("t"))
        if n_grams > BROADCAST_GRAMS or asked.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
            return plain()
        known = df.toArrow().sort_by("code")
        code, n = known["code"].to_numpy(), chunks.count()
        idf = np.log((1 + n) / (1 + known["df"].to_numpy())) + 1

        def weights(t: str | None) -> tuple[np.ndarray, np.ndarray]:
            """Places of a text's known grams, and their weights."""
            g, tf = np.unique(trigram_codes(t), return_counts=True)
            at = np.searchsorted(code, g)
            ok = at < len(code)
            ok[ok] = code[at[ok]] == g[ok]
            return at[ok], tf[ok] * idf[at[ok]]

        rows = asked.collect()
        ids, sparse = [r["query_id"] for r in rows], [weights(r["t"]) for r in rows]
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *(at for at, _ in sparse)]))
        if len(rows) * len(used) > BROADCAST_CELLS:
            return plain()
        column = np.full(len(code), -1, np.int32)
        column[used] = np.arange(len(used), dtype=np.int32)
        matrix = np.zeros((len(rows), len(used)))
        for k, (at, w) in enumerate(sparse):
            matrix[k, column[at]] = w / max(np.sqrt((w * w).sum()), 1e-9)
        held = spark.sparkContext.broadcast((code, idf, column, matrix, ids))
        schema = queries.select("query_id").limit(0).crossJoin(chunks.select("chunk_id").limit(0)).withColumn("score", F.lit(0.0)).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            code, idf, column, matrix, ids = held.value
            found = Best(len(ids), top, places)
            for b in batches:
                for lo in range(0, b.num_rows, BLOCK):
                    chunk_ids = b.column(0).slice(lo, BLOCK).to_pylist()
                    dense, norm = np.zeros((len(chunk_ids), matrix.shape[1])), np.ones(len(chunk_ids))
                    for k, t in enumerate(b.column(1).slice(lo, BLOCK)):
                        g, tf = np.unique(trigram_codes(t.as_py()), return_counts=True)
                        at = np.searchsorted(code, g)
                        w = tf * idf[at]
                        norm[k] = max(np.sqrt((w * w).sum()), 1e-9)
                        c = column[at]
                        dense[k, c[c >= 0]] = w[c >= 0]
                    s = matrix @ dense.T / norm
                    found.add(chunk_ids, s, seen=s > 0)
            kind = to_arrow_schema(schema)
            q, c, s = found.rows(ids)
            yield pa.RecordBatch.from_arrays([pa.array(q, kind[0].type), pa.array(c, kind[1].type), pa.array(s, pa.float64())], schema=kind)

        return chunks.select("chunk_id", F.expr(squeezed("text")).alias("t")).mapInArrow(run, schema)

    def rank(self, queries: DataFrame, chunks: DataFrame, top: int | None = None) -> DataFrame:
        # rounded, so that the order of sums does not decide between equal texts
        s = self.scores(queries, chunks).withColumn("score", F.round("score", 9))
        if self.all_chunks:  # the stated queries against every chunk
            every = chunks.select("chunk_id").join(small(queries.select("query_id")))
            s = every.join(s, ["query_id", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        return ranked(s, top).select("query_id", "chunk_id", "rank")


@dataclass
class DenseDot(Retriever):
    """Dot products of supplied vectors: ``embed`` adds a column ``v`` (array of numbers) to rows with a text column."""

    embed: Callable[[DataFrame, str], DataFrame]
    name: str = "dense"

    def rank(self, queries: DataFrame, chunks: DataFrame, top: int | None = None) -> DataFrame:
        q = self.embed(queries, "q").select("query_id", F.col("v").alias("vq"))
        return ranked(dense_scores(q, self.embed(chunks, "text").select("chunk_id", "v")), top).select("query_id", "chunk_id", "rank")


def dense_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, score of a stated query set (query_id, vq) against all rows (chunk_id, v)."""
    dot = "aggregate(zip_with(vq, v, (a, b) -> cast(a AS double) * b), 0D, (s, x) -> s + x)"
    return chunks.join(small(queries)).select("query_id", "chunk_id", F.expr(dot).alias("score"))


def vector_matrix(a: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix of doubles."""
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(a), -1)


def ordered_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the left as SQL does; a matrix product may add in another order."""
    return np.cumsum(a * b, axis=1)[:, -1]


def dense_best(queries: DataFrame, chunks: DataFrame, top: int, places: int) -> DataFrame:
    """query_id, chunk_id, score (rounded): of dense_scores, the pairs that can be among each query's first ``top``.

    All pairs are multiplied, block by block, but none leaves its task that is behind ``top`` others there. Vectors are of one length.
    """
    spark = chunks.sparkSession
    importable(spark)
    small_batches(spark)
    n = queries.count()
    width = (queries.select(F.size("vq").alias("n")).first() or [0])[0]
    if n * width > BROADCAST_CELLS or n == 0:
        return dense_scores(queries, chunks).withColumn("score", F.round("score", places))
    asked = queries.select("query_id", F.col("vq").cast("array<double>").alias("vq")).toArrow().combine_chunks()
    held = spark.sparkContext.broadcast((asked["query_id"].to_pylist(), vector_matrix(asked["vq"].combine_chunks())))
    schema = queries.select("query_id").limit(0).crossJoin(chunks.select("chunk_id").limit(0)).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        ids, q = held.value
        found = Best(len(ids), top, places)
        step = max(1, min(BLOCK, BLOCK_CELLS // len(ids)))
        for b in batches:
            for lo in range(0, b.num_rows, step):
                v = vector_matrix(b.column(1).slice(lo, step))
                found.add(b.column(0).slice(lo, step).to_pylist(), q @ v.T, lambda qs, at, v=v: ordered_dots(q[qs], v[at]))
        a, c, s = found.rows(ids)
        yield pa.RecordBatch.from_arrays([pa.array(a, kind[0].type), pa.array(c, kind[1].type), pa.array(s, pa.float64())], schema=kind)

    dealt = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select("chunk_id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, schema)


def rounded_sql(x: str, places: int) -> str:
    """rounded() as Spark SQL, to the same bit."""
    v = f"abs({x}) * {10.0**places!r}D"
    return f"signum({x}) * ((floor({v}) + if({v} - floor({v}) >= 0.5D, 1, 0)) / {10.0**places!r}D)"


def exact_ranks(pairs: DataFrame, queries: DataFrame, chunks: DataFrame, places: int) -> DataFrame:
    """query_id, chunk_id, rank among all chunks of stated pairs (query_id, chunk_id, score): tasks count what is ahead of each, by score and then id."""
    spark = chunks.sparkSession
    importable(spark)
    small_batches(spark)
    asked = queries.select("query_id", F.col("vq").cast("array<double>").alias("vq")).toArrow().combine_chunks()
    place = {q: k for k, q in enumerate(asked["query_id"].to_pylist())}
    p = pairs.select("query_id", "chunk_id", "score").toArrow()
    of, ids, score = np.array([place[x] for x in p["query_id"].to_pylist()], np.int64), p["chunk_id"].to_numpy(), p["score"].to_numpy()
    order = np.lexsort((score, of))
    of, ids, score = of[order], ids[order], score[order]
    held = spark.sparkContext.broadcast((vector_matrix(asked["vq"].combine_chunks()), np.searchsorted(of, np.arange(len(place) + 1)), ids, score, list(place), of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, at, ids, score, names, of = held.value
        ahead = np.zeros(len(ids), np.int64)
        step = max(1, min(4 * BLOCK, BLOCK_CELLS // max(1, len(q))))
        for b in batches:
            for lo in range(0, b.num_rows, step):
                own, v = b.column(0).slice(lo, step).to_numpy(zero_copy_only=False), vector_matrix(b.column(1).slice(lo, step))
                s = q @ v.T
                x = np.abs(s) * 10.0**places
                qs, cs = np.nonzero(np.abs(x - np.floor(x) - 0.5) < 1e-4)  # where the order of the sum may decide
                for k in range(0, len(qs), PAIRS):
                    s[qs[k : k + PAIRS], cs[k : k + PAIRS]] = ordered_dots(q[qs[k : k + PAIRS]], v[cs[k : k + PAIRS]])
                s = rounded(s, places)
                for k in range(len(q)):
                    i, j = at[k], at[k + 1]
                    left = np.searchsorted(score[i:j], s[k])
                    ahead[i:j] += np.cumsum(np.bincount(left, minlength=j - i + 1)[::-1])[::-1][1:]
                    same = np.flatnonzero(score[i:j][np.minimum(left, j - i - 1)] == s[k]) if j > i else ()
                    if len(same):
                        ahead[i:j] += ((score[i:j] == s[k][same, None]) & (own[same, None] < ids[i:j])).sum(axis=0)
        for k in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in of[k : k + 100_000]], pa.int64()), pa.array(ids[k : k + 100_000], pa.int64()), pa.array(ahead[k : k + 100_000])], ["query_id", "chunk_id", "n"])

    dealt = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = dealt.select(F.col("chunk_id").cast("long"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "query_id long, chunk_id long, n long")
    return counts.groupBy("query_id", "chunk_id").agg((F.sum("n") + 1).alias("rank"))


def fused_best(parts: list[tuple[DataFrame, DataFrame]], top: int, places: int, k: int = 60) -> DataFrame:
    """query_id, chunk_id, score: of fuse() over whole dense rankings, the pairs that can be among each query's first ``top``. Ids are whole numbers.

    The first ``top`` of one ranking score over 1 / (k + top). A pair behind rank k + 2 * top of every one of two rankings scores less
    than 2 / (2 * k + 2 * top), and so is none of the first. The others' ranks are counted, each against all chunks.
    """
    most = len(parts) * (k + top) - k + 20
    pairs = None
    for q, v in parts:
        first = ranked(dense_best(q, v, most, places), most).select("query_id", "chunk_id")
        pairs = first if pairs is None else pairs.unionByName(first)
    pairs = stored(pairs.distinct(), "pairs")
    dot = "aggregate(zip_with(vq, v, (a, b) -> cast(a AS double) * b), 0D, (s, x) -> s + x)"
    ranks = []
    for q, v in parts:
        scored = pairs.join(q, "query_id").join(v, "chunk_id").select("query_id", "chunk_id", F.expr(dot).alias("dot")).select("query_id", "chunk_id", F.expr(rounded_sql("dot", places)).alias("score"))
        ranks.append(exact_ranks(scored, q, v, places))
    return fuse(ranks, k).drop("rank")


def fuse(rankings: list[DataFrame], k: int = 60, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank)."""
    each = None
    for r in rankings:
        r = r.select("query_id", "chunk_id", "rank")
        each = r if each is None else each.unionByName(r)
    fused = each.groupBy("query_id", "chunk_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))
    return ranked(fused, top)


@dataclass
class HybridRRF(Retriever):
    parts: list[Retriever] = field(default_factory=list)
    k: int = 60
    name: str = "hybrid-rrf"

    def rank(self, queries: DataFrame, chunks: DataFrame, top: int | None = None) -> DataFrame:
        return fuse([p.rank(queries, chunks) for p in self.parts], self.k, top).select("query_id", "chunk_id", "rank")


@dataclass
class Reranked(Retriever):
    """The first ``top_n`` of a base ranking in the order of a pair scorer; the rest keep their ranks.

    ``pair_score`` adds ``pair_score`` to rows (query_id, q, chunk_id, text); a pandas UDF is its place for a model.
    """

    base: Retriever
    pair_score: Callable[[DataFrame], DataFrame]
    top_n: int = 30
    name: str = "reranked"

    def rank(self, queries: DataFrame, chunks: DataFrame, top: int | None = None) -> DataFrame:
        r = self.base.rank(queries, chunks)
        head = r.filter(F.col("rank") <= self.top_n)
        pairs = chunks.select("chunk_id", "text").join(small(head), "chunk_id").join(small(queries.select("query_id", "q")), "query_id")
        scored = self.pair_score(pairs).select("query_id", "chunk_id", F.col("rank").alias("was"), "pair_score")
        again = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("pair_score"), "was"))).select("query_id", "chunk_id", "rank")
        out = again.unionByName(r.filter(F.col("rank") > self.top_n).select("query_id", "chunk_id", "rank"))
        return out.filter(F.col("rank") <= top) if top else out


def letter_counts() -> DenseDot:
    """A stand-in for a sentence model: vectors of how often each letter a-z stands in the text. Deterministic, whole numbers."""
    count = "transform(sequence(97, 122), i -> length(lower({0})) - length(replace(lower({0}), chr(i), '')))"
    return DenseDot(lambda df, text: df.withColumn("v", F.expr(count.format(text))), "letter-counts")


def length_gap(pairs: DataFrame) -> DataFrame:
    """A stand-in for a cross-encoder: texts as long as the query come first."""
    return pairs.withColumn("pair_score", -F.abs(F.length("q") - F.length("text")))


def build_retriever(dense: Retriever | None = None, hybrid: bool = False, pair_score: Callable[[DataFrame], DataFrame] | None = None, top_n: int = 30) -> Retriever:
    """Compose a retriever from options: lexical by default, dense, both fused, and reranked."""
    if hybrid and dense is None:
        raise ValueError(NO_TEXT)
    base = HybridRRF([CharTfidf(all_chunks=True), dense]) if hybrid else dense or CharTfidf()
    return Reranked(base, pair_score, top_n) if pair_score else base


def describe(r: Retriever) -> str:
    if isinstance(r, HybridRRF):
        return "RRF(" + " + ".join(describe(p) for p in r.parts) + ")"
    if isinstance(r, Reranked):
        return f"rerank top {r.top_n} of {describe(r.base)}"
    return r.name


def with_used(ranks: DataFrame, lengths: DataFrame) -> DataFrame:
    """query_id, chunk_id, rank, used: characters of a ranking's chunks down to each rank. ``lengths``: chunk_id, len."""
    order = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return ranks.join(lengths, "chunk_id").withColumn("used", F.sum("len").over(order)).select("query_id", "chunk_id", "rank", "used")


def within_budget(ranks: DataFrame, lengths: DataFrame, budget: int) -> DataFrame:
    """query_id, chunk_id, rank, used: the prefix of each ranking that a budget of characters holds; the first always fits.

    Lengths are positive, so running sums grow and the prefix ends where one passes the budget.
    """
    return with_used(ranks, lengths).filter((F.col("used") <= budget) | (F.col("rank") == 1))
