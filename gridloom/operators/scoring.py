"""Scores of a ranking against recoverable answers, by fixed k and by context budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .evalset import gold
from .retrieve import Retriever, with_used

BUDGETS, KS = (1200, 3000), (1, 5)


def score(queries: DataFrame, chunks: DataFrame, retriever: Retriever, budgets: tuple[int, ...] = BUDGETS, ks: tuple[int, ...] = KS, found: DataFrame | None = None) -> DataFrame:
    """One row of metrics: row_destruction, rec_<budget>, r_<k>, mrr, density, distractors, n_chunks, mean_chars.

    Every share is of all queries, those that no chunk can answer included. Density is the answer row's length
    over what the first budget used, where it hit. ``chunks``: chunk_id, chunk_no, text.
    """
    g = stored(gold(queries, chunks), "gold") if found is None else found
    ranks = retriever.rank(queries.select("query_id", "q"), chunks.select("chunk_id", "text"))
    run = with_used(ranks, chunks.select("chunk_id", F.length("text").alias("len"))).join(g.select("query_id", "chunk_id", F.lit(1).alias("gold")), ["query_id", "chunk_id"], "left")
    inside = {b: (F.col("used") <= b) | (F.col("rank") == 1) for b in budgets}
    hits = [F.max(F.when(inside[b], F.col("gold"))).alias(f"hit_{b}") for b in budgets] + [F.max(F.when(inside[b], F.col("used"))).alias(f"used_{b}") for b in budgets]
    at = run.groupBy("query_id").agg(F.min(F.when(F.col("gold") == 1, F.col("rank"))).alias("first"), *hits)
    own = g.groupBy("query_id").agg(F.min_by("distractors", F.when(F.col("distractors").isNotNull(), F.col("chunk_no"))).alias("distractors"), F.lit(True).alias("has_gold"))
    per_query = queries.select("query_id", "row_chars").join(own, "query_id", "left").join(at, "query_id", "left")
    n = F.greatest(F.lit(1), F.count("*"))
    share = lambda c: (F.sum(F.coalesce(c, F.lit(0))) / n)
    out = per_query.agg(
        share(F.col("has_gold").isNull().cast("int")).alias("row_destruction"),
        *[share(F.col(f"hit_{b}")).alias(f"rec_{b}") for b in budgets],
        *[share((F.col("first") <= k).cast("int")).alias(f"r_{k}") for k in ks],
        share(1 / F.col("first")).alias("mrr"),
        share(F.when(F.col(f"hit_{budgets[0]}") == 1, F.col("row_chars") / F.greatest(F.lit(1), F.col(f"used_{budgets[0]}")))).alias("density"),
        F.coalesce(F.avg("distractors"), F.lit(0.0)).alias("distractors"),
    )
    size = chunks.agg(F.count("*").alias("n_chunks"), F.round(F.avg(F.length("text"))).cast("long").alias("mean_chars"))
    return out.join(F.broadcast(size))


def melted(scores: DataFrame, ids: list[str]) -> DataFrame:
    """Metrics as rows: ids, metric, value."""
    values = [c for c in scores.columns if c not in ids]
    return scores.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(ids, values, "metric", "value")
