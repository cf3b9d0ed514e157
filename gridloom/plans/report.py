"""The whole evaluation: structure, retrieval by strategy, shuffled control; and extraction by an injected backend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantity import with_same_value
from ..operators.chunk import MAX_CHARS, STRATEGIES
from ..operators.evalset import gen_queries, shuffle_cells
from ..operators.extract import extract
from ..operators.grid import tables
from ..operators.invariants import header_kinds, invariants, span_kinds, structure_summary, table_shapes
from ..operators.retrieve import CharTfidf, Retriever, within_budget
from ..operators.scoring import score
from ..session import stored

PROMPT = "다음 자료만 보고 답하라. 값만 쓰고, 없으면 NONE 이라고 쓴다.\n\n{context}\n\n질문: {q}\n답:"
REACTS, FLOOR = 0.05, 0.05


def chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", F.concat_ws("-", "doc_id", F.lpad(F.col("chunk_no").cast("string"), 8, "0")))


def structure_report(pages: DataFrame, max_chars: int = MAX_CHARS) -> dict[str, DataFrame]:
    """Checks that need no labels, summed up without any text of the documents."""
    e = stored(extract(pages), "extracted")
    t = stored(tables(e), "tables")
    inv = invariants(e, t, STRATEGIES["stc"](e, max_chars, t))
    return {"per_document": inv, "summary": structure_summary(inv), "headers": header_kinds(t), "shapes": table_shapes(t), "spans": span_kinds(e)}


def retrieval_report(pages: DataFrame, retriever: Retriever | None = None, max_chars: int = MAX_CHARS, names: list[str] | None = None, per_table: int = 6) -> DataFrame:
    """A row of scores a strategy, with the mean reciprocal rank on shuffled cells and what the difference says.

    The retriever is fitted on each strategy's own chunks. Queries always come from the documents as they are.
    """
    retriever = retriever or CharTfidf()
    e = stored(extract(pages), "extracted")
    t = stored(tables(e), "tables")
    queries = stored(gen_queries(e, t, per_table), "queries")
    mixed = shuffle_cells(e)
    mixed_tables = stored(tables(mixed), "tables")
    out = None
    for name in names or STRATEGIES:
        own = stored(chunk_ids(STRATEGIES[name](e, max_chars, t)), "chunks")
        control = stored(chunk_ids(STRATEGIES[name](mixed, max_chars, mixed_tables)), "chunks")
        row = score(queries, own, retriever).join(score(queries, control, retriever).select(F.col("mrr").alias("mrr_shuffled")))
        row = row.withColumn("strategy", F.lit(name))
        out = row if out is None else out.unionByName(row)
    delta = F.col("mrr") - F.col("mrr_shuffled")
    verdict = F.when(F.col("mrr") < FLOOR, "floor").when(delta > REACTS, "reacts").otherwise("does not react")
    return out.withColumns({"delta_mrr": delta, "verdict": verdict})


def contexts(ranks: DataFrame, chunks: DataFrame, budget: int = 3000) -> DataFrame:
    """query_id, context: what an answering model is shown, in rank order within the budget."""
    shown = chunks.select("chunk_id", F.coalesce(F.when(F.col("context") != "", F.col("context")), F.col("text")).alias("shown"))
    inside = within_budget(ranks, shown.select("chunk_id", F.length("shown").alias("len")), budget)
    return inside.join(shown, "chunk_id").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "shown"))), lambda x: x["shown"]), "\n\n").alias("context"))


def prompts(queries: DataFrame, shown: DataFrame) -> DataFrame:
    """query_id, answer, prompt. Write it before a paid backend reads it, so that a retried task asks nothing twice."""
    head, middle, tail = PROMPT.replace("{q}", "{context}").split("{context}")
    joined = queries.join(shown, "query_id", "left")
    return joined.select("query_id", "answer", F.concat(F.lit(head), F.coalesce("context", F.lit("")), F.lit(middle), "q", F.lit(tail)).alias("prompt"))


def shown_answer(p: DataFrame) -> DataFrame:
    """A stand-in for a model: the answer where the prompt shows it, else NONE."""
    return p.withColumn("reply", F.when(F.contains("prompt", "answer"), F.col("answer")).otherwise("NONE"))


#: Answering backends by name: a function from rows (query_id, answer, prompt) to the same with ``reply``.
BACKENDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "gold": lambda p: p.withColumn("reply", F.col("answer")),
    "none": lambda p: p.withColumn("reply", F.lit("NONE")),
    "shown": shown_answer,
}


def extraction_prompts(pages: DataFrame, retriever: Retriever | None = None, max_chars: int = MAX_CHARS, budget: int = 3000, most: int | None = None, per_table: int = 6, names: list[str] | None = None) -> dict[str, DataFrame]:
    """query_id, answer, prompt by strategy, written once for all backends. ``most`` caps the queries of a paid run."""
    retriever = retriever or CharTfidf()
    e = stored(extract(pages), "extracted")
    t = stored(tables(e), "tables")
    queries = gen_queries(e, t, per_table)
    queries = stored(queries.orderBy("query_id").limit(most) if most else queries, "queries")
    out = {}
    for name in names or STRATEGIES:
        chunks = stored(chunk_ids(STRATEGIES[name](e, max_chars, t)), "chunks")
        # no chunk is empty, so that a budget of characters holds no more of them; the first counts in any case
        ranks = retriever.rank(queries.select("query_id", "q"), chunks.select("chunk_id", "text"), max(budget, 1))
        out[name] = stored(prompts(queries, contexts(ranks, chunks, budget)), "prompts")
    return out


def judged(asked: dict[str, DataFrame], backend: str | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """strategy, n, accuracy: share of prompts whose reply names the answer's value."""
    ask = BACKENDS[backend] if isinstance(backend, str) else backend
    out = None
    for name, p in asked.items():
        same = with_same_value(ask(p), "reply", "answer")
        row = same.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("same").cast("double")), F.lit(0.0)).alias("accuracy")).withColumn("strategy", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def extraction_accuracy(pages: DataFrame, backend: str | Callable[[DataFrame], DataFrame], retriever: Retriever | None = None, max_chars: int = MAX_CHARS, budget: int = 3000, most: int | None = None, per_table: int = 6, names: list[str] | None = None) -> DataFrame:
    """strategy, n, accuracy: share of queries whose reply names the answer's value. ``most`` caps the queries of a paid run."""
    return judged(extraction_prompts(pages, retriever, max_chars, budget, most, per_table, names), backend)
