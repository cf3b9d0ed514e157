"""Checks that hold for any document without labels, structural fingerprints, and twin comparison."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from ..functions.find import standing
from ..session import importable, small_batches
from .extract import source_cells
from .grid import units

TOP_TAGS, TOP_SPANS = 25, 15
#: Least share of a document's tokens that chunks must hold, failing documents that a summary names.
COVERAGE, MOST_FAILED = 0.98, 10


def conservation(extracted: DataFrame, t: DataFrame) -> DataFrame:
    """doc_id, table_id, covered, claimed: places that hold a cell, and the sum of what the spans claim; unequal where spans overlap."""
    claimed = source_cells(extracted).groupBy("doc_id", "table_id").agg(F.sum(F.col("rowspan") * F.col("colspan")).alias("claimed"))
    covered = t.filter("size(grid) > 0").select("doc_id", "table_id", F.expr("size(filter(flatten(grid), x -> x.o_r >= 0))").cast("long").alias("covered"))
    return covered.join(claimed, ["doc_id", "table_id"], "left").withColumn("claimed", F.coalesce("claimed", F.lit(0)))


def token_losses(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, n_tokens, lost: how many distinct tokens texts (doc_id, text) have, and those that stand, as substrings, in no chunk of the document, sorted.

    A document's chunk text is gathered once, next to its own; tokens that are no word of it are looked for together.
    """
    importable(texts.sparkSession)
    small_batches(texts.sparkSession, mb=8)
    blob = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "text"))), lambda x: x["text"]), " ").alias("blob"))
    both = texts.select("doc_id", "text").join(blob, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")), F.coalesce("blob", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_tokens, lost = [], []
            for own, there in zip(b.column(1), b.column(2), strict=True):
                there = there.as_py()
                tokens = set(own.as_py().split(" ")) - {""}
                n_tokens.append(len(tokens))
                rest = sorted(tokens.difference(there.split(" ")))
                ok = standing(rest, [there])
                lost.append([w for w in rest if w not in ok])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_tokens, pa.int64()), pa.array(lost, pa.list_(pa.string()))], ["doc_id", "n_tokens", "lost"])

    return both.mapInArrow(run, StructType([texts.schema["doc_id"], StructField("n_tokens", LongType()), StructField("lost", ArrayType(StringType()))]))


def missing_tokens(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, token: a row for each token that token_losses has."""
    return token_losses(texts, chunks).select("doc_id", F.explode("lost").alias("token"))


def unbroken_rows(t: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, row_atomic: whether every unit of every data table stands whole in one chunk of that table."""
    importable(t.sparkSession)
    small_batches(t.sparkSession, mb=8)
    u = units(t.filter("is_data")).groupBy("doc_id", "table_id").agg(F.collect_list("unit").alias("units"))
    owned = chunks.filter("table_id >= 0").groupBy("doc_id", "table_id").agg(F.collect_list("text").alias("texts"))
    both = u.join(owned, ["doc_id", "table_id"], "left").select("doc_id", "units", F.coalesce("texts", F.expr("cast(array() AS array<string>)")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for own, texts in zip(b.column(1), b.column(2), strict=True):
                texts = texts.as_py()
                rest = set(own.as_py()).difference(*(c.split("\n") for c in texts))
                ok.append(standing(sorted(rest), texts) == rest)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ok, pa.bool_())], ["doc_id", "ok"])

    held = both.mapInArrow(run, StructType([t.schema["doc_id"], StructField("ok", BooleanType())]))
    return held.groupBy("doc_id").agg(F.min("ok").alias("row_atomic"))


def invariants(extracted: DataFrame, t: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row a document: rectangular, cell_conservation, text_coverage, missing_tokens (first ten by order), row_atomic, n_chunks, n_tables, oversize_chunks."""
    rect = t.filter("size(grid) > 0").groupBy("doc_id").agg(F.min(F.expr("array_min(transform(grid, r -> size(r))) = array_max(transform(grid, r -> size(r)))")).alias("rectangular"))
    kept = conservation(extracted, t).groupBy("doc_id").agg(F.min(F.col("covered") == F.col("claimed")).alias("cell_conservation"))
    texts = extracted.select("doc_id", F.col("body_text").alias("text"))
    lost = token_losses(texts, chunks).select("doc_id", "n_tokens", F.size("lost").cast("long").alias("n_missing"), F.slice("lost", 1, 10).alias("missing_tokens"))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if("oversize").alias("oversize_chunks"))
    base = extracted.select("doc_id", F.size("tables").cast("long").alias("n_tables"))
    out = base
    for part in (rect, kept, lost, unbroken_rows(t, chunks), counts):
        out = out.join(part, "doc_id", "left")
    true, zero = F.lit(True), F.lit(0).cast("long")
    return out.select(
        "doc_id", F.coalesce("rectangular", true).alias("rectangular"), F.coalesce("cell_conservation", true).alias("cell_conservation"),
        (1 - F.coalesce("n_missing", zero) / F.greatest(F.lit(1), F.coalesce("n_tokens", zero))).alias("text_coverage"), F.coalesce("missing_tokens", F.expr("cast(array() AS array<string>)")).alias("missing_tokens"),
        F.coalesce("row_atomic", true).alias("row_atomic"), F.coalesce("n_chunks", zero).alias("n_chunks"), "n_tables", F.coalesce("oversize_chunks", zero).alias("oversize_chunks"),
    )


def structure_summary(inv: DataFrame) -> DataFrame:
    """One row over all documents: how many pass each check, mean and least coverage and the document of the least, and the first ten that fail any."""
    failing = (~F.col("rectangular")) | (~F.col("cell_conservation")) | (~F.col("row_atomic")) | (F.col("text_coverage") <= COVERAGE)
    passed = [F.sum(F.col(c).cast("long")).alias(f"n_{c}") for c in ("rectangular", "cell_conservation", "row_atomic")]
    return inv.agg(F.count("*").alias("n_docs"), *passed, F.avg("text_coverage").alias("mean_coverage"), F.min("text_coverage").alias("min_coverage"), F.min_by("doc_id", F.struct("text_coverage", "doc_id")).alias("worst_doc"), F.sum("n_tables").alias("n_tables"), F.sum("n_chunks").alias("n_chunks"), F.sum("oversize_chunks").alias("oversize_chunks"), F.slice(F.sort_array(F.collect_list(F.when(failing, F.col("doc_id")))), 1, MOST_FAILED).alias("failed"))


def header_kinds(t: DataFrame, top: int = 8) -> DataFrame:
    """n_header, hc, is_crosstab, n of the most frequent; ties by the values."""
    return t.filter("size(grid) > 0").groupBy("n_header", "hc", "is_crosstab").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "n_header", "hc", "is_crosstab").limit(top)


def table_shapes(t: DataFrame, top: int = 6) -> DataFrame:
    return t.filter("size(grid) > 0").groupBy("n_rows", "n_cols").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "n_rows", "n_cols").limit(top)


def span_kinds(extracted: DataFrame, top: int = 8) -> DataFrame:
    return source_cells(extracted).groupBy("rowspan", "colspan").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rowspan", "colspan").limit(top)


def tag_counts(extracted: DataFrame) -> DataFrame:
    """tag, n over all documents."""
    return extracted.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def counted_sql(values: str, top: int) -> str:
    """An array's most frequent values with their counts, ties by value: array<struct<n, v>>."""
    return f"slice(array_sort(transform(array_distinct({values}), v -> named_struct('n', -size(filter({values}, w -> w = v)), 'v', v))), 1, {top})"


def fingerprints(extracted: DataFrame, t: DataFrame) -> DataFrame:
    """A structural profile a document, without its text: tags, spans, shapes, headers, flags."""
    shapes = t.filter("size(grid) > 0").groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("table_id", F.array("n_rows", "n_cols").alias("s")))), lambda x: x["s"]).alias("table_shapes"),
        F.array_sort(F.collect_list(F.format_string("행%d/열%d/교차%d", "n_header", "hc", F.col("is_crosstab").cast("int")))).alias("header_shapes"),
    )
    as_map = "map_from_entries(transform({}, x -> struct(x.v, -x.n)))"
    own = extracted.select("doc_id", F.expr(as_map.format(counted_sql("tags", TOP_TAGS))).alias("tags"), F.expr(as_map.format(counted_sql("raw_spans", TOP_SPANS))).alias("spans"), F.expr("aggregate(tables, 0, (s, x) -> s + x.n_nested)").alias("nested_tables"), F.col("body_chars").alias("chars"), F.col("body_nfd").alias("nfd"), F.col("body_fullwidth").alias("fullwidth"), F.array_contains("tags", "th").alias("has_th"), "mso")
    none = F.expr("cast(array() AS array<array<int>>)"), F.expr("cast(array() AS array<string>)")
    return own.join(shapes, "doc_id", "left").withColumns({"table_shapes": F.coalesce("table_shapes", none[0]), "header_shapes": F.coalesce("header_shapes", none[1])})


def fingerprint_json(prints: DataFrame) -> DataFrame:
    return prints.select("doc_id", F.to_json(F.struct(*[c for c in prints.columns if c != "doc_id"])).alias("json"))


def size_totals(pages: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row: documents, characters of HTML, tables, most tables in one document."""
    chars = pages.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length("html")), F.lit(0)).cast("long").alias("chars"))
    counts = extracted.agg(F.coalesce(F.sum(F.size("tables")), F.lit(0)).cast("long").alias("n_tables"), F.coalesce(F.max(F.size("tables")), F.lit(0)).cast("long").alias("most_tables"))
    return chars.join(counts)


def chunk_shapes(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_no", "kind", "table_id", "row_start", "row_end", F.length("text").alias("chars"))


def twins(prints: DataFrame, twin_prints: DataFrame, shapes: DataFrame, twin_shapes: DataFrame) -> DataFrame:
    """doc_id, same: whether original and twin agree in structure, about in size, and chunk by chunk."""
    same = None
    for c in ("tags", "spans"):
        prints, twin_prints = (p.withColumn(c, F.array_sort(F.map_entries(c))) for p in (prints, twin_prints))
    a, b = prints.alias("a"), twin_prints.alias("b")
    for c in ("tags", "spans", "table_shapes", "header_shapes", "nested_tables", "nfd", "fullwidth", "has_th"):
        eq = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        same = eq if same is None else same & eq
    near = F.abs(F.col("a.chars") - F.col("b.chars")) <= F.greatest(F.lit(2), F.expr("a.chars div 100"))
    structure = a.join(b, F.col("a.doc_id") == F.col("b.doc_id")).select(F.col("a.doc_id").alias("doc_id"), (same & near).alias("structure"))
    x, y = shapes.alias("x"), twin_shapes.alias("y")
    on = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.chunk_no") == F.col("y.chunk_no"))
    alike = F.coalesce((F.col("x.kind") == F.col("y.kind")) & (F.col("x.table_id") == F.col("y.table_id")) & (F.col("x.row_start") == F.col("y.row_start")) & (F.col("x.row_end") == F.col("y.row_end")) & (F.abs(F.col("x.chars") - F.col("y.chars")) <= 4), F.lit(False))
    chunks = x.join(y, on, "full").select(F.coalesce("x.doc_id", "y.doc_id").alias("doc_id"), alike.alias("ok")).groupBy("doc_id").agg(F.min("ok").alias("chunks"))
    return structure.join(chunks, "doc_id", "left").select("doc_id", (F.col("structure") & F.coalesce("chunks", F.lit(True))).alias("same"))
