"""Chunks: row-atomic table chunks, packed text, and the two plainer strategies to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fixed_pieces, packed_sql
from .extract import blocks
from .grid import markdown_sql, prose_sql, tables, units_sql

MAX_CHARS = 900
#: Starts of groups that are gathered before they count as a run.
RUN = 256
COLUMNS = ["doc_id", "chunk_no", "text", "context", "kind", "heading", "table_id", "row_start", "row_end", "oversize"]


def text_runs(extracted: DataFrame) -> DataFrame:
    """doc_id, block_no (of the first), heading, text: neighbouring text under one heading, joined by a space."""
    seen = blocks(extracted).filter("kind <> 'break'")
    order = W.partitionBy("doc_id").orderBy("block_no")
    fresh = (F.col("kind") == "table") | F.lag("kind").over(order).eqNullSafe("table") | ~F.lag("heading").over(order).eqNullSafe(F.col("heading"))
    island = F.sum(fresh.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    text = seen.withColumn("_island", island).filter("kind = 'text'").groupBy("doc_id", "_island", "heading")
    return text.agg(F.min("block_no").alias("block_no"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), " ").alias("text")).drop("_island")


def text_chunks(extracted: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Packed pieces of text runs, each under its heading path."""
    pieces = text_runs(extracted).select("doc_id", "block_no", "heading", F.posexplode(F.expr(packed_sql("text", max_chars))).alias("part", "piece"))
    body = F.when(F.col("heading") != "", F.concat_ws("\n", "heading", "piece")).otherwise(F.col("piece"))
    return pieces.select("doc_id", "block_no", "part", F.lit(0).alias("sub"), body.alias("text"), body.alias("context"), F.lit("text").alias("kind"), "heading", F.lit(-1).alias("table_id"), F.lit(-1).alias("row_start"), F.lit(-1).alias("row_end"), F.lit(False).alias("oversize"))


def layout_chunks(t: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Tables that hold no data, as running text without heading or table id."""
    loose = t.filter("NOT is_data AND size(grid) > n_header").withColumn("_t", F.expr("array_join(transform(filter(flatten(grid), x -> x.text <> ''), x -> x.text), ' ')"))
    pieces = loose.select("doc_id", "block_no", "heading", F.posexplode(F.expr(packed_sql("_t", max_chars))).alias("part", "text"))
    return pieces.select("doc_id", "block_no", "part", F.lit(0).alias("sub"), "text", F.col("text").alias("context"), F.lit("text").alias("kind"), "heading", F.lit(-1).alias("table_id"), F.lit(-1).alias("row_start"), F.lit(-1).alias("row_end"), F.lit(False).alias("oversize"))


def starts_sql(items: str, budget: str) -> str:
    """Where greedy packs begin: at each note, after a note, and where an item no longer fits. Only these places are gathered, in
    runs, as an array is copied whole for each place added to it."""

    def state(grown: bool, used: str, is_open: str) -> str:
        runs, starts = "a.runs", "a.starts"
        if grown:
            runs, starts = f"if(size(a.starts) < {RUN}, a.runs, concat(a.runs, array(a.starts)))", f"if(size(a.starts) < {RUN}, concat(a.starts, array(a.k)), array(a.k))"
        return f"named_struct('runs', {runs}, 'starts', {starts}, 'used', {used}, 'open', {is_open}, 'k', a.k + 1)"

    size = "length(x.unit) + 1"
    step = f"(a, x) -> CASE WHEN x.note THEN {state(True, '0', 'false')} WHEN NOT a.open OR a.used + {size} > {budget} THEN {state(True, size, 'true')} ELSE {state(False, 'a.used + ' + size, 'true')} END"
    none = "named_struct('runs', cast(array() AS array<array<int>>), 'starts', cast(array() AS array<int>), 'used', 0, 'open', false, 'k', 0)"
    return f"aggregate({items}, {none}, {step}, a -> flatten(concat(a.runs, array(a.starts))))"


def table_chunks(t: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Chunks of whole units under the table's title and columns; prose rows stand apart as text.

    ``context`` has the rows that a chunk covers as Markdown. A unit longer than the budget is kept whole and flagged.
    """
    d = t.filter("is_data").withColumn("_title", F.expr("concat_ws(' / ', nullif(heading, ''), nullif(caption, ''))"))
    d = d.withColumn("_prefix", F.expr("if(_title <> '', concat('[표] ', _title), '[표]')"))
    d = d.withColumn("_columns", F.expr("array_join(filter(labels, l -> l <> ''), ', ')"))
    d = d.withColumn("_head", F.expr("if(_columns <> '', concat(_prefix, '\\n컬럼: ', _columns), _prefix)"))
    d = d.withColumns({"_budget": F.expr(f"{max_chars} - length(_head)"), "_hc": F.expr("if(is_crosstab, hc, 0)"), "_body": F.expr("slice(grid, n_header + 1, size(grid))")})
    note = "array(named_struct('note', true, 'i', i, 'unit', filter(row, x -> x.text <> '')[0].text))"
    unit = f"transform({units_sql('row', '_hc')}, u -> named_struct('note', false, 'i', i, 'unit', u))"
    d = d.withColumn("_items", F.expr(f"flatten(transform(_body, (row, i) -> if({prose_sql('row')}, {note}, {unit})))"))
    d = d.withColumn("_starts", F.expr(starts_sql("_items", "_budget")))
    # each group takes its own rows along: beside the whole table, every group would copy it
    own = "slice(_items, s + 1, coalesce(get(_starts, g + 1), size(_items)) - s)"
    group = "named_struct('note', own[0].note, 'units', transform(own, x -> x.unit), 'rows', array_distinct(transform(own, x -> x.i)), 'cells', transform(array_distinct(transform(own, x -> x.i)), i -> _body[i]))"
    groups = d.select("doc_id", "block_no", "heading", "table_id", "labels", "_title", "_prefix", "_head", "_budget", F.posexplode(F.expr(f"transform(_starts, (s, g) -> transform(array({own}), own -> {group})[0])")).alias("part", "_group"))
    table = groups.filter("NOT _group.note").select(
        "doc_id", "block_no", "part", F.lit(0).alias("sub"),
        F.expr("concat(_head, '\\n', array_join(_group.units, '\\n'))").alias("text"),
        F.concat("_prefix", F.lit("\n"), F.expr(markdown_sql("_group.cells"))).alias("context"),
        F.lit("table").alias("kind"), "heading", "table_id", F.expr("array_min(_group.rows)").alias("row_start"), F.expr("array_max(_group.rows) + 1").alias("row_end"),
        F.expr("exists(_group.units, x -> length(x) > _budget)").alias("oversize"),
    )
    notes = groups.filter("_group.note").select("*", F.posexplode(F.expr(packed_sql("_group.units[0]", max_chars))).alias("sub", "_piece"))
    body = F.expr("if(_title <> '', concat(_prefix, '\\n', _piece), _piece)")
    prose = notes.select("doc_id", "block_no", "part", "sub", body.alias("text"), body.alias("context"), F.lit("text").alias("kind"), "heading", "table_id", F.expr("_group.rows[0]").alias("row_start"), F.expr("_group.rows[0] + 1").alias("row_end"), F.lit(False).alias("oversize"))
    return table.unionByName(prose)


def table_aware(extracted: DataFrame, max_chars: int = MAX_CHARS, t: DataFrame | None = None) -> DataFrame:
    """The table-aware strategy: chunks of all documents in document order, none of them blank."""
    t = tables(extracted) if t is None else t
    parts = text_chunks(extracted, max_chars).unionByName(layout_chunks(t, max_chars)).unionByName(table_chunks(t, max_chars)).filter("trim(text) <> ''")
    order = W.partitionBy("doc_id").orderBy("block_no", "part", "sub")
    return parts.withColumn("chunk_no", F.row_number().over(order) - 1).select(*COLUMNS)


def pieces_of(texts: DataFrame, max_chars: int) -> DataFrame:
    """Rows (doc_id, text) cut at fixed width."""
    cut = texts.select("doc_id", F.posexplode(fixed_pieces("text", max_chars)).alias("chunk_no", "text"))
    return cut.select("doc_id", "chunk_no", "text", F.col("text").alias("context"), F.lit("text").alias("kind"), F.lit("").alias("heading"), F.lit(-1).alias("table_id"), F.lit(-1).alias("row_start"), F.lit(-1).alias("row_end"), F.lit(False).alias("oversize"))


def flat(extracted: DataFrame, max_chars: int = MAX_CHARS, t: DataFrame | None = None) -> DataFrame:
    """All text, cut at fixed width: what loses rows."""
    return pieces_of(extracted.select("doc_id", F.col("flat_text").alias("text")), max_chars)


def markdown(extracted: DataFrame, max_chars: int = MAX_CHARS, t: DataFrame | None = None) -> DataFrame:
    """Text outside tables, then each table as Markdown, cut at fixed width."""
    t = tables(extracted) if t is None else t
    made = t.filter("size(grid) > 0").withColumn("_md", F.expr(markdown_sql("slice(grid, n_header + 1, size(grid))")))
    per_doc = made.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("table_id", "_md"))), lambda x: x["_md"]).alias("_mds"))
    whole = extracted.select("doc_id", "outside_text").join(per_doc, "doc_id", "left")
    text = F.array_join(F.filter(F.concat(F.array("outside_text"), F.coalesce("_mds", F.expr("cast(array() AS array<string>)"))), lambda x: x != ""), "\n")
    return pieces_of(whole.select("doc_id", text.alias("text")), max_chars)


#: Strategies by name; add to it to compare others. Each takes (extracted, max_chars, tables).
STRATEGIES: dict[str, Callable[..., DataFrame]] = {"flat": flat, "markdown": markdown, "stc": table_aware}


def chunks_by_strategy(extracted: DataFrame, max_chars: int = MAX_CHARS, names: list[str] | None = None) -> DataFrame:
    """Chunks of several strategies, with a column ``strategy``."""
    t = tables(extracted)
    out = None
    for name in names or STRATEGIES:
        c = STRATEGIES[name](extracted, max_chars, t).withColumn("strategy", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out
