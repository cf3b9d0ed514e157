"""Evaluation sets: queries generated from cells, recoverability, distractors, shuffled negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import numbers_sql
from .grid import kv_sql, prose_sql

NO_SCOPE = "문서"
LINE_BREAKS = "\\\\r\\\\n|[\\\\n\\\\r\\\\x0B\\\\f\\\\x1C-\\\\x1E\\\\x85\\\\u2028\\\\u2029]"


def gen_queries(extracted: DataFrame, t: DataFrame, per_table: int = 6, seed: int = 0) -> DataFrame:
    """query_id, doc_id, table_id, row, q, keys, label, answer, scope, row_chars.

    Of each body row that is no prose: its own cells (not copies) left of hc are keys, one of those right of it with a label
    is the target. Target and sample are chosen by md5 of seed and place, so that any engine can choose alike.
    """
    rows = t.select("doc_id", "table_id", "caption", "labels", "hc", F.posexplode(F.expr("slice(grid, n_header + 1, size(grid))")).alias("row", "_cells")).filter(f"NOT {prose_sql('_cells')}")
    own = "filter(transform(_cells, (x, i) -> named_struct('i', i, 'text', x.text, 'o_c', x.o_c)), x -> x.text <> '' AND x.o_c = x.i)"
    rows = rows.withColumn("_own", F.expr(own))
    rows = rows.withColumns({"keys": F.expr("transform(filter(_own, x -> x.i < hc), x -> x.text)"), "_targets": F.expr("filter(_own, x -> x.i >= hc AND labels[x.i] <> '')")})
    place = f"concat_ws('|', '{seed}', doc_id, table_id, row"
    pick = f"array_sort(transform(_targets, x -> named_struct('h', md5({place}, x.i)), 'i', x.i, 'text', x.text)))[0]"
    rows = rows.filter((F.size("keys") > 0) & (F.size("_targets") > 0)).withColumn("_t", F.expr(pick))
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy("doc_id", "table_id").orderBy(F.expr(f"md5({place}))"), "row"))).filter(F.col("_nth") <= per_table)
    rows = rows.join(extracted.select("doc_id", "scope_title"), "doc_id")
    scope = F.expr(f"coalesce(nullif(concat_ws(' ', nullif(scope_title, ''), nullif(caption, '')), ''), '{NO_SCOPE}')")
    rows = rows.withColumns({"scope": scope, "label": F.expr("labels[_t.i]"), "answer": F.col("_t.text"), "row_chars": F.length(F.expr(kv_sql("_cells")))})
    q = F.concat("scope", F.lit("에서 "), F.array_join("keys", " "), F.lit(" 의 "), F.regexp_replace("label", " > ", " "), F.lit("은 얼마인가?"))
    return rows.select(F.concat_ws("-", "doc_id", "table_id", "row").alias("query_id"), "doc_id", "table_id", "row", q.alias("q"), "keys", "label", "answer", "scope", "row_chars")


def recoverable(text: str = "text") -> Column:
    """Whether a chunk alone ties label to answer: one line has 'label: answer' and all keys, or a Markdown table has them
    in one row under the label. Columns label, answer, keys stand beside ``text``."""
    quoted = "concat('\\\\Q', replace({}, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E')"
    pattern = f"concat({quoted.format('label')}, '\\\\s*:\\\\s*', {quoted.format('answer')})"
    lines = f"split({text}, '{LINE_BREAKS.replace(chr(92) * 4, chr(92) * 2)}')"
    line_ok = f"exists({lines}, l -> l rlike {pattern} AND forall(keys, k -> contains(l, k)))"
    cells = f"transform(filter({lines}, l -> trim(l) rlike '^\\\\|.+\\\\|$'), l -> transform(split(substring(trim(l), 2, length(trim(l)) - 2), '\\\\|'), c -> trim(c)))"
    body = f"filter({cells}, r -> NOT forall(r, c -> c rlike '^[-:]*$'))"
    table_ok = f"exists(transform(array({body}), rs -> size(rs) >= 2 AND array_contains(rs[0], label) AND exists(slice(rs, 2, size(rs)), r -> coalesce(get(r, cast(array_position(rs[0], label) AS int) - 1) = answer, false) AND forall(keys, k -> exists(r, c -> contains(c, k))))), ok -> ok)"
    return F.expr(f"contains({text}, answer) AND forall(keys, k -> contains({text}, k)) AND ({line_ok} OR {table_ok})")


def distractors(text: str = "text") -> Column:
    """Least number of other numbers on a line that has the answer and all keys; NULL without such a line."""
    lines = f"filter(split({text}, '{LINE_BREAKS.replace(chr(92) * 4, chr(92) * 2)}'), l -> contains(l, answer) AND forall(keys, k -> contains(l, k)))"
    others = f"size(filter({numbers_sql('l')}, n -> NOT array_contains({numbers_sql('answer')}, n)))"
    return F.expr(f"array_min(transform({lines}, l -> {others}))")


def gold(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, chunk_no, distractors of chunks from which the answer can be recovered.

    A query's answer comes from its own document's cells, but other documents may hold it as well, so that all chunks
    are searched: the stated query set, broadcast while its size is small, against every chunk.
    """
    from .retrieve import small

    q = small(queries.select("query_id", "keys", "label", "answer"))
    hits = chunks.select("chunk_id", "chunk_no", "text").join(q, F.contains(F.col("text"), F.col("answer")))
    return hits.filter(recoverable()).select("query_id", "chunk_id", "chunk_no", distractors().alias("distractors"))


def shuffle_cells(extracted: DataFrame, seed: int = 7) -> DataFrame:
    """The same extraction with each table's cell texts permuted among its cells, spans left in place: the negative control."""
    place = "md5(concat_ws('|', '{}', doc_id, x.table_id, x.src_ord))".format(seed)
    per_table = (
        "flatten(transform(array_distinct(transform(cells, x -> x.table_id)), t -> transform(array(filter(cells, x -> x.table_id = t)), own -> "
        f"zip_with(own, array_sort(transform(own, x -> named_struct('h', {place}, 't', x.text))), (x, s) -> named_struct('table_id', x.table_id, 'src_ord', x.src_ord, 'src_row', x.src_row, 'is_th', x.is_th, 'rowspan', x.rowspan, 'colspan', x.colspan, 'r', x.r, 'c', x.c, 'text', s.t)))[0]))"
    )
    return extracted.withColumn("cells", F.expr(per_table))
