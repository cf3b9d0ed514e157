"""Grids: span expansion, overlap, rectangles, header heuristics, labels, classification.

Cells and blanks meet in one shuffle by table; every aggregation after it keeps that partitioning, and the
heuristics are higher-order functions over one row a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_digit_sql, is_value_sql
from .extract import source_cells, table_heads

#: Longest text of a header cell without th, header rows at most, least length of a prose row.
LONG_LABEL, MAX_HEADER, PROSE = 25, 3, 60
SAME = "({0}.o_r = {1}.o_r AND {0}.o_c = {1}.o_c)"


def grid_cells(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """Long form: doc_id, table_id, r, c, text, is_th, o_r, o_c for each place of each rectangle.

    A place that several spans cover is the last cell's; one that none covers is blank, of origin (-1, -1).
    """
    spread = cells.withColumn("rr", F.expr("explode(sequence(r, r + rowspan - 1))")).withColumn("cc", F.expr("explode(sequence(c, c + colspan - 1))"))
    filled = spread.select("doc_id", "table_id", "rr", "cc", F.struct("src_ord", "text", "is_th", F.col("r").alias("o_r"), F.col("c").alias("o_c")).alias("x"))
    places = heads.filter("n_rows > 0").withColumn("rr", F.expr("explode(sequence(0, n_rows - 1))")).withColumn("cc", F.expr("explode(sequence(0, n_cols - 1))"))
    blank = F.struct(F.lit(-1).alias("src_ord"), F.lit("").alias("text"), F.lit(False).alias("is_th"), F.lit(-1).alias("o_r"), F.lit(-1).alias("o_c"))
    both = filled.unionByName(places.select("doc_id", "table_id", "rr", "cc", blank.alias("x"))).repartition("doc_id", "table_id")
    top = both.groupBy("doc_id", "table_id", "rr", "cc").agg(F.max("x").alias("x"))
    return top.select("doc_id", "table_id", F.col("rr").alias("r"), F.col("cc").alias("c"), "x.text", "x.is_th", "x.o_r", "x.o_c")


def nested_grid(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, grid: rows of cells."""
    rows = cells.groupBy("doc_id", "table_id", "r").agg(F.sort_array(F.collect_list(F.struct("c", "text", "is_th", "o_r", "o_c"))).alias("row"))
    return rows.groupBy("doc_id", "table_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "row"))), lambda x: x["row"]).alias("grid"))


def prose_sql(row: str) -> str:
    """A row whose text all comes from one long cell."""
    full = f"filter({row}, x -> x.text <> '')"
    return f"(size({row}) >= 2 AND size({full}) > 0 AND size(array_distinct(transform({full}, x -> struct(x.o_r, x.o_c)))) = 1 AND length({full}[0].text) >= {PROSE})"


def merged_sql(row: str, r: str) -> str:
    """Whether a horizontal merge begins in this row, over less than all of it."""
    origins = f"array_distinct(transform(filter({row}, x -> x.text <> ''), x -> struct(x.o_r, x.o_c)))"
    pair = f"exists(filter(transform({row}, (x, i) -> named_struct('a', x, 'b', get({row}, i + 1))), p -> p.b IS NOT NULL), p -> p.a.text <> '' AND p.a.o_r = {r} AND {SAME.format('p.a', 'p.b')})"
    return f"(size({origins}) >= 2 AND {pair})"


def leading_sql(flags: str) -> str:
    """Number of leading true values of an array."""
    return f"(CASE WHEN array_position({flags}, false) > 0 THEN cast(array_position({flags}, false) AS int) - 1 ELSE size({flags}) END)"


def tables(extracted: DataFrame) -> DataFrame:
    """One row a table: doc_id, table_id, block_no, heading, caption, n_rows, n_cols, n_src, n_nested, grid, n_header,
    labels, hc, is_crosstab, is_data. Tables without cells have an empty grid."""
    heads = table_heads(extracted)
    grids = nested_grid(grid_cells(source_cells(extracted), heads))
    t = heads.join(grids, ["doc_id", "table_id"], "left").withColumn("grid", F.coalesce("grid", F.expr("cast(array() AS array<array<struct<c:int,text:string,is_th:boolean,o_r:int,o_c:int>>>)")))
    return classified(t)


def classified(t: DataFrame) -> DataFrame:
    """Add the header heuristics to rows with a ``grid``."""
    t = t.withColumn("_th", F.expr("exists(grid, row -> exists(row, x -> x.is_th))"))
    t = t.withColumn("_lead", F.expr(leading_sql("transform(grid, row -> forall(row, x -> x.is_th))")))
    t = t.withColumn("_top", F.expr(f"transform(slice(grid, 1, {MAX_HEADER}), row -> CASE WHEN exists(row, x -> length(x.text) > {LONG_LABEL}) THEN 2 WHEN exists(row, x -> {has_digit_sql('x.text')}) THEN 1 ELSE 0 END)"))
    t = t.withColumn("_plain", F.expr(leading_sql("transform(_top, k -> k = 0)")))
    t = t.withColumn("_n", F.expr("CASE WHEN size(grid) = 0 THEN 0 WHEN _th THEN _lead WHEN n_cols = 2 OR _plain = 0 AND _top[0] = 2 THEN -1 ELSE greatest(_plain, 1) END"))
    for _ in range(2):  # from 1 row to at most 3
        t = t.withColumn("_n", F.expr(f"CASE WHEN NOT _th AND _n > 0 AND _n < {MAX_HEADER} AND _n < size(grid) - 1 AND {merged_sql('grid[_n - 1]', '_n - 1')} THEN _n + 1 ELSE _n END"))
    t = t.withColumn("n_header", F.expr("least(greatest(_n, 0), greatest(size(grid) - 1, 0))"))
    t = t.withColumn("_body", F.expr("slice(grid, n_header + 1, size(grid))"))
    label = "array_join(array_distinct(filter(transform(slice(grid, 1, n_header), row -> row[c].text), x -> x <> '')), ' > ')"
    t = t.withColumn("labels", F.expr(f"CASE WHEN size(grid) > 0 THEN transform(sequence(0, n_cols - 1), c -> {label}) ELSE cast(array() AS array<string>) END"))
    t = t.withColumn("_records", F.expr(f"filter(_body, row -> NOT {prose_sql('row')})"))
    t = t.withColumn("_records", F.expr("if(size(_records) > 0, _records, _body)"))
    columns = "transform(sequence(0, n_cols - 1), c -> {})"
    t = t.withColumn("_last", F.expr(f"CASE WHEN size(grid) > 0 THEN greatest(0, array_max(transform({columns.format('exists(_records, row -> row[c].text <> ' + chr(39) * 2 + ')')}, (f, c) -> if(f, c, 0)))) ELSE 0 END"))
    valued = "NOT exists(_records, row -> row[c].text <> '' AND " + is_value_sql("row[c].text") + ")"
    t = t.withColumn("_keys", F.expr(f"CASE WHEN size(grid) > 0 THEN {leading_sql(columns.format(valued))} ELSE 0 END"))
    t = t.withColumn("hc", F.expr("least(_keys, _last)"))
    t = t.withColumn("is_crosstab", F.expr("(n_header >= 2 AND hc >= 2) OR (n_header = 0 AND hc >= 1)"))
    # the id is never negative; it keeps later filters above these projections
    t = t.withColumn("is_data", F.when(F.monotonically_increasing_id() >= 0, F.expr("size(grid) > 0 AND n_cols >= 2 AND size(_body) >= 1 AND size(filter(flatten(_body), x -> x.text <> '')) >= 2")))
    return t.drop("_th", "_lead", "_top", "_plain", "_n", "_body", "_records", "_last", "_keys")


def kv_sql(row: str) -> str:
    """A row as 'label: text' parts; a cell that repeats its neighbour's origin is given once."""
    part = f"if(x.text = '' OR (i > 0 AND {SAME.format('x', row + '[i - 1]')}), NULL, if(labels[i] <> '', concat(labels[i], ': ', x.text), x.text))"
    return f"array_join(filter(transform({row}, (x, i) -> {part}), p -> p IS NOT NULL), ', ')"


def units_sql(row: str, hc: str) -> str:
    """The smallest strings of a row that chunks are made of: the row, or, with key columns hc > 0, a string a value cell."""
    line = f"filter(array({kv_sql(row)}), l -> l <> '')"
    keys = f"array_join(transform(filter(transform(slice({row}, 1, {hc}), (x, i) -> named_struct('x', x, 'd', exists(slice({row}, 1, i), y -> {SAME.format('x', 'y')}))), k -> k.x.text <> '' AND NOT k.d), k -> k.x.text), ' ')"
    head = f"concat_ws(' ', nullif(pre, ''), nullif(labels[{hc} + i], ''))"
    value = f"if(x.text = '' OR (i > 0 AND {SAME.format('x', row + '[' + hc + ' + i - 1]')}), NULL, if({head} <> '', concat({head}, ': ', x.text), x.text))"
    values = f"filter(transform(slice({row}, {hc} + 1, size({row})), (x, i) -> {value}), v -> v IS NOT NULL)"
    split = f"transform(array({keys}), pre -> named_struct('pre', pre, 'v', {values}))[0]"
    return f"if({hc} <= 0, {line}, transform(array({split}), s -> if(size(s.v) = 0 AND s.pre <> '', array(s.pre), s.v))[0])"


def units(t: DataFrame) -> DataFrame:
    """doc_id, table_id, row (in body coordinates), unit_no, unit: of every body row that is no prose, data tables or not."""
    hc = "if(is_crosstab, hc, 0)"
    rows = t.withColumn("_hc", F.expr(hc)).select("doc_id", "table_id", "labels", "_hc", F.posexplode(F.expr("slice(grid, n_header + 1, size(grid))")).alias("row", "_cells"))
    made = rows.filter(f"NOT {prose_sql('_cells')}").select("doc_id", "table_id", "row", F.posexplode(F.expr(units_sql("_cells", "_hc"))).alias("unit_no", "unit"))
    return made


def row_kv(t: DataFrame) -> DataFrame:
    """doc_id, table_id, row, kv for every body row."""
    rows = t.select("doc_id", "table_id", "labels", F.posexplode(F.expr("slice(grid, n_header + 1, size(grid))")).alias("row", "_cells"))
    return rows.select("doc_id", "table_id", "row", F.expr(kv_sql("_cells")).alias("kv"))


def markdown_sql(rows: str) -> str:
    """Labels, a rule and rows as a Markdown table; merged cells are repeated."""
    line = "concat('| ', array_join({}, ' | '), ' |')"
    return f"array_join(concat(array({line.format('labels')}, {line.format('transform(labels, l -> ' + chr(39) + '---' + chr(39) + ')')}), transform({rows}, row -> {line.format('transform(row, x -> x.text)')})), '\\n')"
