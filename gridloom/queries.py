"""Registered queries of the table operators, each over its whole tables, and the same results in DuckDB SQL.

Table operators are checked by round trip: HTML is written in Spark from the relational tables, parsed, and must give
what SQL reads off those tables directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ledger
from .functions.quantity import with_number
from .functions.text import document_frequencies, fixed_pieces, is_value, numbers_sql
from .operators.anonymize import anonymize, anonymize_text
from .operators.chunk import markdown, table_aware
from .operators.evalset import gen_queries
from .operators.extract import extract
from .operators.grid import grid_cells, row_kv, source_cells, table_heads, tables, units
from .operators.invariants import chunk_shapes, conservation, fingerprints, header_kinds, invariants, missing_tokens, span_kinds, structure_summary, tag_counts, twins
from .operators.retrieve import CharTfidf, dense_best, fused_best, ranked, within_budget
from .plans.report import retrieval_report
from .session import stored
from .sources.corpus import annual_reports, table_zoo
from .sources.readers import decoded, listed_receipts, viewer_urls
from .streaming.pages import event_windows

STATUSES = ("F", "O", "P")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_counts(spark: SparkSession, sf: str) -> DataFrame:
    """n_regionkey, r_name, n_name and orders by status of each nation."""
    orders = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in STATUSES])
    nations = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.join(orders, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_regionkey", "r_name", "n_name", *[F.coalesce(s, F.lit(0)).alias(s) for s in STATUSES])


def crosstab_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page a region: its name over all rows, a row a nation, a two-level header without th."""
    cells = F.concat(*[F.concat(F.lit("<td>"), F.format_string("%d orders 00", s)) for s in STATUSES])
    nation = order_counts(spark, sf).select("n_regionkey", "r_name", "n_name", F.concat(F.lit("<td>"), "n_name", cells).alias("cells"))
    page = nation.groupBy("n_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_name", "cells"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit("<td rowspan="), F.size("rows").cast("string"), F.lit(">"), "r_name")).otherwise(""), x["cells"])), "")
    head = "<tr><td rowspan=2 colspan=2>Place<td colspan=3>Orders<tr>" + "".join(f"<td>{s}" for s in STATUSES)
    return page.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("<title>"), "r_name", F.lit(f"</title><p>Orders by state.<table><caption>States</caption>{head}"), body, F.lit("</table>")).alias("html"))


BASE = "WITH o AS (SELECT c_nationkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), n AS (SELECT n_regionkey::BIGINT AS doc_id, r_name, n_name, coalesce(f, 0) AS f, coalesce(o, 0) AS o, coalesce(p, 0) AS p, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON n_nationkey = c_nationkey) "


def crosstab_roundtrip_units(spark: SparkSession, sf: str) -> DataFrame:
    return units(tables(extract(crosstab_pages(spark, sf)))).select("doc_id", F.col("row").cast("long").alias("row"), F.col("unit_no").cast("long").alias("unit_no"), "unit")


def grid_expansion(spark: SparkSession, sf: str) -> DataFrame:
    e = extract(crosstab_pages(spark, sf))
    g = grid_cells(source_cells(e), table_heads(e)).filter("r >= 2")
    return g.select("doc_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "text", F.col("o_r").cast("long").alias("o_r"), F.col("o_c").cast("long").alias("o_c"))


def header_detection(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(extract(crosstab_pages(spark, sf)))
    return t.select("doc_id", F.col("n_rows").cast("long").alias("n_rows"), F.col("n_cols").cast("long").alias("n_cols"), F.col("n_header").cast("long").alias("n_header"), F.col("hc").cast("long").alias("hc"), "is_crosstab", "is_data", "caption", "heading", F.array_join("labels", "|").alias("labels"))


def span_conservation(spark: SparkSession, sf: str) -> DataFrame:
    e = extract(crosstab_pages(spark, sf))
    return conservation(e, tables(e)).select("doc_id", "covered", "claimed")


def table_chunks_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    c = table_aware(extract(crosstab_pages(spark, sf)), 100_000)
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "kind", "heading", F.md5("text").alias("text_md5"))


def supplier_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page a nation: suppliers under a th header."""
    s = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x: F.concat(F.lit("<tr><td>"), x["s_suppkey"].cast("string"), F.lit("<td>"), x["s_name"], F.lit("<td>"), F.lit("<b>x</b>"))), "")
    return s.select(F.col("s_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("<table><tr><th>Key<th>Name<th>Mark"), body, F.lit("</table>")).alias("html"))


def row_kv_list(spark: SparkSession, sf: str) -> DataFrame:
    return row_kv(tables(extract(supplier_pages(spark, sf)))).select("doc_id", F.col("row").cast("long").alias("row"), "kv")


def markdown_tables(spark: SparkSession, sf: str) -> DataFrame:
    return markdown(extract(supplier_pages(spark, sf)), 1_000_000).select("doc_id", F.md5("text").alias("text_md5"))


def generated_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query a row at most: of the crosstab pages, with target column and sample by md5."""
    e = extract(crosstab_pages(spark, sf))
    return gen_queries(e, tables(e), 3).select("query_id", "q", F.array_join("keys", "|").alias("keys"), "label", "answer", "scope")


def page_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The pages as their SQL reads them: a character reference ends in a semicolon."""
    return extract(read(spark, sf, "pages"), "page_id", closed_refs=True)


def pages_title_heading(spark: SparkSession, sf: str) -> DataFrame:
    e = page_extract(spark, sf)
    return e.select(F.col("doc_id").alias("page_id"), "title", "scope_title")


def pages_links(spark: SparkSession, sf: str) -> DataFrame:
    e = extract(read(spark, sf, "pages"), "page_id")
    return e.select(F.col("doc_id").alias("page_id"), F.expr("size(filter(tags, t -> t = 'a'))").cast("long").alias("n_links"))


def pages_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tag_counts(extract(read(spark, sf, "pages"), "page_id"))


def pages_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = table_aware(stored(page_extract(spark, sf), "extracted"))
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "heading", F.md5("text").alias("text_md5"))


def pages_invariants(spark: SparkSession, sf: str) -> DataFrame:
    e = stored(page_extract(spark, sf), "extracted")
    t = stored(tables(e), "tables")
    return invariants(e, t, table_aware(e, t=t)).drop("missing_tokens")


def docs_fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(fixed_pieces("text", 900)).alias("chunk_no", "piece"))
    return d.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("piece").alias("piece_md5"))


def docs_trigram_df(spark: SparkSession, sf: str) -> DataFrame:
    return document_frequencies(read(spark, sf, "documents"), "text")


def tfidf_rank_top5(spark: SparkSession, sf: str) -> DataFrame:
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranked(CharTfidf().best(q, d, 5, 6), 5).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "score")


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf, "embeddings")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vq")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))


def dense_rank_top5(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(dense_best(*vectors(spark, sf), 5, 6), 5).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "score")


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    q, v = vectors(spark, sf)
    half = lambda d, c: d.withColumn(c, F.slice(c, 1, 32))
    f = fused_best([(q, v), (half(q, "vq"), half(v, "v"))], 10, 6).withColumn("score", F.round("score", 9))
    return ranked(f, 10).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "score")


def budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    r = d.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.row_number().over(W.partitionBy("lang").orderBy("n_chars", "doc_id")).alias("rank"))
    return within_budget(r, d.select(F.col("doc_id").alias("chunk_id"), F.length("text").alias("len")), 3000).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.col("used").cast("long").alias("used"))


def doc_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").withColumn("_n", F.expr(numbers_sql("text")))
    return d.select("doc_id", F.size("_n").cast("long").alias("n_numbers"), F.expr("size(filter(_n, x -> NOT array_contains(slice(_n, 1, 1), x)))").cast("long").alias("n_others"))


def normalize_quantity(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_orderkey", F.concat(F.expr("if(o_orderkey % 3 = 0, '△', '연간 ')"), F.expr("o_orderkey % 90 + 1").cast("string"), F.lit("억 "), F.expr("o_custkey % 9 + 1").cast("string"), F.lit("천"), F.expr("o_custkey % 7 + 1").cast("string"), F.lit("백만원")).alias("q"))
    return with_number(o, "q", "amount").select("o_orderkey", "amount")


def value_test(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(F.format_number("l_extendedprice", 2), F.concat(F.lit("KR-"), F.col("l_suppkey").cast("string")), F.concat(F.lit("total of "), F.col("l_linenumber").cast("string"))), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("s"))
    return v.select("l_orderkey", "l_linenumber", is_value("s").alias("is_value"))


def docs_missing_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    half = d.select("doc_id", F.lit(0).alias("chunk_no"), F.expr("substring(text, 1, length(text) div 2)").alias("text"))
    return missing_tokens(d, half).groupBy("doc_id").agg(F.count("*").alias("n_missing"))


def anonymized_signature(spark: SparkSession, sf: str) -> DataFrame:
    d = anonymize_text(read(spark, sf, "documents").select("doc_id", "text"), b"salt")
    return d.select("doc_id", F.md5(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")).alias("signature"))


def decoding_cascade(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return decoded(d).select("doc_id", F.md5("html").alias("text_md5"))


def receipt_listing(spark: SparkSession, sf: str) -> DataFrame:
    number = F.format_string("%014d", "o_orderkey")
    o = read(spark, sf, "orders").withColumn("html", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<a href='?rcpNo="), number, F.lit("'>a</a> rcpNo="), number)).otherwise(F.concat(F.lit("openReportViewer('"), number, F.lit("')"))))
    return listed_receipts(o).select("o_orderkey", F.array_join("receipts", ",").alias("receipts"))


def viewer_links(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").withColumn("html", F.when(F.col("o_orderkey") % 5 > 0, F.format_string('viewDoc("%d", "%d", "1", "2", "3", "dart4.xsd")', "o_orderkey", "o_custkey")).otherwise("none"))
    return viewer_urls(o).select("o_orderkey", "url")


def events_hourly(spark: SparkSession, sf: str) -> DataFrame:
    e = event_windows(read(spark, sf, "events"))
    return e.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


def annual_report_scores(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval_report(annual_reports(spark))


def zoo_structure(spark: SparkSession, sf: str) -> DataFrame:
    e = stored(extract(table_zoo(spark, 200)), "extracted")
    t = stored(tables(e), "tables")
    return structure_summary(invariants(e, t, table_aware(e, t=t)))


def zoo_headers(spark: SparkSession, sf: str) -> DataFrame:
    return header_kinds(tables(extract(table_zoo(spark, 200))))


def zoo_spans(spark: SparkSession, sf: str) -> DataFrame:
    return span_kinds(extract(table_zoo(spark, 200)))


def zoo_twins(spark: SparkSession, sf: str) -> DataFrame:
    z = table_zoo(spark, 100)
    e, m = (stored(extract(p), "extracted") for p in (z, anonymize(z, b"salt")))
    t, u = (stored(tables(x), "tables") for x in (e, m))
    return twins(fingerprints(e, t), fingerprints(m, u), chunk_shapes(table_aware(e, t=t)), chunk_shapes(table_aware(m, t=u)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        crosstab_roundtrip_units, grid_expansion, header_detection, span_conservation, table_chunks_roundtrip, row_kv_list, markdown_tables, generated_queries,
        pages_title_heading, pages_links, pages_tags, pages_chunks, pages_invariants, docs_fixed_chunks, docs_trigram_df, tfidf_rank_top5, dense_rank_top5, rrf_fusion,
        budget_prefix, doc_numbers, normalize_quantity, value_test, docs_missing_tokens, anonymized_signature, decoding_cascade, receipt_listing, viewer_links, events_hourly,
        annual_report_scores, zoo_structure, zoo_headers, zoo_spans, zoo_twins,
    )
}
QUERIES |= ledger.QUERIES

UNIT = "r_name || ' ' || n_name || ' Orders > {s}: ' || {c} || ' orders 00'"
GRAM = "list_transform(range(1, greatest(1, length(t) - 1)), lambda i: substring(t, i, 3))"
LOWER = "regexp_replace(lower(text), '\\s+', ' ', 'g')"
DOT = "list_sum(list_transform(range(1, {n} + 1), lambda i: q.embedding[i]::DOUBLE * d.embedding[i]::DOUBLE))"

#: Running text of the pages before and after their h1, packed by sentences: s counts them, k is the piece, u what it holds.
PIECES = r"""
WITH RECURSIVE b AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?s)^.*?<body[^>]*>', ''), '(?s)<!--.*?-->', '', 'g') AS body FROM pages),
x AS (SELECT page_id, unnest([0, 1]) AS o, unnest([regexp_extract(html, '(?s)<title>(.*?)</title>', 1), regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)]) AS heading, unnest([regexp_replace(body, '(?s)<h1>.*', ''), regexp_replace(body, '(?s)^.*?</h1>', '')]) AS t FROM b),
y AS (SELECT page_id, o, list_transform([heading, regexp_replace(t, '<[^>]*>', ' ', 'g')], lambda v: trim(regexp_replace(replace(replace(replace(replace(v, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g'))) AS v FROM x),
w AS (SELECT page_id, min(o) AS o, v[1] AS heading, string_agg(v[2], ' ' ORDER BY o) AS t FROM y WHERE v[2] <> '' GROUP BY page_id, v[1]),
z AS (SELECT *, CASE WHEN length(t) <= 900 THEN [t] ELSE string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END AS parts FROM w),
f AS (SELECT page_id, o, heading, unnest(parts) AS part, generate_subscripts(parts, 1) AS s FROM z),
p AS (SELECT page_id, o, s, 0 AS k, length(part) AS u FROM f WHERE s = 1 UNION ALL SELECT f.page_id, f.o, f.s, CASE WHEN u + length(part) + 1 > 900 THEN k + 1 ELSE k END, CASE WHEN u + length(part) + 1 > 900 THEN length(part) ELSE u + length(part) + 1 END FROM p JOIN f ON f.page_id = p.page_id AND f.o = p.o AND f.s = p.s + 1),
c AS (SELECT page_id, o, k, any_value(heading) AS heading, string_agg(part, ' ' ORDER BY s) AS piece FROM p JOIN f USING (page_id, o, s) GROUP BY page_id, o, k),
n AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o, k) - 1 AS chunk_no, heading, CASE WHEN heading <> '' THEN heading || chr(10) ELSE '' END || piece AS text FROM c)""".replace("\\\\", "\\")

ORACLE_SQL: dict[str, str] = {
    "zoo_twins": "SELECT range AS doc_id, true AS same FROM range(100)",
    "pages_chunks": PIECES + " SELECT page_id AS doc_id, chunk_no, heading, md5(text) AS text_md5 FROM n",
    "pages_invariants": PIECES + " SELECT page_id AS doc_id, true AS rectangular, true AS cell_conservation, 1.0::DOUBLE AS text_coverage, true AS row_atomic, count(*) AS n_chunks, 0::BIGINT AS n_tables, 0::BIGINT AS oversize_chunks FROM n GROUP BY page_id",
    "pages_tags": "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag",
    "crosstab_roundtrip_units": BASE + "SELECT doc_id, k - 1 AS row, u.i AS unit_no, CASE u.i WHEN 0 THEN " + UNIT.format(s="F", c="f") + " WHEN 1 THEN " + UNIT.format(s="O", c="o") + " ELSE " + UNIT.format(s="P", c="p") + " END AS unit FROM n, range(3) u(i)",
    "grid_expansion": BASE + "SELECT doc_id, k + 1 AS r, u.i AS c, CASE u.i WHEN 0 THEN r_name WHEN 1 THEN n_name WHEN 2 THEN f || ' orders 00' WHEN 3 THEN o || ' orders 00' ELSE p || ' orders 00' END AS text, CASE u.i WHEN 0 THEN 2 ELSE k + 1 END AS o_r, u.i AS o_c FROM n, range(5) u(i)",
    "header_detection": BASE + "SELECT doc_id, count(*) + 2 AS n_rows, 5::BIGINT AS n_cols, 2::BIGINT AS n_header, 2::BIGINT AS hc, true AS is_crosstab, true AS is_data, 'States' AS caption, r_name AS heading, 'Place|Place|Orders > F|Orders > O|Orders > P' AS labels FROM n GROUP BY doc_id, r_name",
    "span_conservation": BASE + "SELECT doc_id, 5 * (count(*) + 2) AS covered, 5 * (count(*) + 2) AS claimed FROM n GROUP BY doc_id",
    "table_chunks_roundtrip": BASE
    + "SELECT doc_id, 0::BIGINT AS chunk_no, 'text' AS kind, r_name AS heading, md5(r_name || chr(10) || 'Orders by state.') AS text_md5 FROM n GROUP BY doc_id, r_name UNION ALL SELECT doc_id, 1, 'table', r_name, md5('[표] ' || r_name || ' / States' || chr(10) || '컬럼: Place, Place, Orders > F, Orders > O, Orders > P' || chr(10) || string_agg("
    + " || chr(10) || ".join(UNIT.format(s=s, c=s.lower()) for s in STATUSES)
    + ", chr(10) ORDER BY k)) FROM n GROUP BY doc_id, r_name",
    "row_kv_list": "SELECT s_nationkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS row, 'Key: ' || s_suppkey || ', Name: ' || s_name || ', Mark: x' AS kv FROM supplier",
    "markdown_tables": "SELECT s_nationkey::BIGINT AS doc_id, md5('| Key | Name | Mark |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || s_suppkey || ' | ' || s_name || ' | x |', chr(10) ORDER BY s_suppkey)) AS text_md5 FROM supplier GROUP BY 1",
    "generated_queries": BASE
    + ", t AS (SELECT *, k - 1 AS row, (SELECT arg_min(i, md5('0|' || doc_id || '|0|' || (k - 1) || '|' || i)) FROM range(2, 5) u(i)) AS c, md5('0|' || doc_id || '|0|' || (k - 1)) AS h FROM n), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h, row) AS nth FROM t) SELECT doc_id || '-0-' || row AS query_id, r_name || ' States에서 ' || r_name || ' ' || n_name || ' 의 Orders ' || (['F', 'O', 'P'])[c - 1] || '은 얼마인가?' AS q, r_name || '|' || n_name AS keys, 'Orders > ' || (['F', 'O', 'P'])[c - 1] AS label, ([f, o, p])[c - 1] || ' orders 00' AS answer, r_name || ' States' AS scope FROM s WHERE nth <= 3",
    "pages_title_heading": "SELECT page_id, trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&')) AS title, trim(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')) AS scope_title FROM pages",
    "pages_links": "SELECT page_id, len(regexp_extract_all(html, '<a[ >]'))::BIGINT AS n_links FROM pages",
    "docs_fixed_chunks": "SELECT doc_id, i AS chunk_no, md5(substring(text, i * 900 + 1, 900)) AS piece_md5 FROM (SELECT doc_id, text, unnest(range(((length(text) + 899) // 900)::BIGINT)) AS i FROM documents WHERE length(text) > 0)",
    "docs_trigram_df": f"SELECT gram, count(*) AS df FROM (SELECT unnest(list_distinct({GRAM})) AS gram FROM (SELECT {LOWER} AS t FROM documents)) GROUP BY gram",
    "tfidf_rank_top5": f"WITH d AS (SELECT doc_id, gram, count(*) AS tf FROM (SELECT doc_id, unnest({GRAM}) AS gram FROM (SELECT doc_id, {LOWER} AS t FROM documents)) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), i AS (SELECT gram, ln((1 + n.n) / (1 + count(*))) + 1 AS idf FROM d, n GROUP BY gram, n.n), dw AS (SELECT doc_id, gram, tf * idf AS w FROM d JOIN i USING (gram)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id), "
    f"q AS (SELECT item_id, gram, count(*) AS tf FROM (SELECT item_id, unnest({GRAM}) AS gram FROM (SELECT item_id, {LOWER} AS t FROM benchmark)) GROUP BY ALL), qw AS (SELECT item_id, gram, tf * idf AS w FROM q JOIN i USING (gram)), qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY item_id), "
    "s AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(qw.w * dw.w) / any_value(qn.norm) / any_value(dn.norm), 6) AS score FROM qw JOIN dw USING (gram) JOIN qn USING (item_id) JOIN dn USING (doc_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, rank, score FROM r WHERE rank <= 5",
    "dense_rank_top5": f"WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, round({DOT.format(n=64)}, 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5",
    "rrf_fusion": f"WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, round({DOT.format(n=64)}, 6) AS a, round({DOT.format(n=32)}, 6) AS b FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, chunk_id) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, chunk_id) AS rb FROM s), f AS (SELECT query_id, chunk_id, round(1.0::DOUBLE / (60 + ra) + 1.0::DOUBLE / (60 + rb), 9) AS score FROM r), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) SELECT * FROM g WHERE rank <= 10",
    "budget_prefix": "WITH r AS (SELECT lang AS query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rank, length(text) AS len FROM documents), u AS (SELECT query_id, chunk_id, rank, (sum(len) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS used FROM r) SELECT * FROM u WHERE used <= 3000 OR rank = 1",
    "doc_numbers": "WITH n AS (SELECT doc_id, regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?') AS x FROM documents) SELECT doc_id, len(x)::BIGINT AS n_numbers, len(list_filter(x, lambda y: y <> x[1]))::BIGINT AS n_others FROM n",
    "normalize_quantity": "SELECT o_orderkey, (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * ((o_orderkey % 90 + 1) * 100000000 + ((o_custkey % 9 + 1) * 1000 + (o_custkey % 7 + 1) * 100) * 10000))::DOUBLE AS amount FROM orders",
    "value_test": "WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN format('{:,.2f}', l_extendedprice) WHEN 1 THEN 'KR-' || l_suppkey ELSE 'total of ' || l_linenumber END AS s FROM lineitem), d AS (SELECT *, length(regexp_replace(s, '[^0-9]', '', 'g')) AS k FROM v) SELECT l_orderkey, l_linenumber, NOT regexp_full_match(s, '[A-Za-z]{1,3}[-_]?\\d+') AND NOT regexp_full_match(s, '\\d+(?:-\\d+){2,}') AND k >= 2 AND k * 10 >= length(s) * 3 AS is_value FROM d",
    "docs_missing_tokens": "WITH d AS (SELECT doc_id, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS t FROM documents), m AS (SELECT doc_id, len(list_filter(list_distinct(string_split(t, ' ')), lambda w: w <> '' AND NOT contains(substring(t, 1, length(t) // 2), w))) AS n_missing FROM d) SELECT doc_id, n_missing::BIGINT AS n_missing FROM m WHERE n_missing > 0",
    "anonymized_signature": "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]', '9', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g')) AS signature FROM documents",
    "decoding_cascade": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "receipt_listing": "SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 14, '0') AS receipts FROM orders",
    "viewer_links": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN 'https://dart.fss.or.kr/report/viewer.do?rcpNo=' || o_orderkey || '&dcmNo=' || o_custkey || '&eleId=1&offset=2&length=3&dtd=dart4.xsd' END AS url FROM orders",
    "events_hourly": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
ORACLE_SQL |= ledger.ORACLE_SQL
