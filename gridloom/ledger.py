"""Queries over pages that hold every structure at once, written in Spark from customers and nations, and their SQL.

A page a nation: comment, script, three heading levels, running text, a table with a th header, merged keys and a prose row,
a table that holds no data, and a table in a table. What the operators make of a page can be read off the two tables
in SQL, chunks that are split by a budget included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators.anonymize import anonymize
from .operators.chunk import chunks_by_strategy, flat, markdown, table_aware
from .operators.evalset import gen_queries, gold, shuffle_cells
from .operators.extract import blocks, extract, source_cells, table_heads
from .operators.grid import grid_cells, tables
from .operators.invariants import chunk_shapes, fingerprint_json, fingerprints, header_kinds, invariants, size_totals, span_kinds, structure_summary, table_shapes, tag_counts, twins
from .operators.retrieve import Retriever, build_retriever, letter_counts, length_gap, ranked, shared_grams
from .operators.scoring import score
from .plans.report import chunk_ids, extraction_prompts, judged, shown_answer
from .sources.corpus import SEGMENTS, annual_reports, table_zoo
from .sources.readers import read_html, read_html_lossy, write_files
from .session import shared_dir, stored

MAX = 400
NOTE = "Balances may change without notice, and amounts in this table are not binding for any party; ask the office before use. Sheet "


def ledger_pages(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, html."""
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    c = read("customer").select("c_nationkey", "c_mktsegment", "c_custkey", F.concat(F.lit("<td>"), "c_name", F.lit("<td>"), F.format_number("c_acctbal", 2)).alias("cells"))
    groups = c.groupBy("c_nationkey", "c_mktsegment").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "cells"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit("<td rowspan="), F.size("rows").cast("string"), F.lit(">"), "c_mktsegment")).otherwise(""), x["cells"])), "")
    page = groups.select("c_nationkey", "c_mktsegment", body.alias("part")).groupBy("c_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_mktsegment", "part"))), lambda x: x["part"]), "").alias("rows"))
    n = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(page, F.col("n_nationkey") == F.col("c_nationkey"))
    html = (
        "concat('<html><head><title>Ledger ', n_name, '</title><style>p{margin:0}</style></head><body><!-- draft ', n_nationkey, ' --><h1>Ledger of ', n_name, '</h1><p>Region ', r_name, '.<script>as</script> All balances are as of today.</p>"
        "<h2>Customers</h2><p>One row a customer.</p><table><caption>Accounts</caption><tr><th>Segment<th>Customer<th>Balance', rows, '<tr><td colspan=3>" + NOTE + "', n_nationkey, '.</table>"
        "<h3>Contact</h3><table><tr><td>Office of ', n_name, '</table><h2>Rates</h2><table><tr><th>Item<th>Detail<th>Amount<tr><td>Fee<td><table><tr><td>inner ', n_nationkey, '</table><td>', 1000 + n_nationkey * 37, '</table></body></html>')"
    )
    # few and long: dealt out by number and by another key, as partitions of few bytes are put together, and an exchange by the join's key goes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return n.repartition(parts, F.xxhash64("n_nationkey")).select(F.col("n_nationkey").cast("long").alias("doc_id"), F.expr(html).alias("html"))


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def ledger_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return longs(blocks(extract(ledger_pages(spark, sf))), "block_no", "table_id")


def ledger_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = table_aware(extract(ledger_pages(spark, sf)), MAX)
    return longs(c, "chunk_no", "table_id", "row_start", "row_end").select("doc_id", "chunk_no", "kind", "heading", "table_id", "row_start", "row_end", "oversize", F.md5("text").alias("text_md5"), F.md5("context").alias("context_md5"))


def ledger_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all strategies by strategy: what flat and Markdown cut at fixed width, and what is packed by row."""
    c = chunks_by_strategy(extract(ledger_pages(spark, sf)), MAX)
    return longs(c, "chunk_no").select("strategy", "doc_id", "chunk_no", F.md5("text").alias("text_md5"))


def ledger_invariants(spark: SparkSession, sf: str) -> DataFrame:
    e = stored(extract(ledger_pages(spark, sf)), "extracted")
    t = stored(tables(e), "tables")
    return invariants(e, t, table_aware(e, MAX, t)).select("doc_id", "rectangular", "cell_conservation", "text_coverage", F.size("missing_tokens").cast("long").alias("n_missing"), "row_atomic", "n_chunks", "n_tables", "oversize_chunks")


def lossy_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """The same checks on chunks cut at fixed width, where rows break: what is lost is named."""
    e = stored(extract(ledger_pages(spark, sf)), "extracted")
    t = stored(tables(e), "tables")
    cut = flat(e, MAX, t).withColumn("table_id", F.lit(0)).filter("chunk_no <> 1")
    return invariants(e, t, cut).select("doc_id", F.round("text_coverage", 9).alias("text_coverage"), F.array_join("missing_tokens", " ").alias("missing"), "row_atomic", "n_chunks")


def ledger_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = stored(extract(ledger_pages(spark, sf)), "extracted")
    t = stored(tables(e), "tables")
    return structure_summary(invariants(e, t, table_aware(e, MAX, t))).select("n_docs", "n_rectangular", "n_cell_conservation", "n_row_atomic", "mean_coverage", "min_coverage", "worst_doc", "n_tables", "n_chunks", "oversize_chunks", F.array_join("failed", ",").alias("failed"))


def ledger_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Histograms of headers, shapes and spans in one table."""
    e = stored(extract(ledger_pages(spark, sf)), "extracted")
    t = stored(tables(e), "tables")
    h = header_kinds(t).select(F.lit("header").alias("what"), F.concat_ws("/", "n_header", "hc", F.col("is_crosstab").cast("int")).alias("value"), "n")
    s = table_shapes(t.filter("table_id > 0")).select(F.lit("shape").alias("what"), F.concat_ws("x", "n_rows", "n_cols").alias("value"), "n")
    p = span_kinds(e, 2).select(F.lit("span").alias("what"), F.concat_ws("x", "rowspan", "colspan").alias("value"), "n")
    return h.unionByName(s).unionByName(p)


def ledger_totals(spark: SparkSession, sf: str) -> DataFrame:
    return size_totals(ledger_pages(spark, sf), extract(ledger_pages(spark, sf)))


def ledger_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tag_counts(extract(ledger_pages(spark, sf)))


def ledger_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    e = stored(extract(ledger_pages(spark, sf)), "extracted")
    p = fingerprint_json(fingerprints(e, tables(e)))
    at = lambda path: F.get_json_object("json", path)
    return p.select("doc_id", at("$.tags.th").cast("long").alias("th"), at("$.tags.tr").cast("long").alias("tr"), at("$.spans.rs1×cs3").cast("long").alias("wide"), at("$.table_shapes").alias("table_shapes"), at("$.header_shapes").alias("header_shapes"), at("$.nested_tables").cast("long").alias("nested_tables"), at("$.nfd").alias("nfd"), at("$.fullwidth").alias("fullwidth"), at("$.has_th").alias("has_th"), at("$.mso").alias("mso"))


def ledger_twins(spark: SparkSession, sf: str) -> DataFrame:
    pages = ledger_pages(spark, sf)
    e, m = (stored(extract(p), "extracted") for p in (pages, anonymize(pages, b"salt")))
    t, u = (stored(tables(x), "tables") for x in (e, m))
    return twins(fingerprints(e, t), fingerprints(m, u), chunk_shapes(table_aware(e, MAX, t)), chunk_shapes(table_aware(m, MAX, u)))


def anonymized_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Source cells of the anonymized pages by their classes of characters."""
    c = source_cells(extract(anonymize(ledger_pages(spark, sf), b"salt")))
    sign = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    return longs(c, "table_id", "src_ord").select("doc_id", "table_id", "src_ord", sign.alias("signature")).filter("table_id = 0")


def shuffled_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = source_cells(shuffle_cells(extract(ledger_pages(spark, sf))))
    return longs(c, "table_id", "src_ord", "rowspan", "colspan").select("doc_id", "table_id", "src_ord", "rowspan", "colspan", "text").filter("table_id = 0")


class GramOverlap(Retriever):
    """Distinct shared trigrams: whole numbers, so that every engine ranks alike."""

    name = "gram-overlap"

    def rank(self, queries: DataFrame, chunks: DataFrame, top: int | None = None) -> DataFrame:
        return ranked(shared_grams(queries, chunks, top), top).select("query_id", "chunk_id", "rank")


def ledger_queries(spark: SparkSession, sf: str) -> DataFrame:
    e = extract(ledger_pages(spark, sf))
    return longs(gen_queries(e, tables(e), 2), "row_chars").select("query_id", "q", F.array_join("keys", "|").alias("keys"), "label", "answer", "scope", "row_chars")


def ledger_gold(spark: SparkSession, sf: str) -> DataFrame:
    """Which chunks of which strategy a query can be answered from, and the fewest other numbers on an answering line."""
    e = stored(extract(ledger_pages(spark, sf)), "extracted")
    t = stored(tables(e), "tables")
    q = stored(gen_queries(e, t, 2), "queries")
    made = stored(chunks_by_strategy(e, MAX), "chunks")
    out = None
    for name in ("stc", "markdown", "flat"):
        g = gold(q, chunk_ids(made.filter(F.col("strategy") == name))).select(F.lit(name).alias("strategy"), "query_id", "chunk_id", F.col("distractors").cast("long").alias("distractors"))
        out = g if out is None else out.unionByName(g)
    return out


def ledger_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of row-packed chunks, as they are and against shuffled cells."""
    e = stored(extract(ledger_pages(spark, sf)), "extracted")
    t = stored(tables(e), "tables")
    q = stored(gen_queries(e, t, 2), "queries")
    s = score(q, stored(chunk_ids(table_aware(e, MAX, t)), "chunks"), GramOverlap())
    return s.select(*[F.round(c, 9).alias(c) for c in ("row_destruction", "rec_1200", "rec_3000", "r_1", "r_5", "mrr", "density", "distractors")], "n_chunks", "mean_chars")


def ledger_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy by backend on row-packed chunks: the answer itself, none, and the answer where the context shows it."""
    out = None
    asked = extraction_prompts(ledger_pages(spark, sf), GramOverlap(), MAX, 1200, per_table=2, names=["stc"])
    for name, ask in (("gold", "gold"), ("none", "none"), ("shown", shown_answer)):
        a = judged(asked, ask).select(F.lit(name).alias("backend"), "strategy", "n", F.round("accuracy", 9).alias("accuracy"))
        out = a if out is None else out.unionByName(a)
    return out


def reranked_top(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical and letter-count rankings fused, and the first five again by likeness of length: what build_retriever composes."""
    q = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("q")).filter("query_id % 5 = 0")
    d = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("chunk_id"), F.concat_ws(" ", F.lit("on"), F.reverse(F.concat("s_name", F.lit(" from the "), F.col("s_nationkey").cast("string"))), F.col("s_acctbal").cast("int").cast("string")).alias("text"))
    r = build_retriever(letter_counts(), hybrid=True, pair_score=length_gap, top_n=5)
    return r.rank(q, d, 8).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


def annual_report_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts of the closed-form reports, as the grid places them under merged segments."""
    e = extract(annual_reports(spark))
    g = grid_cells(source_cells(e), table_heads(e)).filter("r >= 2")
    return longs(g, "r", "c").select("doc_id", "r", "c", "text")


def annual_report_destruction(spark: SparkSession, sf: str) -> DataFrame:
    """Share of generated queries that no chunk of a strategy can answer, on the closed-form reports."""
    e = stored(extract(annual_reports(spark)), "extracted")
    t = stored(tables(e), "tables")
    q = stored(gen_queries(e, t), "queries")
    made = stored(chunks_by_strategy(e), "chunks")
    out = None
    for name in ("flat", "markdown", "stc"):
        found = gold(q, chunk_ids(made.filter(F.col("strategy") == name))).select("query_id").distinct().withColumn("found", F.lit(1))
        a = q.join(found, "query_id", "left").agg(F.lit(name).alias("strategy"), F.count("*").alias("n"), F.round(1 - F.count("found") / F.count("*"), 3).alias("row_destruction"))
        out = a if out is None else out.unionByName(a)
    return out


def zoo_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of every document of the mixed corpus, damaged or not."""
    e = stored(extract(table_zoo(spark, 200)), "extracted")
    t = stored(tables(e), "tables")
    return invariants(e, t, table_aware(e, t=t)).select("doc_id", "rectangular", "cell_conservation", "text_coverage", "row_atomic", "oversize_chunks", F.col("n_tables").between(1, 3).alias("one_to_three"))


def files_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files, read again strictly and with bad bytes replaced. A text file ends in a line break."""
    at = shared_dir(spark, "ledger-files")
    write_files(ledger_pages(spark, sf), at)
    number = F.regexp_extract("path", r"doc(\d+)\.htm", 1).cast("long").alias("doc_id")
    strict = read_html(spark, f"{at}/*/part-*").select(number, F.md5("html").alias("strict_md5"))
    lossy = read_html_lossy(spark, f"{at}/*/part-*").select(number, F.md5("html").alias("lossy_md5"))
    return strict.join(lossy, "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ledger_blocks, ledger_chunks, ledger_strategies, ledger_invariants, lossy_invariants, ledger_summary, ledger_kinds, ledger_totals, ledger_tags, ledger_fingerprints, ledger_twins,
        anonymized_ledger, shuffled_cells, ledger_queries, ledger_gold, ledger_scores, ledger_extraction, reranked_top, annual_report_cells, annual_report_destruction, zoo_checks, files_round_trip,
    )
}

NL = "chr(10)"
#: Customers in page order with their table row; nations of customers; and the page itself.
PAGES = f"""
cu AS (SELECT c_nationkey AS d, c_mktsegment AS seg, c_custkey AS ck, c_name AS nm, format('{{:,.2f}}', c_acctbal) AS bal,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) - 1 AS i,
         row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS j, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS many FROM customer),
na AS (SELECT n_nationkey::BIGINT AS d, n_name AS n, r_name AS r, (SELECT count(*) FROM cu WHERE cu.d = n_nationkey) AS rows FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT d FROM cu)),
pg AS (SELECT d, any_value(n) AS n, any_value(r) AS r, string_agg('<tr>' || CASE j WHEN 0 THEN '<td rowspan=' || many || '>' || seg ELSE '' END || '<td>' || nm || '<td>' || bal, '' ORDER BY i) AS body FROM cu JOIN na USING (d) GROUP BY d),
ht AS (SELECT d, '<html><head><title>Ledger ' || n || '</title><style>p{{margin:0}}</style></head><body><!-- draft ' || d || ' --><h1>Ledger of ' || n || '</h1><p>Region ' || r || '.<script>as</script> All balances are as of today.</p><h2>Customers</h2><p>One row a customer.</p><table><caption>Accounts</caption><tr><th>Segment<th>Customer<th>Balance' || body || '<tr><td colspan=3>{NOTE}' || d
         || '.</table><h3>Contact</h3><table><tr><td>Office of ' || n || '</table><h2>Rates</h2><table><tr><th>Item<th>Detail<th>Amount<tr><td>Fee<td><table><tr><td>inner ' || d || '</table><td>' || (1000 + d * 37) || '</table></body></html>' AS html FROM pg)"""
KV = "'Segment: ' || seg || ', Customer: ' || nm || ', Balance: ' || bal"
HEAD = "'[표] Ledger of ' || n || ' > Customers / Accounts'"
#: Greedy packing of the rows, one step of the recursion a row: k is the pack, u what it holds.
PACKED = f"""
un AS (SELECT cu.d, i, {KV} AS unit, {MAX} - length({HEAD} || {NL} || '컬럼: Segment, Customer, Balance') AS budget, n FROM cu JOIN na USING (d)),
pk AS (SELECT d, i, 0 AS k, length(unit) + 1 AS u FROM un WHERE i = 0 UNION ALL
  SELECT un.d, un.i, CASE WHEN pk.u + length(unit) + 1 > budget THEN k + 1 ELSE k END, CASE WHEN pk.u + length(unit) + 1 > budget THEN length(unit) + 1 ELSE pk.u + length(unit) + 1 END FROM pk JOIN un ON un.d = pk.d AND un.i = pk.i + 1),
ta AS (SELECT d, k, any_value(n) AS n, min(i) AS a, max(i) + 1 AS z, any_value({HEAD}) || {NL} || '컬럼: Segment, Customer, Balance' || {NL} || string_agg(unit, {NL} ORDER BY i) AS text,
         any_value({HEAD}) || {NL} || '| Segment | Customer | Balance |' || {NL} || '| --- | --- | --- |' || {NL} || string_agg('| ' || seg || ' | ' || nm || ' | ' || bal || ' |', {NL} ORDER BY i) AS context FROM pk JOIN un USING (d, i) JOIN cu USING (d, i) GROUP BY d, k),
ch AS (
  SELECT d, 0 AS o, 0 AS k, 'text' AS kind, 'Ledger of ' || n AS heading, -1 AS t, -1 AS a, -1 AS z, 'Ledger of ' || n || {NL} || 'Region ' || r || '. All balances are as of today.' AS text, NULL AS context FROM na UNION ALL
  SELECT d, 1, 0, 'text', 'Ledger of ' || n || ' > Customers', -1, -1, -1, 'Ledger of ' || n || ' > Customers' || {NL} || 'One row a customer.', NULL FROM na UNION ALL
  SELECT d, 2, k, 'table', 'Ledger of ' || n || ' > Customers', 0, a, z, text, context FROM ta UNION ALL
  SELECT d, 3, 0, 'text', 'Ledger of ' || n || ' > Customers', 0, rows, rows + 1, {HEAD} || {NL} || '{NOTE}' || d || '.', NULL FROM na UNION ALL
  SELECT d, 4, 0, 'text', 'Ledger of ' || n || ' > Customers > Contact', -1, -1, -1, 'Office of ' || n, NULL FROM na UNION ALL
  SELECT d, 5, 0, 'table', 'Ledger of ' || n || ' > Rates', 2, 0, 1, '[표] Ledger of ' || n || ' > Rates' || {NL} || '컬럼: Item, Detail, Amount' || {NL} || 'Item: Fee, Detail: inner ' || d || ', Amount: ' || (1000 + d * 37),
    '[표] Ledger of ' || n || ' > Rates' || {NL} || '| Item | Detail | Amount |' || {NL} || '| --- | --- | --- |' || {NL} || '| Fee | inner ' || d || ' | ' || (1000 + d * 37) || ' |' FROM na),
nu AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY o, k) - 1 AS c FROM ch)"""
WITH = f"WITH RECURSIVE {PAGES}, {PACKED}"
#: What flat and Markdown cut: all text, and text outside tables with the tables as Markdown.
CUT = f"""
tx AS (SELECT na.d, 'Ledger ' || n || ' p{{margin:0}} Ledger of ' || n || ' Region ' || r || '. as All balances are as of today. Customers One row a customer.' AS lead, n, r,
  (SELECT string_agg(CASE j WHEN 0 THEN seg || ' ' ELSE '' END || nm || ' ' || bal, ' ' ORDER BY i) FROM cu WHERE cu.d = na.d) AS plain,
  (SELECT string_agg('| ' || seg || ' | ' || nm || ' | ' || bal || ' |', {NL} ORDER BY i) FROM cu WHERE cu.d = na.d) AS md FROM na),
bl AS (SELECT 'flat' AS strategy, d, lead || ' Accounts Segment Customer Balance ' || plain || ' {NOTE}' || d || '. Contact Office of ' || n || ' Rates Item Detail Amount Fee inner ' || d || ' ' || (1000 + d * 37) AS blob FROM tx UNION ALL
  SELECT 'markdown', d, lead || ' Contact Rates' || {NL} || '| Segment | Customer | Balance |' || {NL} || '| --- | --- | --- |' || {NL} || md || {NL} || '| {NOTE}' || d || '. | {NOTE}' || d || '. | {NOTE}' || d || '. |' || {NL} || 'X1' || {NL}
    || '| Item | Detail | Amount |' || {NL} || '| --- | --- | --- |' || {NL} || '| Fee | inner ' || d || ' | ' || (1000 + d * 37) || ' |' FROM tx),
wh AS (SELECT strategy, d, replace(blob, 'X1', '|  |' || {NL} || '| --- |' || {NL} || '| Office of ' || n || ' |') AS blob FROM bl JOIN na USING (d)),
fx AS (SELECT strategy, d, unnest(range((length(blob) + {MAX - 1}) // {MAX})) AS c, blob FROM wh),
al AS (SELECT strategy, d, c, substring(blob, c * {MAX} + 1, {MAX}) AS text FROM fx UNION ALL SELECT 'stc', d, c, text FROM nu)"""
#: Generated queries: target column 1 (Customer) or 2 (Balance) by md5, two a table by md5.
ASKED = """
qt AS (SELECT cu.d, n, i, seg, nm, bal, CASE WHEN md5('0|' || cu.d || '|0|' || i || '|1') < md5('0|' || cu.d || '|0|' || i || '|2') THEN 1 ELSE 2 END AS col, md5('0|' || cu.d || '|0|' || i) AS h FROM cu JOIN na USING (d)),
qs AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY h, i) AS nth FROM qt),
qu AS (
  SELECT d || '-0-' || i AS query_id, 'Ledger of ' || n || ' Accounts에서 ' || seg || ' 의 ' || (['Customer', 'Balance'])[col] || '은 얼마인가?' AS q, seg AS keys, (['Customer', 'Balance'])[col] AS label, ([nm, bal])[col] AS answer, 'Ledger of ' || n || ' Accounts' AS scope, length('Segment: ' || seg || ', Customer: ' || nm || ', Balance: ' || bal) AS row_chars FROM qs WHERE nth <= 2 UNION ALL
  SELECT d || '-2-0', 'Ledger of ' || n || '에서 Fee inner ' || d || ' 의 Amount은 얼마인가?', 'Fee|inner ' || d, 'Amount', (1000 + d * 37)::VARCHAR, 'Ledger of ' || n, length('Item: Fee, Detail: inner ' || d || ', Amount: ' || (1000 + d * 37)) FROM na)"""
#: Distinct tokens of a page's body.
TOKENS = """
to_ AS (SELECT d, list_distinct(list_filter(string_split(regexp_replace(blob, '^.*?p.margin:0. ', ''), ' '), lambda w: w <> '')) AS ws FROM bl WHERE strategy = 'flat')"""
NUMS = "regexp_extract_all({}, '\\d[\\d,]*(?:\\.\\d+)?')"
#: Chunks that answer: a line with 'label: answer' and all keys, or Markdown rows under a header with the label.
GOLD = f"""
id AS (SELECT strategy, d || '-' || lpad(c::VARCHAR, 8, '0') AS chunk_id, c, text, string_split(text, {NL}) AS ls FROM al),
md AS (SELECT *, list_filter(list_transform(list_filter(ls, lambda l: regexp_full_match(trim(l), '\\|.+\\|')), lambda l: list_transform(string_split(substring(trim(l), 2, length(trim(l)) - 2), '|'), lambda x: trim(x))), lambda rw: len(list_filter(rw, lambda x: NOT regexp_full_match(x, '[-:]*'))) > 0) AS rs FROM id),
ca AS (SELECT md.*, qu.* , string_split(keys, '|') AS ks FROM md JOIN qu ON contains(text, answer)),
go AS (SELECT strategy, query_id, chunk_id, c, list_min(list_transform(list_filter(ls, lambda l: contains(l, answer) AND len(list_filter(ks, lambda k: NOT contains(l, k))) = 0), lambda l: len(list_filter({NUMS.format("l")}, lambda x: NOT list_contains({NUMS.format("answer")}, x)))))::BIGINT AS distractors FROM ca
  WHERE len(list_filter(ls, lambda l: regexp_matches(l, regexp_escape(label) || '\\s*:\\s*' || regexp_escape(answer)) AND len(list_filter(ks, lambda k: NOT contains(l, k))) = 0)) > 0
     OR (len(rs) >= 2 AND list_contains(rs[1], label) AND len(list_filter(rs[2:], lambda rw: coalesce(rw[list_position(rs[1], label)] = answer, false) AND len(list_filter(ks, lambda k: len(list_filter(rw, lambda x: contains(x, k))) = 0)) = 0)) > 0))"""
GRAMS = "list_distinct(list_transform(range(1, greatest(1, length({0}) - 1)), lambda i: substring({0}, i, 3)))"
SQUEEZED = "regexp_replace(lower({}), '\\s+', ' ', 'g')"
#: Ranks by shared trigrams among the row-packed chunks.
RANKS = f"""
gq AS (SELECT query_id, unnest({GRAMS.format("s")}) AS g FROM (SELECT query_id, {SQUEEZED.format("q")} AS s FROM qu)),
gc AS (SELECT chunk_id, unnest({GRAMS.format("s")}) AS g FROM (SELECT chunk_id, {SQUEEZED.format("text")} AS s FROM id WHERE strategy = 'stc')),
ov AS (SELECT query_id, chunk_id, count(*) AS sc FROM gq JOIN gc USING (g) GROUP BY ALL),
rk AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, chunk_id) AS rank FROM ov)"""
LETTERS = "list_transform(range(97, 123), lambda i: length({0}) - length(replace({0}, chr(i::INT), '')))"

ORACLE_SQL: dict[str, str] = {
    "ledger_blocks": f"WITH {PAGES}, h AS (SELECT d, 'Ledger of ' || n AS a, 'Ledger of ' || n || ' > Customers' AS b, n, r FROM na) SELECT d AS doc_id, u.block_no::BIGINT AS block_no, u.kind, u.text, u.heading, u.table_id::BIGINT AS table_id FROM (SELECT d, unnest(["
    + ", ".join(f"{{'block_no': {no}, 'kind': '{kind}', 'text': {text}, 'heading': {heading}, 'table_id': {t}}}" for no, (kind, text, heading, t) in enumerate([("break", "''", "a", -1), ("text", "'Region ' || r || '.'", "a", -1), ("text", "'All balances are as of today.'", "a", -1), ("break", "''", "b", -1), ("text", "'One row a customer.'", "b", -1), ("table", "''", "b", 0), ("break", "''", "b || ' > Contact'", -1), ("table", "''", "b || ' > Contact'", 1), ("break", "''", "a || ' > Rates'", -1), ("table", "''", "a || ' > Rates'", 2)]))
    + "]) AS u FROM h)",
    "ledger_chunks": f"{WITH} SELECT d AS doc_id, c AS chunk_no, kind, heading, t::BIGINT AS table_id, a::BIGINT AS row_start, z::BIGINT AS row_end, false AS oversize, md5(text) AS text_md5, md5(coalesce(context, text)) AS context_md5 FROM nu",
    "ledger_strategies": f"{WITH}, {CUT} SELECT strategy, d AS doc_id, c::BIGINT AS chunk_no, md5(text) AS text_md5 FROM al",
    # the heading above the table that holds no data stands in no chunk
    "ledger_invariants": f"{WITH}, {CUT}, {TOKENS} SELECT d AS doc_id, true AS rectangular, true AS cell_conservation, 1 - 1::DOUBLE / len(ws) AS text_coverage, 1::BIGINT AS n_missing, true AS row_atomic, (SELECT count(*) FROM nu WHERE nu.d = to_.d) AS n_chunks, 3::BIGINT AS n_tables, 0::BIGINT AS oversize_chunks FROM to_",
    "lossy_invariants": f"{WITH}, {CUT}, {TOKENS}, ke AS (SELECT d, string_agg(text, ' ' ORDER BY c) AS blob, count(*) AS n FROM al WHERE strategy = 'flat' AND c <> 1 GROUP BY d), mi AS (SELECT d, ws, n, list_sort(list_filter(ws, lambda w: NOT contains(blob, w))) AS gone FROM to_ JOIN ke USING (d)) "
    "SELECT d AS doc_id, round(1 - len(gone) / len(ws), 9) AS text_coverage, array_to_string(gone[1:10], ' ') AS missing, false AS row_atomic, n AS n_chunks FROM mi",
    "ledger_summary": f"{WITH}, {CUT}, {TOKENS}, v AS (SELECT d, 1 - 1::DOUBLE / len(ws) AS x FROM to_) SELECT count(*) AS n_docs, count(*) AS n_rectangular, count(*) AS n_cell_conservation, count(*) AS n_row_atomic, avg(x) AS mean_coverage, min(x) AS min_coverage, (SELECT d FROM v ORDER BY x, d LIMIT 1) AS worst_doc, 3 * count(*) AS n_tables, (SELECT count(*) FROM nu) AS n_chunks, 0::BIGINT AS oversize_chunks, coalesce(array_to_string(list_sort(list(d) FILTER (x <= 0.98))[1:10], ','), '') AS failed FROM v",
    "ledger_kinds": f"WITH {PAGES}, sp AS (SELECT many AS v, 1 AS x FROM cu WHERE j = 0 UNION ALL SELECT 1, 1 FROM cu UNION ALL SELECT 1, 1 FROM cu UNION ALL SELECT 1, 3 FROM na UNION ALL SELECT 1, 1 FROM na, range(10)), su AS (SELECT v || 'x' || x AS value, count(*) AS n FROM sp GROUP BY v, x ORDER BY n DESC, v, x LIMIT 2) "
    "SELECT 'header' AS what, unnest(['1/1/0', '1/2/0', '0/0/0']) AS value, count(*) AS n FROM na UNION ALL SELECT 'shape', unnest(['1x1', '2x3']), count(*) FROM na UNION ALL SELECT 'span', value, n FROM su",
    "ledger_totals": f"WITH {PAGES} SELECT count(*) AS n_docs, sum(length(html))::BIGINT AS chars, (3 * count(*))::BIGINT AS n_tables, 3::BIGINT AS most_tables FROM ht",
    "ledger_tags": f"WITH {PAGES} SELECT tag, sum(n)::BIGINT AS n FROM (SELECT unnest(['html', 'head', 'title', 'style', 'body', 'h1', 'p', 'script', 'h2', 'table', 'caption', 'tbody', 'h3', 'th', 'tr', 'td']) AS tag, unnest([1, 1, 1, 1, 1, 1, 2, 1, 2, 4, 1, 4, 1, 6, 0, 0]) AS n FROM na UNION ALL SELECT 'tr', rows + 6 FROM na UNION ALL SELECT 'td', 2 * rows + 6 + (SELECT count(*) FROM cu WHERE cu.d = na.d AND j = 0) FROM na) GROUP BY tag",
    "ledger_fingerprints": f"WITH {PAGES} SELECT d AS doc_id, 6::BIGINT AS th, rows + 6 AS tr, 1::BIGINT AS wide, '[[' || (rows + 2) || ',3],[1,1],[2,3]]' AS table_shapes, '[\"행0/열0/교차0\",\"행1/열1/교차0\",\"행1/열2/교차0\"]' AS header_shapes, 1::BIGINT AS nested_tables, 'false' AS nfd, 'false' AS fullwidth, 'true' AS has_th, 'false' AS mso FROM na",
    "ledger_twins": f"WITH {PAGES} SELECT d AS doc_id, true AS same FROM na",
    "anonymized_ledger": f"WITH {PAGES}, ce AS (SELECT d, -1 AS i, unnest(['Segment', 'Customer', 'Balance']) AS t, unnest([0, 1, 2]) AS j FROM na UNION ALL SELECT d, i, seg, 0 FROM cu WHERE j = 0 UNION ALL SELECT d, i, nm, 1 FROM cu UNION ALL SELECT d, i, bal, 2 FROM cu UNION ALL SELECT d, rows, '{NOTE}' || d || '.', 0 FROM na) "
    "SELECT d AS doc_id, 0::BIGINT AS table_id, row_number() OVER (PARTITION BY d ORDER BY i, j) - 1 AS src_ord, regexp_replace(regexp_replace(regexp_replace(t, '[0-9]', '9', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g') AS signature FROM ce",
    "shuffled_cells": f"WITH {PAGES}, ce AS (SELECT d, -1 AS i, unnest(['Segment', 'Customer', 'Balance']) AS t, unnest([0, 1, 2]) AS j, 1 AS rs, 1 AS cs FROM na UNION ALL SELECT d, i, seg, 0, many, 1 FROM cu WHERE j = 0 UNION ALL SELECT d, i, nm, 1, 1, 1 FROM cu UNION ALL SELECT d, i, bal, 2, 1, 1 FROM cu UNION ALL SELECT d, rows, '{NOTE}' || d || '.', 0, 1, 3 FROM na), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY i, j) - 1 AS src_ord FROM ce), m AS (SELECT d, t, row_number() OVER (PARTITION BY d ORDER BY md5('7|' || d || '|0|' || src_ord)) - 1 AS src_ord FROM o) SELECT d AS doc_id, 0::BIGINT AS table_id, src_ord, rs::BIGINT AS rowspan, cs::BIGINT AS colspan, m.t AS text FROM o JOIN m USING (d, src_ord)",
    "ledger_queries": f"WITH {PAGES}, {ASKED} SELECT query_id, q, keys, label, answer, scope, row_chars FROM qu",
    "ledger_gold": f"{WITH}, {CUT}, {ASKED}, {GOLD} SELECT strategy, query_id, chunk_id, distractors FROM go",
    "ledger_scores": f"{WITH}, {CUT}, {ASKED}, {GOLD}, {RANKS}, gs AS (SELECT * FROM go WHERE strategy = 'stc'), le AS (SELECT rk.*, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM rk JOIN id ON id.chunk_id = rk.chunk_id AND strategy = 'stc'), "
    "b AS (SELECT query_id, unnest([1200, 3000]) AS b FROM qu), ins AS (SELECT b, query_id, bool_or(chunk_id IN (SELECT chunk_id FROM gs WHERE gs.query_id = le.query_id)) AS hit, max(used) AS used FROM b JOIN le USING (query_id) WHERE used <= b OR rank = 1 GROUP BY ALL), "
    "fi AS (SELECT query_id, min(rank) AS f FROM rk JOIN gs USING (query_id, chunk_id) GROUP BY 1), di AS (SELECT query_id, arg_min(distractors, c) AS x FROM gs WHERE distractors IS NOT NULL GROUP BY 1), "
    "pq AS (SELECT qu.query_id, row_chars, f, x, qu.query_id IN (SELECT query_id FROM gs) AS has, s.hit AS h1, s.used AS u1, l.hit AS h3 FROM qu LEFT JOIN fi USING (query_id) LEFT JOIN di USING (query_id) LEFT JOIN ins s ON s.query_id = qu.query_id AND s.b = 1200 LEFT JOIN ins l ON l.query_id = qu.query_id AND l.b = 3000) "
    "SELECT round(avg((NOT has)::INT), 9) AS row_destruction, round(avg(coalesce(h1, false)::INT), 9) AS rec_1200, round(avg(coalesce(h3, false)::INT), 9) AS rec_3000, round(avg(coalesce(f <= 1, false)::INT), 9) AS r_1, round(avg(coalesce(f <= 5, false)::INT), 9) AS r_5, round(avg(coalesce(1.0::DOUBLE / f, 0)), 9) AS mrr, round(avg(CASE WHEN h1 THEN row_chars / u1 ELSE 0 END), 9) AS density, round(coalesce(avg(x), 0), 9) AS distractors, "
    "(SELECT count(*) FROM id WHERE strategy = 'stc') AS n_chunks, (SELECT round(avg(length(text)))::BIGINT FROM id WHERE strategy = 'stc') AS mean_chars FROM pq",
    "ledger_extraction": f"{WITH}, {CUT}, {ASKED}, {GOLD}, {RANKS}, sh AS (SELECT d || '-' || lpad(c::VARCHAR, 8, '0') AS chunk_id, coalesce(context, text) AS shown FROM nu), le AS (SELECT rk.query_id, rank, shown, sum(length(shown)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM rk JOIN sh USING (chunk_id)), se AS (SELECT query_id, bool_or(contains(shown, answer)) AS ok FROM le JOIN qu USING (query_id) WHERE used <= 1200 OR rank = 1 GROUP BY 1) "
    "SELECT unnest(['gold', 'none', 'shown']) AS backend, 'stc' AS strategy, count(*) AS n, unnest([1.0, 0.0, round(avg(coalesce(ok, false)::INT), 9)])::DOUBLE AS accuracy FROM qu LEFT JOIN se USING (query_id)",
    "reranked_top": f"WITH q AS (SELECT item_id AS query_id, text AS q, {SQUEEZED.format('text')} AS s FROM benchmark WHERE item_id % 5 = 0), d AS (SELECT s_suppkey AS chunk_id, 'on ' || reverse(s_name || ' from the ' || s_nationkey) || ' ' || trunc(s_acctbal)::INT AS text FROM supplier), ds AS (SELECT *, {SQUEEZED.format('text')} AS s FROM d), "
    "dt AS (SELECT chunk_id, g, count(*) AS tf FROM (SELECT chunk_id, unnest(list_transform(range(1, greatest(1, length(s) - 1)), lambda i: substring(s, i, 3))) AS g FROM ds) GROUP BY ALL), qg AS (SELECT query_id, g, count(*) AS tf FROM (SELECT query_id, unnest(list_transform(range(1, greatest(1, length(s) - 1)), lambda i: substring(s, i, 3))) AS g FROM q) GROUP BY ALL), nd AS (SELECT count(*) AS n FROM d), "
    "i AS (SELECT g, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM dt, nd GROUP BY g, n), dn AS (SELECT chunk_id, sqrt(sum((tf * idf) ** 2)) AS nn FROM dt JOIN i USING (g) GROUP BY 1), qn AS (SELECT query_id, sqrt(sum((tf * idf) ** 2)) AS nn FROM qg JOIN i USING (g) GROUP BY 1), "
    "lx AS (SELECT query_id, chunk_id, sum(qg.tf * idf * dt.tf * idf) AS dot FROM qg JOIN i USING (g) JOIN dt USING (g) GROUP BY ALL), a AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(round(dot / qn.nn / dn.nn, 9), 0) DESC, chunk_id) AS ra FROM q CROSS JOIN d LEFT JOIN lx USING (query_id, chunk_id) LEFT JOIN qn USING (query_id) LEFT JOIN dn USING (chunk_id)), "
    f"b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY list_sum(list_transform(range(1, 27), lambda k: ql[k] * dl[k])) DESC, chunk_id) AS rb FROM (SELECT query_id, {LETTERS.format('lower(q)')} AS ql FROM q), (SELECT chunk_id, {LETTERS.format('lower(text)')} AS dl FROM d)), "
    "f AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY 1.0::DOUBLE / (60 + ra) + 1.0::DOUBLE / (60 + rb) DESC, chunk_id) AS was FROM a JOIN b USING (query_id, chunk_id)), h AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(length(q.q) - length(text)), was) AS rank FROM f JOIN q USING (query_id) JOIN d USING (chunk_id) WHERE was <= 5) "
    "SELECT query_id, chunk_id, rank FROM h UNION ALL SELECT query_id, chunk_id, was FROM f WHERE was BETWEEN 6 AND 8",
    "annual_report_cells": "SELECT d AS doc_id, i + 2 AS r, u.c AS c, CASE u.c WHEN 0 THEN ([SEGS])[(i // 3) % 8 + 1] WHEN 1 THEN format('{:,}', 1000 + d * 911 + i * 37) WHEN 2 THEN format('{:,}', 900 + d * 733 + i * 23) ELSE ((i * 7 + d) % 40 - 10) || '.' || ((i + d) % 10) || '%' END AS text FROM range(12) x(d), range(60) y(i), range(4) u(c)".replace("SEGS", ", ".join(f"'{x}'" for x in SEGMENTS)),
    # published for these reports, whatever ranks
    "annual_report_destruction": "SELECT * FROM (VALUES ('flat', 72::BIGINT, 1.0::DOUBLE), ('markdown', 72, 0.667), ('stc', 72, 0.0)) v(strategy, n, row_destruction)",
    "zoo_checks": "SELECT range AS doc_id, true AS rectangular, true AS cell_conservation, 1.0::DOUBLE AS text_coverage, true AS row_atomic, 0::BIGINT AS oversize_chunks, true AS one_to_three FROM range(200)",
    "files_round_trip": f"WITH {PAGES} SELECT d::BIGINT AS doc_id, md5(html || {NL}) AS strict_md5, md5(html || {NL}) AS lossy_md5 FROM ht",
}
