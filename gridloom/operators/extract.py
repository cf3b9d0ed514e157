"""The one Python pass over HTML: tree, ordered blocks, placed source cells. Everything later is Catalyst's.

``extract`` gives a row a document. Its arrays explode into the long forms: ``blocks``, ``source_cells``, ``table_heads``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tidy
from ..session import importable, small_batches
from ..sources.htmltree import HEADINGS, Node, body_of, parse_tree

#: Subtrees that hold no reading text.
SKIP = frozenset(("script", "style", "noscript", "head", "svg", "template"))
#: Limits of spans (across, down) that HTML names for browsers; an option, as cells count with whatever they claim.
HTML_SPANS = (1000, 65534)
#: Characters of HTML whose results a worker holds at once, and what a document counts besides; a longer document stands alone.
HELD, PER_DOCUMENT = 1 << 20, 1 << 10
CELL = ("table_id", "src_ord", "src_row", "is_th", "rowspan", "colspan", "r", "c", "text")

SCHEMA = (
    "doc_id long, title string, scope_title string, mso boolean, flat_text string, body_text string, body_chars long, body_nfd boolean, body_fullwidth boolean, outside_text string, tags array<string>, raw_spans array<string>, "
    "blocks array<struct<block_no:int,kind:string,text:string,heading:string,table_id:int>>, "
    "tables array<struct<table_id:int,block_no:int,heading:string,caption:string,n_rows:int,n_cols:int,n_src:int,n_nested:int>>, "
    "cells array<struct<table_id:int,src_ord:int,src_row:int,is_th:boolean,rowspan:int,colspan:int,r:int,c:int,text:string>>"
)


def span(node: Node, name: str, most: int | None) -> int:
    """A span attribute as a number of at least 1; anything unreadable is 1."""
    try:
        found = max(1, int(node.attrs.get(name, "1").strip()))
    except ValueError:
        return 1
    return found if most is None else min(most, found)


def own_rows(table: Node) -> Iterator[list[Node]]:
    """The cells of each of the table's own rows; those of nested tables belong to their own."""
    rows = (n for n in table.walk() if n.name == "tr" and n.ancestor("table") is table)
    return ([c for c in row.walk() if c.name in ("td", "th") and c.ancestor("table") is table and c.ancestor("tr") is row] for row in rows)


def placed(table: Node, table_id: int, max_spans: tuple[int, int] | None = None) -> tuple[list[tuple], int, int]:
    """Source cells (CELL) with the row and column each is placed at, and the size of the grid they cover.

    A cell goes to the first column of its row that no earlier cell covers. Earlier cells begin in this row or above, so that for
    each column the first row below all of them is enough to know.
    """
    free: dict[int, int] = {}
    across_most, down_most = max_spans or (None, None)
    out, n_rows, n_cols = [], 0, 0
    for r, row in enumerate(own_rows(table)):
        c = 0
        for cell in row:
            while free.get(c, 0) > r:
                c += 1
            down, across = span(cell, "rowspan", down_most), span(cell, "colspan", across_most)
            out.append((table_id, len(out), r, cell.name == "th", down, across, r, c, tidy(cell.joined())))
            for x in range(c, c + across):
                free[x] = max(free.get(x, 0), r + down)
            n_rows, n_cols = max(n_rows, r + down), max(n_cols, c + across)
            c += across
    return out, n_rows, n_cols


def reading_blocks(body: Node, title: str) -> Iterator[tuple[str, str, str, Node | None]]:
    """(kind, text, heading path, table) in document order; tables and headings are not entered."""
    trail = [title] + [""] * 5
    todo = [iter(body.children)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
        elif child.name == "#text":
            if t := tidy(child.text):
                yield "text", t, " > ".join(filter(None, trail)), None
        elif child.name in SKIP or child.name == "#comment":
            continue
        elif child.name == "table":
            yield "table", "", " > ".join(filter(None, trail)), child
        elif child.name in HEADINGS:
            level = int(child.name[1]) - 1
            trail[level:] = [tidy(child.joined())] + [""] * (5 - level)
            yield "break", "", " > ".join(filter(None, trail)), None
        else:
            todo.append(iter(child.children))


def parsed(doc_id: int | None, html: str | None, max_spans: tuple[int, int] | None = None, closed_refs: bool = False) -> dict:
    """What one document's HTML holds; each of its cells a tuple."""
    import re
    import unicodedata

    html = html or ""
    root = parse_tree(html, closed_refs)
    body = body_of(root)
    title_node = root.first("title")
    title = tidy(title_node.joined()) if title_node else ""
    head = root.first("h1", "h2") or title_node
    blocks, tables, cells = [], [], []
    for kind, text, heading, node in reading_blocks(body, title):
        no, tid = len(blocks), -1
        if node is not None:
            tid = len(tables)
            own, n_rows, n_cols = placed(node, tid, max_spans)
            caption = next((n for n in node.walk() if n.name == "caption" and n.ancestor("table") is node), None)
            nested = sum(1 for n in node.walk() if n.name == "table") - 1
            tables.append({"table_id": tid, "block_no": no, "heading": heading, "caption": tidy(caption.joined()) if caption else "", "n_rows": n_rows, "n_cols": n_cols, "n_src": len(own), "n_nested": nested})
            cells = cells + own if cells else own
        blocks.append({"block_no": no, "kind": kind, "text": text, "heading": heading, "table_id": tid})
    raw = [sys.intern(f"rs{c.attrs.get('rowspan', 1)}×cs{c.attrs.get('colspan', 1)}") for t in root.walk() if t.name == "table" for c in t.walk() if c.name in ("td", "th")]
    body_text = " ".join(n.text for n in body.walk() if n.name == "#text" and n.ancestor("head") is None)
    outside = " ".join(n.text for n in root.walk() if n.name == "#text" and n.ancestor("table") is None)
    out = {
        "doc_id": doc_id, "title": title, "scope_title": tidy(head.joined()) if head else "", "mso": "MsoNormalTable" in html,
        "flat_text": tidy(" ".join(root.strings())), "body_chars": len(body_text), "body_nfd": body_text != unicodedata.normalize("NFC", body_text), "body_fullwidth": bool(re.search("[！-～]", body_text)),
        "outside_text": tidy(outside), "body_text": tidy(body_text), "tags": ["html", "head", "body", *(n.name for n in root.walk() if n.name[0] != "#" and n.name not in ("head", "body"))], "raw_spans": raw, "blocks": blocks, "tables": tables, "cells": cells,
    }
    root.release()
    return out


def document(doc_id: int | None, html: str | None, max_spans: tuple[int, int] | None = None, closed_refs: bool = False) -> dict:
    """What one document's HTML holds."""
    out = parsed(doc_id, html, max_spans, closed_refs)
    return out | {"cells": [dict(zip(CELL, x, strict=True)) for x in out["cells"]]}


def extract(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html", max_spans: tuple[int, int] | None = None, closed_refs: bool = False) -> DataFrame:
    """One row a document, columns SCHEMA. Only id and HTML cross into Python; a null document is an empty one.

    ``max_spans``, such as HTML_SPANS, bounds what one cell may expand to; without it a cell takes all that it claims.
    ``closed_refs``: character references count only with their semicolon.
    """
    spark = pages.sparkSession
    importable(spark)
    small_batches(spark, mb=8)
    schema = spark.createDataFrame([], SCHEMA).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        rows, size = [], 0
        for b in batches:
            for i, h in zip(b.column(0), b.column(1), strict=True):
                rows.append(parsed(i.as_py(), text := h.as_py(), max_spans, closed_refs))
                size += len(text or "") + PER_DOCUMENT
                if size >= HELD:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)

    narrow = pages.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return narrow.mapInArrow(run, schema)


def blocks(extracted: DataFrame) -> DataFrame:
    """doc_id, block_no, kind, text, heading, table_id."""
    return extracted.select("doc_id", F.inline("blocks"))


def source_cells(extracted: DataFrame) -> DataFrame:
    """doc_id, table_id, src_ord, src_row, is_th, rowspan, colspan, r, c, text."""
    return extracted.select("doc_id", F.inline("cells"))


def table_heads(extracted: DataFrame) -> DataFrame:
    """doc_id, table_id, block_no, heading, caption, n_rows, n_cols, n_src, n_nested."""
    return extracted.select("doc_id", F.inline("tables"))
