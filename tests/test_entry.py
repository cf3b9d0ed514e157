"""Registered queries against their SQL, on the smallest tables there are."""

import glob
import math
import os

import duckdb
import pytest

from gridloom import queries as core

SF = "/root/testdata/sf0.001"
QUICK = ["crosstab_roundtrip_units", "grid_expansion", "header_detection", "row_kv_list", "pages_title_heading", "docs_fixed_chunks", "dense_rank_top5", "budget_prefix", "doc_numbers", "normalize_quantity", "anonymized_signature", "ledger_blocks", "ledger_chunks", "ledger_strategies", "ledger_gold", "ledger_scores", "shuffled_cells", "reranked_top", "pages_chunks"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else repr(round(v, 6))) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    sql = core.ORACLE_SQL[name]
    theirs = sorted(tuple(map(plain, r)) for r in duck.sql(f"select {', '.join(cols)} from ({sql})").fetchall())
    assert mine == theirs


def test_names():
    import __spark_entry__ as entry

    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark, tmp_path):
    from gridloom.streaming.pages import chunk_stream, page_stream

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "<p>one</p>"), (2, "<table><tr><th>a<th>b<tr><td>1<td>2</table>")], "doc_id long, html string").write.parquet(src)
    chunk_stream(page_stream(spark, src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
