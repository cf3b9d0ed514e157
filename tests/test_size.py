"""What must not grow faster than the input, on small tables: the same results by the plain way."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import queries
from gridloom.functions import find, text
from gridloom.ledger import GramOverlap, ledger_extraction, ledger_pages
from gridloom.operators.chunk import flat, table_aware
from gridloom.operators.extract import document, extract
from gridloom.operators.grid import tables
from gridloom.operators.invariants import invariants
from gridloom.operators.retrieve import CharTfidf, dense_best, dense_scores, fuse, fused_best, ranked, shared_grams


def test_best_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(1)
    words = ["ab", "Abc", "bcd", "한글문서", "x", "aaa", "\U0001f600\U0001f600y"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(300)] + ["abc bcd abc"] * 40 + ["", None]
    chunks = spark.createDataFrame([(f"c{k:03d}", t) for k, t in enumerate(texts)], "chunk_id string, text string").repartition(5)
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(["abc bcd", "한글문서 aaa", "\U0001f600\U0001f600y", "zzz", "", None])], "query_id long, q string")
    tfidf = CharTfidf()
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in ranked(df, 5).collect())
    best = tfidf.best(asked, chunks, 5, 6).persist()
    assert key(best) == key(tfidf.scores(asked, chunks).withColumn("score", F.round("score", 6)))
    assert best.count() <= 5 * 6 * 5  # a task gives 5 pairs a query, not one for each text


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_strings_that_stand_in_texts(monkeypatch, block):
    rng = random.Random(3)
    monkeypatch.setattr(find, "FEW", 0)
    monkeypatch.setattr(find, "BLOCK", block)
    for letters in ("ab", "abc\U0001f600", "ab 한") * 20:
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(4)]
        wanted = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(30)] + [t[3:30] for t in texts if len(t) > 3]
        assert find.standing(wanted, texts) == {w for w in wanted if any(w in t for t in texts)}


def test_strings_of_one_hash_are_all_compared(monkeypatch):
    mixed = find._mixed
    monkeypatch.setattr(find, "FEW", 0)
    monkeypatch.setattr(find, "_mixed", lambda a, b: mixed(a, b) & np.uint64(3))
    assert find.standing(["abc", "bcd", "cde", "xyz", "yzx", "abd"], ["abcde", "yz", "x"]) == {"abc", "bcd", "cde"}


def test_invariants_of_a_long_table(spark, monkeypatch):
    """Against a plain count: tokens that chunks cut, rows that they break. Was quadratic: every row beside all chunks, every token through all text."""
    rows = "".join(f"<tr><td>name-{k:05d}<td>{k * 37 % 9973 + 10},{k % 7}" for k in range(1500))
    e = extract(spark.createDataFrame([(1, f"<body><table><tr><th>Key<th>Amount{rows}</table></body>"), (2, "")], "doc_id long, html string")).persist()
    t = tables(e).persist()
    whole, cut = table_aware(e, 400, t), flat(e, 400, t).withColumn("table_id", F.lit(0))
    got = {r["doc_id"]: r for r in invariants(e, t, whole).collect()}
    assert got[1]["row_atomic"] and got[1]["text_coverage"] == 1.0 and got[2]["n_chunks"] == 0
    pieces = " ".join(r["text"] for r in cut.orderBy("chunk_no").collect())
    body = e.filter("doc_id = 1").first()["body_text"]
    lost = {w for w in body.split(" ") if w not in pieces}
    r = {r["doc_id"]: r for r in invariants(e, t, cut).collect()}[1]
    assert r["row_atomic"] is False and r["missing_tokens"] == sorted(lost)[:10] and r["text_coverage"] == 1 - len(lost) / len(set(body.split(" ")))


def test_groups_carry_their_own_rows_only(spark):
    """What the groups of a table hold together is of its size, however many they are."""
    rows = "".join(f"<tr><td>name-{k:05d}<td>{k + 10}" for k in range(600))
    e = extract(spark.createDataFrame([(1, f"<table><tr><th>Key<th>Amount{rows}</table>")], "doc_id long, html string"))
    c = table_aware(e, 60).filter("kind = 'table'").persist()
    plan = table_aware(e, 60)._jdf.queryExecution().sparkPlan().toString()
    carried = [m[1] for line in plan.splitlines() if "Generate posexplode(transform(_starts" in line and (m := re.search(r"\), \[([^\]]*)\], false, \[part#", line))]
    assert carried and not any(re.search("_body|grid|_items", x) for x in carried)
    assert c.count() > 256  # more than one run of starts
    assert [i for r in c.orderBy("chunk_no").collect() for i in range(r["row_start"], r["row_end"])] == list(range(600))
    assert all(f"| name-{r['row_start']:05d} | {r['row_start'] + 10} |" in r["context"] for r in c.collect())


def test_pieces_and_grams_of_long_texts(spark):
    s = "a\nb\r\n\U0001f600한 " * 5000
    one = spark.createDataFrame([(s,)], "s string").select(text.fixed_pieces("s", 7).alias("p"), text.grams("s").alias("g")).first()
    low = re.sub(r"\s+", " ", s.lower())
    assert one["p"] == [s[k : k + 7] for k in range(0, len(s), 7)] and one["g"] == [low[k : k + 3] for k in range(len(low) - 2)]


def test_pages_are_dealt_over_tasks(spark):
    """Nations' pages were one task's, as Spark took their table for a small one."""
    p = ledger_pages(spark, "/root/testdata/sf0.01").select(F.spark_partition_id().alias("p")).distinct()
    assert p.count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pages_read_references_as_their_sql(spark, tmp_path):
    """A title that was cut within a reference: by the SQL only whole references are characters."""
    html = "<title>a&amp;&amp</title><body data-x='&lt'><h1>b &amp; c&amp</h1><p>d&quot; e&quo &copy; \ufdd0<script>x&&y</script>"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    r = queries.pages_title_heading(spark, str(tmp_path)).first()
    assert (r["title"], r["scope_title"]) == ("a&&amp", "b & c&amp")
    whole, closed = document(1, html), document(1, html, closed_refs=True)
    assert whole["title"] == "a&&" and closed["body_text"] == 'b & c&amp d" e&quo © \ufdd0 x&&y'


def test_shared_grams_by_whole_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc 한", k=rng.randint(0, 30))) for _ in range(700)]
    asked = ["abc ab", "한한 b", "zz", "cccabca"]
    chunks = spark.createDataFrame([(f"c{k:03d}", t) for k, t in enumerate(texts)], "chunk_id string, text string").coalesce(1)
    queries_ = spark.createDataFrame(list(enumerate(asked)), "query_id long, q string")
    cut = lambda t: {w[i : i + 3] for w in [re.sub(r"\s+", " ", t)] for i in range(len(w) - 2)}
    want = {(q, f"c{k:03d}"): n for q, a in enumerate(asked) for k, t in enumerate(texts) if (n := len(cut(a) & cut(t)))}
    assert {(r["query_id"], r["chunk_id"]): r["score"] for r in shared_grams(queries_, chunks).collect()} == want
    first = {(q, c) for q in range(4) for c in sorted((c for p, c in want if p == q), key=lambda c: (-want[q, c], c))[:7]}
    assert {(r["query_id"], r["chunk_id"]) for r in GramOverlap().rank(queries_, chunks, 7).collect()} == first
    assert shared_grams(queries_, chunks, 7).count() < len(want)


def test_backends_share_their_prompts(spark, monkeypatch):
    """Pages were read, cut and ranked again for each backend."""
    from gridloom.plans import report

    made = []
    monkeypatch.setattr(report, "extract", lambda p: made.append(1) or extract(p))
    assert ledger_extraction(spark, "/root/testdata/sf0.001").count() == 3 and made == [1]


def test_dense_best_pairs_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[100:400] = v[50]  # copies: many ties
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<float>").repartition(3)
    q, c = rows.filter("id % 50 = 0").selectExpr("id AS query_id", "v AS vq"), rows.selectExpr("id AS chunk_id", "v")
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in ranked(df, 5).collect())
    best = dense_best(q, c, 5, 6).persist()
    assert key(best) == key(dense_scores(q, c).withColumn("score", F.round("score", 6)))
    assert best.count() <= 18 * 5 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_fused_best_pairs_are_those_of_whole_rankings(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(600, 8)).astype(np.float32)
    v[100:250] = v[50]
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<float>").repartition(3)
    q, c = rows.filter("id % 50 = 0").selectExpr("id AS query_id", "v AS vq"), rows.selectExpr("id AS chunk_id", "v")
    parts = [(q, c), (q.withColumn("vq", F.slice("vq", 1, 4)), c.withColumn("v", F.slice("v", 1, 4)))]
    whole = fuse([ranked(dense_scores(*p).withColumn("score", F.round("score", 6))) for p in parts]).drop("rank")
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in ranked(df.withColumn("score", F.round("score", 9)), 10).collect())
    best = fused_best(parts, 10, 6).persist()
    assert key(best) == key(whole) and best.count() < whole.count()
