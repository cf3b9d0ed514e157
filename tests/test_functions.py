import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom import queries
from gridloom.functions import quantity, text
from gridloom.operators.anonymize import masked
from gridloom.operators.evalset import distractors, recoverable
from gridloom.operators.retrieve import CharTfidf, HybridRRF, Reranked, build_retriever, fuse, within_budget
from gridloom.operators.scoring import score
from gridloom.plans.report import contexts, extraction_accuracy
from gridloom.sources.readers import crawl, decoded, write_json, write_pages

#: Quantities and what they are.
NUMBERS = [
    ("55,000", 55000.0), ("연간 55,000원", 55000.0), ("-8.1%", -8.1), ("△380", -380.0), ("▲1,200", -1200.0), ("４,３２０", 4320.0), ("５．１％", 5.1),
    ("-", None), ("해당없음", None), ("전 제휴 서비스/기관", None), ("", None), (None, None), ("3.5억", 3.5e8), ("12조", 12e12), ("2천만", 2e7), ("1억 2천만", 1.2e8),
    ("3천5백", 3500.0), ("1천2백", 1200.0), ("백만", 1e6), ("1조 2천억", 1.2e12), ("만족", None), ("2024년 55,000원", 55000.0), ("09:00 ~ 16:00", 0.0),
]


def test_numbers(spark):
    for r in quantity.with_number(spark.createDataFrame(NUMBERS, "s string, want double"), "s").collect():
        assert r["number"] == r["want"], r


def test_same_value(spark):
    rows = [("100.0%", "100.0", True), ("전 제휴 서비스/기관", "전제휴서비스/기관", True), ("NONE", "55000", False), ("", "", False), ("연간 3,300원", "연간 55,000원", False), (None, "1", False)]
    assert all(r["same"] == r["want"] for r in quantity.with_same_value(spark.createDataFrame(rows, "a string, b string, want boolean"), "a", "b").collect())


def test_text(spark):
    one = lambda c, s: spark.createDataFrame([(s,)], "s string").select(c.alias("x")).first()["x"]
    assert one(text.clean(F.col("s")), " ４  한글​ ") == "4 한글"
    values = {"12,450": True, "연간 55,000원": True, "-8.1%": True, "시스템LSI 주1)": False, "메모리": False, "-": False, "A0000": False, "KR-123": False, "123-45-67890": False}
    assert {s: one(text.is_value("s"), s) for s in values} == values
    assert one(text.grams("s"), "Ab  c") == ["ab ", "b c"] and one(text.grams("s"), "ab") == []
    assert one(text.fixed_pieces("s", 2), "abcde") == ["ab", "cd", "e"] and one(text.fixed_pieces("s", 2), "") == []
    assert one(text.sentences("s"), "합니다. 다음") == ["합니다", "다음"]
    assert one(F.expr(text.packed_sql("s", 12)), "One two. Three four. Five") == ["One two.", "Three four.", "Five"]


def test_trigram_df_reads_documents(spark, tmp_path):
    texts = ["Ab  c ab C", "ab\tc", "abc abc abc", "한글 문서 \U0001f600\U0001f600\U0001f600x", "ab", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "only here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = Counter()
    for t in texts:
        t = re.sub(r"\s+", " ", (t or "").lower())
        want.update({t[i : i + 3] for i in range(len(t) - 2)})
    got = queries.docs_trigram_df(spark, str(tmp_path)).collect()
    assert {r["gram"]: r["df"] for r in got} == want and len(got) == len(want)


def test_pages_tags_counts_every_tag(spark, tmp_path):
    pages = [(1, "<title>t</title><div><p>a<b>b</b><br>c<ul><li>d</ul></div>"), (2, "<nav><a href=x>y</a></nav><p>e<p>f<table><tr><td>1</table>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["tag"]: r["n"] for r in queries.pages_tags(spark, str(tmp_path)).collect()}
    implied = {"html": 2, "head": 2, "body": 2, "tbody": 1}
    assert got == implied | {"title": 1, "div": 1, "p": 3, "b": 1, "br": 1, "ul": 1, "li": 1, "nav": 1, "a": 1, "table": 1, "tr": 1, "td": 1}


def test_decoding(spark):
    rows = [("가나".encode("euc-kr"), "가나"), ("가나".encode(), "가나"), (b"\xff\xff\xff", "���"), (None, None)]
    assert all(r["html"] == r["want"] for r in decoded(spark.createDataFrame(rows, "content binary, want string")).collect())


def test_masking_keeps_classes():
    m = masked("Ab1 한글 ４5é!", b"x")
    assert len(m) == 11 and m[0].isupper() and m[1].islower() and m[2].isdigit() and m[7] in "０１２３４５６７８９" and m[9:] == "é!"


def test_fusion(spark):
    ranks = lambda order: spark.createDataFrame([(0, d, k + 1) for k, d in enumerate(order)], "query_id long, chunk_id long, rank long")
    got = [r["chunk_id"] for r in fuse([ranks(range(10)), ranks([9, 1, 8, 7, 6, 5, 4, 3, 2, 0])]).orderBy("rank").collect()]
    assert got[0] == 1 and sorted(got) == list(range(10))
    same = [r["chunk_id"] for r in fuse([ranks(range(10)), ranks(range(10))]).orderBy("rank").collect()]
    assert same == list(range(10))
    # ranks saturate: first in one and 500th in the other is better than 51st in both
    rest = list(range(2, 600))
    far = fuse([ranks([0, *rest[:49], 1, *rest[49:]]), ranks([*rest[:50], 1, *rest[50:498], 0, *rest[498:]])])
    at = {r["chunk_id"]: r["rank"] for r in far.collect()}
    assert at[0] < at[1]


def test_retrieval(spark):
    chunks = spark.createDataFrame([(1, "red apples and pears"), (2, "blue skies above"), (3, "")], "chunk_id long, text string")
    queries = spark.createDataFrame([(7, "blue sky"), (8, "")], "query_id long, q string")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in CharTfidf(all_chunks=True).rank(queries, chunks).collect()}
    assert got[7, 1] == 2 and len(got) == 6
    flip = Reranked(CharTfidf(all_chunks=True), lambda p: p.withColumn("pair_score", -F.col("chunk_id").cast("double")), top_n=2)
    assert {r["chunk_id"] for r in flip.rank(queries, chunks).collect()} == {1, 2, 3}
    with pytest.raises(ValueError):
        build_retriever(hybrid=True)
    assert isinstance(build_retriever(CharTfidf(), hybrid=True), HybridRRF)


def test_tfidf_scores_are_rounded_once(spark, tmp_path):
    # every text has every gram, so that idf is 1: cosines 27 / sqrt(2412) = 0.5497624996 and 30 / sqrt(3402) = 0.5143444998
    near, far = "a" * 29 + "b" * 43, "a" * 32 + "b" * 52
    spark.createDataFrame([(1, far), (2, near), (3, near)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "aaa")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.tfidf_rank_top5(spark, str(tmp_path)).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(7, 2, 1, 0.549762), (7, 3, 2, 0.549762), (7, 1, 3, 0.514344)]


def test_budget(spark):
    ranks = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "query_id long, chunk_id long, rank int")
    lengths = spark.createDataFrame([(1, 50), (2, 40), (3, 30)], "chunk_id long, len int")
    assert [r["chunk_id"] for r in within_budget(ranks, lengths, 95).orderBy("rank").collect()] == [1, 2]
    assert [r["chunk_id"] for r in within_budget(ranks, lengths, 10).collect()] == [1]


HELD = [
    # text, label, answer, keys, recoverable, distractors
    ("부문: 반도체, 매출: 200, 비중: 7%", "매출", "200", ["반도체"], True, 2),  # a number takes the comma behind it along: "200," is another than "200"
    ("부문: 반도체, 매출: 100\n부문: 전지, 매출: 200", "매출", "200", ["반도체"], False, None),
    ("전용 이용료 가온 > 법인: 연간 55,000원", "가온 > 법인", "연간 55,000원", ["전용", "이용료"], True, 0),
    ("매출 200 반도체 부문", "매출", "200", ["반도체"], False, 0),
    ("| 부문 | 매출 |\n| --- | --- |\n| 반도체 | 200 |", "매출", "200", ["반도체"], True, 0),
    ("| 부문 | 매출 |\n| --- | --- |\n| 반도체 | 300 |\n| 전지 | 200 |", "매출", "200", ["반도체"], False, None),
    ("| 반도체 | 200 |\n| 전지 | 300 |", "매출", "200", ["반도체"], False, 0),
    ("a (b): 1.5 \\E", "a (b)", "1.5", [], True, 0),
    ("a\\Eb: 1", "a\\Eb", "1", [], True, 0),
    ("", "a", "1", [], False, None),
]


def test_recoverable_and_distractors(spark):
    df = spark.createDataFrame(HELD, "text string, label string, answer string, keys array<string>, want boolean, n int")
    for r in df.select("*", recoverable().alias("got"), distractors().alias("d")).collect():
        assert (r["got"], r["d"]) == (r["want"], r["n"]), r


def test_score_and_contexts(spark):
    asked = spark.createDataFrame([(1, "q one", ["k"], "a", "10", 20), (2, "q two", ["z"], "a", "77", 10)], "query_id long, q string, keys array<string>, label string, answer string, row_chars int")
    chunks = spark.createDataFrame([("c1", 0, "nothing here", ""), ("c2", 1, "k a: 10, b: 3", "shown"), ("c3", 2, "k a: 10", "")], "chunk_id string, chunk_no int, text string, context string")

    class Fixed(CharTfidf):
        def rank(self, queries, chunks, top=None):
            return queries.select("query_id").crossJoin(spark.createDataFrame([("c1", 1), ("c2", 2), ("c3", 3)], "chunk_id string, rank int"))

    s = score(asked, chunks, Fixed(), budgets=(20, 100)).first()
    assert (s["row_destruction"], s["r_1"], s["r_5"], s["mrr"], s["rec_20"], s["rec_100"], s["distractors"], s["n_chunks"]) == (0.5, 0.0, 0.5, 0.25, 0.0, 0.5, 2.0, 3)
    assert s["density"] == 0.0
    shown = {r["query_id"]: r["context"] for r in contexts(Fixed().rank(asked, chunks), chunks, 17).collect()}
    assert shown == {1: "nothing here\n\nshown", 2: "nothing here\n\nshown"}


def test_extraction_by_backend(spark):
    html = "<h1>요금</h1><table><tr><th>상품<th>가격<tr><td>가<td>1,000원<tr><td>나<td>2,000원<tr><td>다<td>3,000원</table>"
    pages = spark.createDataFrame([(1, html)], "doc_id long, html string")
    wrong = lambda p: p.withColumn("reply", F.lit("연간 3,300원"))
    got = {name: {r["strategy"]: r["accuracy"] for r in extraction_accuracy(pages, ask).collect()} for name, ask in (("gold", "gold"), ("wrong", wrong), ("shown", "shown"))}
    assert set(got["gold"].values()) == {1.0} and set(got["wrong"].values()) == {0.0} and got["shown"]["stc"] == 1.0


def test_crawl_and_sinks(spark, tmp_path):
    asked = []

    def fetch(url):
        asked.append(url)
        if url == "b":
            raise OSError("gone")
        return url.encode()

    assert crawl(["a", "b", "c", "d"], fetch, most=3, wait=0) == [("a", b"a"), ("c", b"c")] and asked == ["a", "b", "c"]
    pages = spark.createDataFrame([(7, "<p>x</p>")], "doc_id long, html string")
    write_pages(pages, str(tmp_path / "p"))
    write_json(pages, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == pages.collect() and spark.read.json(str(tmp_path / "j")).select("doc_id", "html").collect() == pages.collect()
