"""Golden tables: grids, header depth, labels, units, chunks."""

import pytest

from gridloom.operators.chunk import chunks_by_strategy, table_aware
from gridloom.operators.extract import HTML_SPANS, document, extract
from gridloom.operators.grid import row_kv, tables, units
from gridloom.operators.invariants import conservation, invariants
from gridloom.sources.htmltree import parse_tree, serialize

NOTE = "※ 요금제 선택을 변경하려면 해지 후 다시 가입하여야 하며 이 경우 기존에 제공된 혜택은 모두 소멸되고 위약금이 부과될 수 있으니 유의하시기 바랍니다."
CROSSTAB = (
    "<table><tr><td rowspan=2 colspan=2>구 분<td colspan=2>가온클라우드<td colspan=2>한빛호스팅</tr><tr><td>개인<td>법인<td>개인<td>법인</tr>"
    "<tr><td rowspan=2>표준<td>이용료<td>연간 3,300원<td>연간 88,000원<td>연간 3,300원<td>연간 92,400원</tr><tr><td>이용범위<td colspan=2>전 제휴<td colspan=2>전 기관</tr>"
    "<tr><td rowspan=2>전용<td>이용료<td>-<td>연간 55,000원<td>-<td>연간 3,300원</tr><tr><td>이용범위<td colspan=2>전 계열사<td colspan=2>전 은행</tr></table>"
)
#: Golden tables, of which the expected grids, labels and lines below are known.
PAGES = {
    "rowspan": "<table><tr><th>부문<th>매출<tr><td rowspan=3>반도체<td>100<tr><td>200<tr><td>300</table>",
    "colspan": "<table><tr><th>구분<th>상반기<th>하반기<tr><td>비고<td colspan=2>해당없음</table>",
    "multi": "<table><tr><th rowspan=2>부문<th colspan=2>2024년<th rowspan=2>증감<tr><th>상반기<th>하반기<tr><td>메모리<td>10<td>20<td>5</table>",
    "block": "<table><tr><th>A<th>B<th>C<tr><td rowspan=2 colspan=2>덩어리<td>x1<tr><td>x2</table>",
    "overflow": "<table><tr><th>A<th>B<th>C<tr><td>1<td>2<td colspan=7>3</table>",
    "odd": "<table><tr><th>A<th>B<tr><td rowspan=0>1<td rowspan=abc>2<tr><td colspan=-3>3<td>4</table>",
    "crosstab": CROSSTAB,
    "year": "<table><tr><td>부처<td>2024년<td>2025년<tr><td>가<td>10<td>20<tr><td>나<td>30<td>40</table>",
    "banner": "<table><tr><td colspan=3>표 제목 배너<tr><td>구분<td>개인<td>법인<tr><td>요금<td>3,300원<td>88,000원</table>",
    "prose": f"<table><tr><th>구분<th>개인<th>법인<tr><td>요금<td>3,300원<td>88,000원<tr><td colspan=3>{NOTE}</table>",
    "pairs": "<table><tr><td>신청방법<td>영업점 방문 또는 비대면<tr><td>수수료<td>1,700원</table>",
    "empty": "<table><tr><th>기관<th>회신<tr><td>금융위원회<td><tr><td>한국은행<td>가능</table>",
    "comment": "<p>본문<!-- 비밀 메모 --> 계속</p>",
    "layout": "<table><tr><td>2026년 10월 01일</table><table><tr><th>가<th>나<tr><td>1<td>2</table>",
    "titled": "<html><head><title>문서 제목</title></head><body><table><tr><th>가<th>나<tr><td>1<td>2</table></body></html>",
    "broken": "<p>앞<table><tr><td>가<td rowspan=0>나<tr><td>다<td><table><tr><td>안쪽1<td>안쪽2</table><tr><td colspan=9>라</table>",
    "codes": "<table><tr><th>코드<th>이름<th>종류<th>금리<tr><td>A0001<td>가<td>예금<td>1.827%<tr><td>A0002<td>나<td>적금<td>2.110%</table>",
    "stairs": "<table><tr><th>대분류<th>중분류<th>세부<th>예산<tr><td rowspan=4>첨단소재<td rowspan=2>반도체<td>메모리<td>3,890<tr><td>화합물<td>2,140<tr><td rowspan=2>이차전지<td>전고체<td>2,780<tr><td>리튬메탈<td>1,120"
    "<tr><td rowspan=2>바이오<td rowspan=2>첨단바이오<td>유전자<td>2,010<tr><td>파운드리<td>1,340</table>",
    "subtotal": "<table><tr><th>부문<th>제품<th>매출<th>이익<tr><td rowspan=2>반도체<td>메모리<td>100<td>10<tr><td>파운드리<td>200<td>20<tr><td colspan=2>소계<td>300<td>30</table>",
    "halves": "<table><tr><td rowspan=2 colspan=2>사업부문<td colspan=2>2025년<td colspan=2>2024년<tr><td>상반기<td>하반기<td>상반기<td>하반기<tr><td rowspan=2>CMA<td>수익<td>8,368<td>2,381<td>4,717<td>2,389<tr><td>비중<td>30.4%<td>24.9%<td>10.4%<td>11.1%</table>",
    "fake": "<table><tr><td rowspan=2 colspan=2>구분<td colspan=2>가온<tr><td>개인<td>법인<tr><td>표준<td>이용료<td>3,300원<td>88,000원</table>",
    "spacer": f"<table><tr><td><td>구분<td>개인<td>법인<td><tr><td><td>수수료<td>2,200원<td>44,000원<td><tr><td><td colspan=3>{NOTE}<td></table>",
    "list": "<table><tr><th>회사명<th>소재지<th>자산총액<th>당기순손익<tr><td>가온반도체<td>경기 화성<td>2,840,000<td>184,000</table>",
    "overlap": "<table><tr><td>a<td rowspan=2>b<td>c<tr><td colspan=3>d</table>",
    "blank": "",
    "null": None,
}
IDS = {name: k for k, name in enumerate(PAGES)}


@pytest.fixture(scope="module")
def e(spark):
    return extract(spark.createDataFrame([(IDS[n], h) for n, h in PAGES.items()], "doc_id long, html string")).persist()


@pytest.fixture(scope="module")
def t(e):
    return tables(e).persist()


@pytest.fixture(scope="module")
def by_doc(t):
    return {(r["doc_id"], r["table_id"]): r for r in t.collect()}


@pytest.fixture(scope="module")
def lines(t):
    out = {}
    for r in units(t).orderBy("doc_id", "table_id", "row", "unit_no").collect():
        out.setdefault(r["doc_id"], []).append(r["unit"])
    return out


@pytest.fixture(scope="module")
def kv(t):
    return {(r["doc_id"], r["row"]): r["kv"] for r in row_kv(t).collect()}


def test_grid(by_doc):
    g = by_doc[IDS["rowspan"], 0]["grid"]
    assert [(g[r][0]["text"], g[r][0]["o_r"], g[r][0]["o_c"]) for r in (1, 2, 3)] == [("반도체", 1, 0)] * 3
    g = by_doc[IDS["block"], 0]["grid"]
    assert {(c["text"], c["o_r"], c["o_c"]) for r in (1, 2) for c in g[r][:2]} == {("덩어리", 1, 0)}
    wide = by_doc[IDS["overflow"], 0]
    assert wide["n_cols"] == 9 and (wide["grid"][0][3]["o_r"], wide["grid"][0][3]["o_c"]) == (-1, -1)
    assert by_doc[IDS["odd"], 0]["n_cols"] == 2


def test_headers(by_doc):
    depth = {n: by_doc[IDS[n], 0]["n_header"] for n in ("rowspan", "multi", "crosstab", "year", "pairs")}
    assert depth == {"rowspan": 1, "multi": 2, "crosstab": 2, "year": 1, "pairs": 0}
    assert by_doc[IDS["multi"], 0]["labels"] == ["부문", "2024년 > 상반기", "2024년 > 하반기", "증감"]
    assert by_doc[IDS["crosstab"], 0]["labels"][2:] == ["가온클라우드 > 개인", "가온클라우드 > 법인", "한빛호스팅 > 개인", "한빛호스팅 > 법인"]
    assert all(x.startswith("표 제목 배너 > ") for x in by_doc[IDS["banner"], 0]["labels"])
    assert (by_doc[IDS["crosstab"], 0]["hc"], by_doc[IDS["crosstab"], 0]["is_crosstab"]) == (2, True)
    assert (by_doc[IDS["pairs"], 0]["hc"], by_doc[IDS["pairs"], 0]["is_crosstab"]) == (1, True)
    assert by_doc[IDS["codes"], 0]["hc"] == 3


def test_merged_keys(by_doc, kv, lines):
    text = lambda name: [[c["text"] for c in row] for row in by_doc[IDS[name], 0]["grid"]]
    assert text("stairs")[1:] == [["첨단소재", "반도체", "메모리", "3,890"], ["첨단소재", "반도체", "화합물", "2,140"], ["첨단소재", "이차전지", "전고체", "2,780"], ["첨단소재", "이차전지", "리튬메탈", "1,120"], ["바이오", "첨단바이오", "유전자", "2,010"], ["바이오", "첨단바이오", "파운드리", "1,340"]]
    assert kv[IDS["stairs"], 5] == "대분류: 바이오, 중분류: 첨단바이오, 세부: 파운드리, 예산: 1,340"
    assert text("subtotal")[-1] == ["소계", "소계", "300", "30"] and kv[IDS["subtotal"], 2] == "부문: 소계, 매출: 300, 이익: 30"
    assert by_doc[IDS["halves"], 0]["n_header"] == 2 and by_doc[IDS["halves"], 0]["labels"][2:] == ["2025년 > 상반기", "2025년 > 하반기", "2024년 > 상반기", "2024년 > 하반기"]
    assert "CMA 수익 2025년 > 상반기: 8,368" in lines[IDS["halves"]]
    assert by_doc[IDS["fake"], 0]["n_header"] == 2 and len(lines[IDS["list"]]) == 1
    assert "자산총액: 2,840,000" in lines[IDS["list"]][0] and "당기순손익: 184,000" in lines[IDS["list"]][0]


def test_overlap_goes_to_the_last_cell(by_doc, e, t):
    # b reaches down into the second row, whose cell begins at column 0 and is three wide
    grid = by_doc[IDS["overlap"], 0]["grid"]
    assert [c["text"] for c in grid[0]] == ["a", "b", "c"] and [c["text"] for c in grid[1]] == ["d", "d", "d"]
    assert {r["doc_id"]: (r["covered"], r["claimed"]) for r in conservation(e, t).collect()}[IDS["overlap"]] == (6, 7)


def test_spans_are_bounded_only_on_request():
    wide = "<table><tr><td colspan=1500 rowspan=3>x<td>y</table>"
    free, capped = document(1, wide), document(1, wide, HTML_SPANS)
    assert (free["tables"][0]["n_cols"], free["tables"][0]["n_rows"]) == (1501, 3) and capped["tables"][0]["n_cols"] == 1001


def test_lines(lines, kv):
    assert kv[IDS["rowspan"], 1] == "부문: 반도체, 매출: 200"
    assert kv[IDS["colspan"], 0] == "구분: 비고, 상반기: 해당없음"
    assert kv[IDS["block"], 0] == "A: 덩어리, C: x1"
    hit = [x for x in lines[IDS["crosstab"]] if "55,000" in x]
    assert hit == ["전용 이용료 가온클라우드 > 법인: 연간 55,000원"] and len(lines[IDS["crosstab"]]) == 12
    assert "수수료: 1,700원" in lines[IDS["pairs"]]
    assert any("금융위원회" in x for x in lines[IDS["empty"]])


def test_chunks(e, t):
    c = {}
    for r in table_aware(e, 400, t).orderBy("doc_id", "chunk_no").collect():
        c.setdefault(r["doc_id"], []).append(r)
    assert [(x["kind"], NOTE in x["text"]) for x in c[IDS["prose"]]] == [("table", False), ("text", True)]
    assert not any("비밀" in x["text"] for x in c[IDS["comment"]])
    assert [(x["kind"], NOTE in x["text"]) for x in c[IDS["spacer"]]] == [("table", False), ("text", True)]
    assert [x["kind"] for x in c[IDS["layout"]]] == ["text", "table"]
    assert "문서 제목" in c[IDS["titled"]][0]["text"]
    assert any("안쪽1" in x["text"] for x in c[IDS["broken"]])
    assert IDS["blank"] not in c and IDS["null"] not in c


def test_split_keeps_rows(spark):
    rows = "".join(f"<tr><td>{k * 100}</td><td>{k * 7}%</td></tr>" for k in range(1, 40))
    html = f'<table><caption>긴 표</caption><tr><th>부문</th><th>매출</th><th>비중</th></tr><tr><td rowspan="40">반도체</td><td>0</td><td>0%</td></tr>{rows}</table>'
    found = table_aware(extract(spark.createDataFrame([(1, html)], "doc_id long, html string")), 400).collect()
    body = [x for r in found for x in r["text"].split("\n")[2:]]
    assert len(found) >= 3 and len(body) == 40 and all(x.startswith("부문: 반도체, 매출: ") for x in body)
    assert all(len(r["text"]) <= 400 and not r["oversize"] for r in found)


def test_invariants(e, t):
    got = {r["doc_id"]: r for r in invariants(e, t, table_aware(e, 400, t)).collect()}
    assert len(got) == len(PAGES)
    assert all(r["rectangular"] and r["row_atomic"] for r in got.values())
    assert [i for i, r in got.items() if not r["cell_conservation"]] == [IDS["overlap"]]
    assert got[IDS["broken"]]["text_coverage"] == 1.0


def test_strategies_lose_rows(e):
    found = chunks_by_strategy(e, 400).filter(f"doc_id = {IDS['crosstab']}").collect()
    assert {r["strategy"] for r in found} == {"flat", "markdown", "stc"}


def test_tree_round_trip():
    html = "<table><tbody><tr><td>a</td><td>b &amp; c</td></tr></tbody></table>"
    assert serialize(parse_tree(html)) == html
    assert serialize(parse_tree("<table>stray<tr><td>x")) == "stray<table><tbody><tr><td>x</td></tr></tbody></table>"
    assert serialize(parse_tree("<table><tr><table><tr><td>x")).count("<table>") == 2
