"""Synthetic documents with tables: annual reports in closed form, and seven kinds of table with their usual damage."""

from __future__ import annotations

import random
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import literal
from ..session import importable

#: Names in the closed-form reports.
SEGMENTS = ("메모리", "파운드리", "시스템LSI", "OLED", "LCD", "생활가전", "영상디스플레이", "네트워크")
COMPANIES = ("가온전자", "한빛소재", "대명화학", "서진테크", "누리정밀", "명진산업", "태성에너지", "율촌바이오", "동방물산", "선진기전", "다산반도체", "해성정공")
#: Weights of the kinds of table, and shares of documents or tables with each damage.
KIND_WEIGHTS = {"crosstab": 3, "period": 3, "records": 3, "hierarchy": 2, "pairs": 2, "long": 1, "nested": 1}
DECOMPOSED, WIDE_ZERO, SPACERS, NOTE = 0.15, 0.15, 0.35, 0.35


def annual_reports(spark: SparkSession, n_docs: int = 12, groups: int = 20) -> DataFrame:
    """doc_id, html: a report a document, with a table of 3 * groups rows under a two-level header. All in expressions."""
    names = lambda v: "array(" + ", ".join(literal(x) for x in v) + ")"
    row = (
        "concat('<tr>', if(i % 3 = 0, concat('<td rowspan=\"3\">', element_at(segments, cast((i div 3) % size(segments) AS int) + 1), '</td>'), ''), "
        "'<td>', format_number(1000 + doc_id * 911 + i * 37, 0), '</td><td>', format_number(900 + doc_id * 733 + i * 23, 0), '</td><td>', (i * 7 + doc_id) % 40 - 10, '.', (i + doc_id) % 10, '%</td></tr>')"
    )
    d = spark.range(n_docs).withColumnRenamed("id", "doc_id")
    d = d.withColumns({"segments": F.expr(names(SEGMENTS)), "who": F.expr(f"element_at({names(COMPANIES)}, cast(doc_id % {len(COMPANIES)} AS int) + 1)"), "year": F.expr("2019 + doc_id % 6")})
    d = d.withColumn("rows", F.expr(f"array_join(transform(sequence(0, {groups * 3 - 1}), i -> {row}), '')"))
    html = (
        "concat('<h1>', who, ' ', year, ' 사업보고서</h1><h2>3. 재무 현황</h2><p>', who, '의 ', year, '년 실적은 전년 대비 개선되었습니다. 주력 사업의 수요 회복과 원가 절감이 동시에 작용했으며, 부문별 세부 내역은 아래 표와 같습니다. 일부 부문은 환율 영향으로 변동성이 확대되었습니다.</p>', "
        "'<table><caption>', who, ' ', year, ' 부문별 매출 (단위: 억원)</caption><tr><th rowspan=\"2\">사업부문</th><th colspan=\"2\">', year, '년</th><th rowspan=\"2\">증감률</th></tr><tr><th>상반기</th><th>하반기</th></tr>', rows, '</table><p>', who, '는 차년도에도 해당 기조를 유지할 계획입니다.</p>')"
    )
    return d.select("doc_id", F.expr(html).alias("html"))


class Maker:
    """One document's tables, from its own random numbers."""

    def __init__(self, seed: int, doc_id: int):
        self.r = random.Random(f"{seed}|{doc_id}")
        self.doc_id = doc_id

    def amount(self) -> str:
        return f"{self.r.randint(1, 900) * 100:,}원"

    def text(self, s: str) -> str:
        words = s.split(" ")
        if self.r.random() < DECOMPOSED:
            k = self.r.randrange(len(words))
            words[k] = unicodedata.normalize("NFD", words[k])
        s = " ".join(words)
        return s.replace("0", "０", 1) if self.r.random() < WIDE_ZERO else s

    def table(self, rows: list[list[tuple]], caption: str = "") -> str:
        """Rows of (text, rowspan, colspan[, th]) as an office program would write them."""
        edge = '<td width="4"><p class=MsoNormal><o:p>&nbsp;</o:p></p></td>' if self.r.random() < SPACERS else ""
        width = sum(c[2] for c in rows[0])
        if self.r.random() < NOTE:
            rows = [*rows, [("※ 위 표의 수치는 잠정치이며 처리 시점과 기관의 내부 기준에 따라 사후에 달라질 수 있으니 반드시 확인하시기 바랍니다. 문의는 담당 부서로 하십시오.", 1, width)]]
        out = []
        for row in rows:
            cells = []
            for text, down, across, *th in row:
                tag = "th" if th and th[0] else "td"
                spans = (f' rowspan="{down}"' if down > 1 else "") + (f' colspan="{across}"' if across > 1 else "")
                cells.append(f'<{tag}{spans} valign="middle"><p class="MsoNormal"><span>{self.text(text)}</span><o:p></o:p></p></{tag}>')
            out.append(f"<tr>{edge}{''.join(cells)}{edge}</tr>")
        return f'<table class="MsoNormalTable" border="1">{f"<caption>{caption}</caption>" if caption else ""}<tbody>{"".join(out)}</tbody></table>'

    def crosstab(self) -> str:
        th = self.r.random() < 0.2
        firms = self.r.sample(["가온클라우드", "한빛호스팅", "서진네트웍스"], 2)
        rows = [[("구 분", 2, 2, th), *((f, 1, 2, th) for f in firms)], [(x, 1, 1, th) for _ in firms for x in ("개인", "법인")]]
        for kind in ("표준", "전용"):
            fees = [("-" if self.r.random() < 0.25 else "연간 " + self.amount(), 1, 1) for _ in range(4)]
            rows.append([(kind, 2, 1), ("이용료", 1, 1), *fees])
            rows.append([("이용범위", 1, 1), *((self.r.choice(["전 제휴", "전 기관", "전 계열사"]), 1, 2) for _ in firms)])
        return self.table(rows)

    def period(self) -> str:
        years = (2025, 2024)
        rows = [[("구분", 2, 2), *((f"{y}년", 1, 2) for y in years)], [(h, 1, 1) for _ in years for h in ("상반기", "하반기")]]
        for s in self.r.sample(["CMA", "위탁", "자산관리", "기업금융", "운용"], self.r.randint(3, 5)):
            rows.append([(s, 2, 1), ("수익", 1, 1), *((f"{self.r.randint(100, 9999):,}", 1, 1) for _ in range(4))])
            rows.append([("비중", 1, 1), *((f"{self.r.randint(1, 60)}.{self.r.randint(0, 9)}%", 1, 1) for _ in range(4))])
        return self.table(rows, "부문별 수익")

    def records(self) -> str:
        rows = [[(h, 1, 1, True) for h in ("상품", "등급", "한도", "금리", "비고")]]
        for k in range(self.r.randint(4, 12)):
            rows.append([(f"상품 {chr(65 + k)}", 1, 1), (self.r.choice(["일반", "우대"]), 1, 1), (self.amount(), 1, 1), (f"{self.r.randint(1, 9)}.{self.r.randint(0, 99):02d}%", 1, 1), (self.r.choice(["", "신규", "갱신"]), 1, 1)])
        return self.table(rows, "상품 목록" if self.r.random() < 0.7 else "")

    def hierarchy(self) -> str:
        rows = [[("대분류", 1, 1), ("중분류", 1, 1), ("소분류", 1, 1), ("한도", 1, 2), ("비고", 1, 1)]]
        for top in ("개인", "기업"):
            for j, mid in enumerate(("담보", "신용")):
                for k, low in enumerate(("단기", "장기")):
                    lead = ([(top, 4, 1)] if not j and not k else []) + ([(mid, 2, 1)] if not k else [])
                    rows.append([*lead, (low, 1, 1), (self.amount(), 1, 2), ("", 1, 1)])
        return self.table(rows)

    def pairs(self) -> str:
        all_ = [("신청방법", "영업점 방문 또는 비대면 채널에서 본인 확인 뒤 신청서를 내면 된다"), ("수수료", self.amount()), ("처리기간", f"{self.r.randint(1, 9)}영업일"), ("담당", "고객지원 부서"), ("유효기간", f"{self.r.randint(1, 5)}년")]
        return self.table([[(a, 1, 1), (b, 1, 1)] for a, b in all_[: self.r.randint(3, 5)]])

    def long(self) -> str:
        rows = [[(h, 1, 1, True) for h in ("코드", "종목", "현재가", "등락률")]]
        rows += [[(f"A{k:04d}", 1, 1), (f"종목{k}", 1, 1), (f"{self.r.randint(1000, 90000):,}", 1, 1), (f"{self.r.randint(-30, 30)}.{self.r.randint(0, 9)}%", 1, 1)] for k in range(self.r.randint(55, 80))]
        return self.table(rows, "전 종목 시세")

    def nested(self) -> str:
        inner = f"<table><tr><td>안쪽1</td><td>{self.amount()}</td></tr><tr><td>안쪽2</td><td>{self.amount()}</td></tr></table>"
        return f"<table><tr><th>항목</th><th>세부</th><th>금액</th></tr><tr><td>기본</td><td>{inner}</td><td>{self.amount()}</td></tr><tr><td>추가</td><td>없음</td><td>{self.amount()}</td></tr></table>"

    def document(self) -> str:
        kinds = self.r.choices(list(KIND_WEIGHTS), list(KIND_WEIGHTS.values()), k=self.r.randint(1, 3))
        parts = [f"<h2>{k + 1}. 안내</h2><p>{self.text('아래 내용을 확인하시기 바랍니다.')}</p>" + getattr(self, kind)() for k, kind in enumerate(kinds)]
        return f"<html><head><title>업무 안내 {self.doc_id}</title></head><body><h1>업무 안내 {self.doc_id}호</h1>{''.join(parts)}</body></html>"


def table_zoo(spark: SparkSession, n_docs: int, seed: int = 0) -> DataFrame:
    """doc_id, html of documents with one to three tables of mixed kinds. Each depends on seed and id only."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([Maker(seed, i).document() for i in b.column(0).to_pylist()], pa.string())], ["doc_id", "html"])

    return spark.range(n_docs).withColumnRenamed("id", "doc_id").mapInArrow(run, "doc_id long, html string")
