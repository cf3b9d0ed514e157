"""Files, bytes and listings to rows, and rows to files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import lossy_utf8
from ..session import importable, small_batches

#: Encodings tried in order; the last resort replaces what UTF-8 cannot read.
ENCODINGS = ("utf-8", "euc-kr", "cp949")
#: Patterns of receipt numbers in a listing, and of the viewer call of a filing.
RECEIPT, RECEIPT_FALLBACK = r"rcpNo=(\d{14})", r"openReportViewer\('(\d{14})'"
VIEWER_CALL = r'viewDoc\("(\d+)",\s*"(\d+)",\s*"([^"]*)",\s*"([^"]*)",\s*"([^"]*)",\s*"([^"]*)"'
VIEWER_URL = "https://dart.fss.or.kr/report/viewer.do?rcpNo=%s&dcmNo=%s&eleId=%s&offset=%s&length=%s&dtd=%s"


def numbered(files: DataFrame) -> DataFrame:
    return files.withColumn("doc_id", F.xxhash64("path"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """path, html, doc_id of whole files; a file that is not UTF-8 is an error."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("html"))
    return numbered(raw)


def read_html_lossy(spark: SparkSession, path: str) -> DataFrame:
    """path, html, doc_id of whole files; bad bytes are replaced."""
    return numbered(spark.read.format("binaryFile").load(path).select("path", lossy_utf8(F.col("content")).alias("html")))


def decoded(df: DataFrame, column: str = "content", out: str = "html") -> DataFrame:
    """Add the text of a binary column by the first encoding that reads it."""
    importable(df.sparkSession)
    small_batches(df.sparkSession, mb=8)

    def text(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for e in ENCODINGS:
            try:
                return bytes(raw).decode(e)
            except UnicodeDecodeError:
                pass
        return bytes(raw).decode("utf-8", "replace")

    @F.pandas_udf(StringType())
    def texts(s: pd.Series) -> pd.Series:
        return s.map(text)

    return df.withColumn(out, texts(F.col(column)))


def listed_receipts(df: DataFrame, column: str = "html", most: int = 30) -> DataFrame:
    """Add ``receipts``: distinct numbers in order of appearance, by the fallback pattern where the first finds none."""
    first, second = (F.regexp_extract_all(F.col(column), F.lit(p), F.lit(1)) for p in (RECEIPT, RECEIPT_FALLBACK))
    return df.withColumn("receipts", F.slice(F.array_distinct(F.when(F.size(first) > 0, first).otherwise(second)), 1, most))


def viewer_urls(df: DataFrame, column: str = "html") -> DataFrame:
    """Add ``url`` of the filing's body; NULL where the page has no viewer call."""
    parts = [F.regexp_extract(column, VIEWER_CALL, i) for i in range(1, 7)]
    return df.withColumn("url", F.when(F.col(column).rlike(VIEWER_CALL), F.format_string(VIEWER_URL, *parts)))


def crawl(urls: list[str], fetch, most: int = 30, wait: float = 1.0) -> list[tuple[str, bytes]]:
    """A polite driver-side loop over a few addresses: failures are skipped, at most ``most`` are asked for."""
    import time

    out = []
    for u in urls[:most]:
        try:
            out.append((u, fetch(u)))
        except OSError:
            continue
        time.sleep(wait)
    return out


def http_get(url: str, timeout: float = 30.0, headers: dict[str, str] | None = None) -> bytes:
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {"User-Agent": "Mozilla/5.0"}), timeout=timeout) as r:
        return r.read()


def write_pages(pages: DataFrame, path: str, parts: list[str] | None = None) -> None:
    """Parquet, the form that later reads prune best."""
    w = pages.write.mode("overwrite")
    (w.partitionBy(*parts) if parts else w).parquet(path)


def write_files(pages: DataFrame, path: str) -> None:
    """A text file a document, in a folder a name: name=doc0001.htm."""
    names = pages.select(F.format_string("doc%04d.htm", F.col("doc_id")).alias("name"), F.col("html").alias("value"))
    names.repartition("name").write.mode("overwrite").partitionBy("name").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
