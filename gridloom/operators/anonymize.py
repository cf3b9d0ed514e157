"""Structure-preserving anonymization: every word becomes another of the same length and kinds of character."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import importable, small_batches
from ..sources.htmltree import parse_tree, serialize

#: Attributes with text, and with addresses.
TEXT_ATTRIBUTES = ("alt", "title", "placeholder", "aria-label", "summary", "value")
ADDRESS_ATTRIBUTES = ("href", "src", "action", "data-src")
SYLLABLES = "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후"
DIGITS = "0123456789"
#: Leading, middle and trailing jamo, and compatibility jamo.
JAMO = ((0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2), (0x3131, 0x318E))
#: Classes of characters with what replaces them, by the first that fits: full-width digits stay full-width, other scripts' digits become ASCII.
POOLS: tuple[tuple[re.Pattern, str], ...] = (
    (re.compile("[０-９]"), "０１２３４５６７８９"),
    (re.compile(r"\d"), DIGITS),
    (re.compile("[가-힣]"), SYLLABLES),
    (re.compile("[a-z]"), "abcdefghijklmnopqrstuvwxyz"),
    (re.compile("[A-Z]"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    *((re.compile(f"[{chr(lo)}-{chr(hi)}]"), "".join(map(chr, range(lo, hi + 1)))) for lo, hi in JAMO),
)


@lru_cache(1 << 16)
def pool(ch: str) -> str | None:
    """What a character may be replaced by; letters of other scripts without case by syllables."""
    known = next((p for kind, p in POOLS if kind.match(ch)), None)
    return known or (DIGITS if ch.isdigit() else SYLLABLES if unicodedata.category(ch) == "Lo" else None)


@lru_cache(1 << 17)
def masked_word(word: str, salt: bytes) -> str:
    """The same word always gives the same replacement, under one salt."""
    stream = hashlib.shake_128(salt + word.encode("utf-8", "surrogatepass")).digest(len(word))
    out = []
    for ch, k in zip(word, stream, strict=True):
        p = pool(ch)
        out.append(p[k % len(p)] if p else ch)
    return "".join(out)


def masked(text: str, salt: bytes) -> str:
    return re.sub(r"\S+", lambda m: masked_word(m[0], salt), text)


def masked_html(html: str, salt: bytes, keep: frozenset[str] = frozenset()) -> str:
    """The tree with its texts and attributes masked. Comments and what scripts and styles hold go; texts in ``keep`` stay."""
    root = parse_tree(html)

    def text(n) -> None:
        silent = n.parent is not None and n.parent.name in ("script", "style")
        n.text = "" if silent else n.text if n.text.strip() in keep else masked(n.text, salt)

    def element(n) -> None:
        if n.attrs:
            n.attrs.update({a: masked(n.attrs[a], salt) for a in TEXT_ATTRIBUTES if a in n.attrs} | {a: "#" for a in ADDRESS_ATTRIBUTES if a in n.attrs})
        if any(c.name == "#comment" for c in n.children):
            n.children = [c for c in n.children if c.name != "#comment"]

    for n in root.walk():  # a node's children are asked for after it
        (text if n.name == "#text" else element)(n)
    out = serialize(root)
    root.release()
    return out


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about so many bytes each; a longer text stands alone."""
    lo, size = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        size += n
        if size >= most:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def anonymize(pages: DataFrame, salt: bytes, keep: frozenset[str] = frozenset(), id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """doc_id, html of the twins. Texts in ``keep`` stay; a null document is an empty one."""
    importable(pages.sparkSession)
    small_batches(pages.sparkSession, mb=8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                made = pa.array([masked_html(h.as_py() or "", salt, keep) for h in b.column(1).slice(lo, hi - lo)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), made], ["doc_id", "html"])

    return pages.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(run, "doc_id long, html string")


def anonymize_text(texts: DataFrame, salt: bytes, column: str = "text") -> DataFrame:
    """Replace a text column by its masked form."""
    importable(texts.sparkSession)
    small_batches(texts.sparkSession, mb=8)

    @F.pandas_udf(StringType())
    def mask(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else masked(x, salt))

    return texts.withColumn(column, mask(F.col(column)))
