"""Text functions as column expressions; only Unicode normalization needs Python."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import importable

#: White space and invisible characters that collapse to one space.
GAPS = r"[\s ​‌‍﻿]+"
_GAPS = re.compile(GAPS)
#: Fixed value, as a Java pattern: sentence ends by punctuation, or by a Korean final syllable and a period (which goes).
SENTENCE_END = r"(?U)(?<=[.!?。？！])\s+|(?<=[다요음임함])\.\s+"
#: Fixed values, as Java patterns: identifiers that only look like values.
CODE = r"(?U)^[A-Za-z]{1,3}[-_]?\d+$"
ENDS = r"(?U)^\s+|\s+$"
DASHED_NUMBER = r"(?U)^\d+(?:-\d+){2,}$"
NUMBER = r"(\d[\d,]*(?:\.\d+)?)"


def tidy(s: str) -> str:
    """NFKC first, then gaps to single spaces: full-width digits and decomposed syllables meet their usual forms."""
    return _GAPS.sub(" ", unicodedata.normalize("NFKC", s)).strip()


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def squeeze(c: Column) -> Column:
    """The white-space part of clean, without Python."""
    return F.trim(F.regexp_replace(c, "(?U)" + GAPS, " "))


def clean(c: Column) -> Column:
    return squeeze(nfkc(c))


def literal(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def has_digit_sql(x: str) -> str:
    return f"({x} rlike {literal('(?U)' + chr(92) + 'd')})"


def is_value_sql(x: str) -> str:
    """At least two digits that make up at least 30 % of the text, and not an identifier."""
    t = f"regexp_replace({x}, {literal(ENDS)}, '')"
    digits = f"length(regexp_replace({t}, {literal('(?U)[^' + chr(92) + 'd]')}, ''))"
    return f"(NOT {t} rlike {literal(CODE)} AND NOT {t} rlike {literal(DASHED_NUMBER)} AND {digits} >= 2 AND {digits} * 10 >= length({t}) * 3)"


def is_value(column: str) -> Column:
    return F.expr(is_value_sql(column))


def squeezed(column: str) -> str:
    """SQL of a text in lower case, each run of white space one space."""
    return rf"regexp_replace(lower({column}), {literal('(?U)' + chr(92) + 's+')}, ' ')"


def grams(column: str, n: int = 3) -> Column:
    """Character n-grams of the lower-cased, squeezed text; none where it is shorter than n."""
    t = squeezed(column)
    # split into characters once by the outer lambda: a place in a text is only found by a walk to it
    gram = ", ".join(f"get(cs, i + {k})" for k in range(n))
    return F.expr(f"transform(array(split({t}, '')), cs -> CASE WHEN size(cs) >= {n} THEN transform(sequence(0, size(cs) - {n}), i -> concat({gram})) ELSE cast(array() AS array<string>) END)[0]")


def trigram_codes(t: str | None) -> np.ndarray:
    """A text's trigrams in their order, each as three code points in one number."""
    p = np.frombuffer((t or "").encode("utf-32-le"), "<u4").astype(np.int64)
    return p[:-2] << 42 | p[1:-1] << 21 | p[2:]


def coded_frequencies(df: DataFrame, column: str) -> DataFrame:
    """(code, df): how many rows have each of grams()'s trigrams, as trigram_codes gives them. Tasks count without a row a gram."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

        for b in batches:
            for t in b.column(0):
                held.append(np.unique(trigram_codes(t.as_py())))
                size += len(held[-1])
                if size >= 1_000_000:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return df.select(F.expr(squeezed(column)).alias("t")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("df"))


def document_frequencies(df: DataFrame, column: str) -> DataFrame:
    """(gram, df): how many rows have each of grams()'s trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column(0).to_numpy(zero_copy_only=False)
            points = np.stack([code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF], axis=1).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes().decode("utf-32-le") for p in points], pa.string()), b.column(1)], ["gram", "df"])

    return coded_frequencies(df, column).mapInArrow(run, "gram string, df long")


def fixed_pieces(column: str, size: int) -> Column:
    """Pieces of ``size`` characters, the last one shorter; none of an empty text."""
    # one walk through the text; substring would walk to each piece
    return F.expr(f"coalesce(regexp_extract_all({column}, '(?s).{{1,{size}}}', 0), cast(array() AS array<string>))")


def packed_sql(x: str, size: int) -> str:
    """A text of at most ``size`` as it is; else its sentences, packed greedily up to ``size`` (a longer one stands alone)."""
    none = "cast(array() AS array<string>)"
    step = f"(a, s) -> CASE WHEN a.cur <> '' AND length(a.cur) + length(s) + 1 > {size} THEN named_struct('out', concat(a.out, array(a.cur)), 'cur', s) ELSE named_struct('out', a.out, 'cur', trim(concat(a.cur, ' ', s))) END"
    fold = f"aggregate(filter(split({x}, {literal(SENTENCE_END)}), s -> s <> ''), named_struct('out', {none}, 'cur', ''), {step}, a -> if(a.cur <> '', concat(a.out, array(a.cur)), a.out))"
    return f"CASE WHEN {x} = '' THEN {none} WHEN length({x}) <= {size} THEN array({x}) ELSE {fold} END"


def sentences(column: str) -> Column:
    return F.expr(f"filter(split({column}, {literal(SENTENCE_END)}), s -> s <> '')")


def numbers_sql(x: str) -> str:
    return f"regexp_extract_all({x}, {literal(NUMBER)}, 1)"


def lossy_utf8(content: Column) -> Column:
    """Bytes as text, with bad sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))
