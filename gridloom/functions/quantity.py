"""Korean quantities to numbers, and equality of values. The folds are column expressions; only NFKC needs Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import literal, nfkc

#: Numerals by kind, and signs.
LARGE = {"조": 1e12, "억": 1e8, "만": 1e4}
SMALL = {"천": 1e3, "백": 1e2, "십": 1e1}
SIGNS = "-−△▲"
TOKEN = r"(\d+(?:\.\d+)?|[조억만천백십])"


def number_sql(s: str) -> str:
    """The quantity that NFKC text ``s`` names, or NULL. A bare number overwrites the one before it: the last one counts."""
    t = f"trim({s})"
    body = f"regexp_replace(regexp_replace({t}, {literal('^[' + SIGNS + ']+')}, ''), ',', '')"
    tokens = f"regexp_extract_all({body}, {literal(TOKEN)}, 1)"
    large = "CASE t " + " ".join(f"WHEN '{k}' THEN {v:.0f}D" for k, v in LARGE.items()) + " END"
    small = "CASE t " + " ".join(f"WHEN '{k}' THEN {v:.0f}D" for k, v in SMALL.items()) + " END"
    null = "cast(NULL AS double)"

    def state(total: str, group: str, current: str) -> str:
        return f"named_struct('total', {total}, 'grp', {group}, 'cur', {current})"

    at_large = state(f"a.total + (a.grp + coalesce(a.cur, if(a.grp = 0D, 1D, 0D))) * {large}", "0D", null)
    at_small = state("a.total", f"a.grp + coalesce(a.cur, 1D) * {small}", null)
    step = f"(a, t) -> CASE WHEN {large} IS NOT NULL THEN {at_large} WHEN {small} IS NOT NULL THEN {at_small} ELSE {state('a.total', 'a.grp', 'try_cast(t AS double)')} END"
    fold = f"aggregate({tokens}, {state('0D', '0D', null)}, {step}, a -> a.total + a.grp + coalesce(a.cur, 0D))"
    digits = f"{body} rlike {literal(chr(92) + 'd')}"
    numerals = f"{body} rlike {literal('(?U)^[조억만천백십' + chr(92) + 's]+$')}"
    return f"CASE WHEN size({tokens}) > 0 AND ({digits} OR {numerals}) THEN if({t} rlike {literal('^[' + SIGNS + ']')}, -1D, 1D) * {fold} END"


def with_number(df: DataFrame, column: str, out: str = "number") -> DataFrame:
    """Add the quantity of a text column; NULL where it names none."""
    return df.withColumn("_nfkc", nfkc(F.col(column))).withColumn(out, F.expr(number_sql("_nfkc"))).drop("_nfkc")


def with_same_value(df: DataFrame, a: str, b: str, out: str = "same") -> DataFrame:
    """Whether two texts name one value: numbers to within 1e-9, else equal and non-empty without white space."""
    df = df.withColumns({"_a": nfkc(F.col(a)), "_b": nfkc(F.col(b))})
    df = df.withColumns({"_x": F.expr(number_sql("_a")), "_y": F.expr(number_sql("_b"))})
    bare = "regexp_replace({}, '(?U)\\\\s+', '')"
    text = F.expr(f"{bare.format('_a')} = {bare.format('_b')} AND {bare.format('_a')} <> ''")
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    return df.withColumn(out, F.coalesce(F.when(both, F.abs(F.col("_x") - F.col("_y")) < 1e-9).otherwise(text), F.lit(False))).drop("_a", "_b", "_x", "_y")
