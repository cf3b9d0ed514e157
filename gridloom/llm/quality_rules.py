"""Quality rules: a table of thresholds compiled into Spark projections, without user functions.

Every measure of a text is a column of one projection chain inside a single stage (nothing is shuffled), and every rule is a
row of RULES: a measure, a comparison, a share in percent and what the share is of. ``compile_rules`` turns the
table into the predicate that rejects a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK_CLASS, words_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is it that for on was with as be by this are at from "
    "le la les de des et en un une du que pour dans est sur "
    "der die das und den dem ein eine von mit zu auf ist im "
    "el los las y del por con para una se su no es"
).split()
#: (name, measure, comparison, percent, of): a document with enough words fails when measure * 100 <comparison> percent * of.
RULES = [
    ("short", "n_words", "<", 5000, "one"),
    ("repeated_windows", "n_repeat_words", ">", 50, "n_words"),
    ("short_words", "word_chars", "<", 200, "n_words"),
    ("long_words", "word_chars", ">", 2500, "n_words"),
    ("symbols", "n_symbols", ">", 25, "n_words"),
    ("repeated_lines", "n_dup_lines", ">", 40, "n_lines"),
    ("no_stop_words", "n_stop_words", "<", 200, "one"),
]
BASE = ("short", "repeated_windows")


def failed(names: tuple[str, ...] | None = None, rules: list[tuple] = RULES) -> Column:
    """The table's rules, or those named, as one predicate."""
    out = F.lit(False)
    for name, measure, comparison, percent, of in rules:
        if names is None or name in names:
            bound = F.lit(percent) * (F.lit(1) if of == "one" else F.col(of))
            left = F.col(measure) * 100
            out = out | (left < bound if comparison == "<" else left > bound)
    return out


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: its id (and columns ``keep``), then the measures. A null text has no words.

    n_repeat_words: words inside any 3-word window that is found twice or more in the text. Windows are sorted by a 64-bit hash with
    their places; those whose words equal a neighbour's repeat; a place covers itself and two more words, less what the next
    repeated place covers again. A window is 12 bytes, so that memory stays in proportion to the text. Repeated rows are judged
    each by itself, an empty table gives none.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, WORD_BREAK_CLASS, "") != "")
    kept = [F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(keep or [])]
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *kept, words_of(text).alias("_words"), lines.alias("_lines"), F.length(F.translate(text, " \t\n\x0b\f\r", "")).alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.col("word_chars").cast("long"),
            "n_symbols": F.col("n_symbols").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "_windows": F.expr("CASE WHEN size(_words) >= 3 THEN sort_array(transform(sequence(0, size(_words) - 3), i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) AS h, i AS i))) ELSE array() END"),
        }
    )
    alike = "coalesce(x.h = get(_windows, k {0}).h AND _words[x.i] = _words[get(_windows, k {0}).i] AND _words[x.i + 1] = _words[get(_windows, k {0}).i + 1] AND _words[x.i + 2] = _words[get(_windows, k {0}).i + 2], false)"
    out = out.withColumn("_places", F.expr(f"sort_array(transform(filter(_windows, (x, k) -> {alike.format('- 1')} OR {alike.format('+ 1')}), x -> x.i))"))
    covered = "aggregate(transform(_places, (x, k) -> least(3, coalesce(get(_places, k + 1) - x, 3))), 0, (s, x) -> s + x)"
    # the row number is never negative; it keeps the optimizer from moving a later filter below these projections, where
    # it would evaluate the window arrays again at every mention
    out = out.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, F.expr(covered)).cast("long"))
    return out.select("doc_id", *[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep or [])], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row; repeated rows are judged each by itself."""
    return measures(docs, id_col, text_col).withColumns({"base_failed": failed(BASE), "kept": ~failed()})


ORACLE_SQL = (
    r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls
  FROM documents),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, list_sum([0] || list_transform(ws, lambda x: length(x)))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         len(list_filter(ws, lambda x: list_contains(STOPS, lower(x))))::BIGINT AS n_stop_words
  FROM w LEFT JOIN r USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * word_chars < 200 * n_words OR 100 * word_chars > 2500 * n_words
            OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 40 * n_lines OR n_stop_words < 2) AS kept
FROM m
""".replace("STOPS", "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]")
)
