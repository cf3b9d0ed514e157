"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, its documents in a fixed order, are packed into blocks of ``block`` words. An output shard
has a number of slots; every slot draws its source by weight, which makes each shard's source counts a multinomial
draw. Running counts over the shards number the slots of a source. Slots that a source drew beyond its quota go, in order, to the sources that drew
fewer, so that each source's total is its target to within a block. The n-th slot of a
source maps to a block by a pseudorandom permutation of its block indices (swap-or-not rounds, another permutation for each pass over
the source), and slots and documents meet by block index. No pass is begun before the last is used up and no target is above
twice the source, so no document is taken more than twice.

Running sums never put a source into one task: documents fall into about sqrt(rows) buckets, sums run within a
(source, bucket) and then over the buckets. The sources are a table like others, of any length; what comes to the driver are four
numbers. A draw finds its source by an equal join on a cell of the line that the sources share out, not by a list of all sources.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import spark_of, stored, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK = 128
ROUNDS = 16
SEED = 20_011
#: Slots that a task permutes.
PART = 25_000
PRIME = 2_147_483_647


def mixed_hash(v: str, c: str) -> str:
    """SQL for a hash below PRIME of integers v < 2**45 and c < 2**31; the same text in both engines."""
    t = f"((({v}) * 48271 + ({c})) % {PRIME})"
    return f"(({t} * {t} % {PRIME} * 69621 + ({c})) % {PRIME})"


@dataclass
class Mix:
    """``docs``: doc_id, tie, source, sid, size, start (its first word's place in the source's stream); ``takes``: sid, block, times;
    ``sources``: source, sid, size, target, blocks, quota."""

    docs: DataFrame
    takes: DataFrame
    sources: DataFrame
    block: int


def targets(totals: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Of totals (source, size): sid (sources by code point, null last), weight, target, blocks, quota (of slots).

    Shares of share * all by weight, none above repeats * its size. In the order of repeats * size / weight the sources that a
    level would overfill come first: the first source that takes its share of what is left sets the level of all after it.
    """
    t = totals.withColumn("sid", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    t = t.withColumn("weight", F.expr(f"element_at(array({', '.join(map(str, weights))}), sid % {len(weights)} + 1)"))
    order = W.orderBy(F.lit(float(repeats)) * F.col("size") / F.col("weight"), "sid")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    all_ = F.sum("size").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    level = (F.lit(share) * all_ - F.coalesce(F.sum(F.lit(repeats) * F.col("size")).over(before), F.lit(0))) / F.sum("weight").over(after)
    t = t.withColumns({"level": level, "ord": F.row_number().over(order)})
    fits = F.when(F.col("level") * F.col("weight") <= F.lit(repeats) * F.col("size"), F.col("ord"))
    whole = W.orderBy("ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumns({"first": F.min(fits).over(whole), "at": F.min_by("level", fits).over(whole)})
    t = t.withColumn("target", F.when(F.col("ord") < F.col("first"), (F.lit(repeats) * F.col("size")).cast("double")).otherwise(F.col("at") * F.col("weight")))
    blocks = F.ceil(F.col("size") / F.lit(float(block))).cast("long")
    t = t.withColumn("blocks", blocks)
    quota = F.when(F.col("size") == 0, 0).otherwise(F.least(F.lit(repeats) * F.col("blocks"), F.floor(F.col("blocks") * F.col("target") / F.col("size") + 0.5)))
    return t.select("source", "sid", "size", "target", "blocks", quota.cast("long").alias("quota"))


def on_line(points: DataFrame, at: Column, parts: DataFrame, total: int, n: int) -> DataFrame:
    """Join points to the part [lo, hi) of the line from 0 to ``total`` that each falls into, over about four cells a part."""
    cells = max(1, min(4 * n, total))
    cell = lambda c: F.floor(c * cells / F.lit(total)).cast("long")
    spread = parts.filter("lo < hi").withColumn("_cell", F.explode(F.sequence(cell(F.col("lo")) - 1, cell(F.col("hi") - 1) + 1)))
    return points.withColumn("_at", at).withColumn("_cell", cell(F.col("_at"))).join(spread, "_cell").filter((F.col("_at") >= F.col("lo")) & (F.col("_at") < F.col("hi"))).drop("_at", "_cell", "lo", "hi")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, tie, source, size in words; tie tells rows of one id apart."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(f"`{source_col}`").cast("string").alias("source"), F.size(words_of(text)).cast("long").alias("size"))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, **names: str) -> Mix | None:
    """Plan the mix over all rows. None for an empty table. Null ids, texts and sources are rows like others; a text
    without words is never taken. Reruns agree, as nothing but ids, texts and the seed decides."""
    base = stored(sized(docs, **names), "mix-sizes")
    sources = stored(targets(base.groupBy("source").agg(F.sum("size").alias("size")), block, weights, share, repeats), "mix-sources")
    n_rows, n_sources, slots = base.count(), *sources.agg(F.count("*"), F.sum("quota")).first()
    if not n_rows:
        return None
    buckets = math.isqrt(n_rows)
    named = base.join(sources.select(F.col("source").alias("s"), "sid"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    named = named.withColumn("bucket", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(buckets)))
    sums = named.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = sums.select("sid", "bucket", (F.sum("n").over(W.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("doc_id", "tie").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = named.withColumn("within", within).join(before, ["sid", "bucket"]).withColumn("start", F.col("before") + F.col("within")).drop("before", "within", "bucket")
    return Mix(placed, takes(sources, n_sources, slots, seed), sources, block)


def takes(sources: DataFrame, n_sources: int, slots: int, seed: int) -> DataFrame:
    """sid, block, times: what the filled slots of all shards take."""
    spark = spark_of(sources)
    per_shard = max(1024, math.isqrt(slots))
    upto = F.sum("quota").over(W.orderBy("sid"))
    ends = F.expr(f"cast(cast({PRIME} AS decimal(38, 0)) * upto div {max(1, slots)} AS bigint)")
    parts = sources.withColumn("upto", upto).withColumn("hi", ends).withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("sid")), F.lit(0))).select("sid", "lo", "hi")
    drawn = on_line(spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"id div {per_shard}").alias("shard")), F.expr(mixed_hash("slot", str(seed))), parts, PRIME, n_sources)
    counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("n"))
    running = stored(counts.withColumn("before", F.sum("n").over(W.partitionBy("sid").orderBy("shard")) - F.col("n")), "mix-counts")
    known = sources.join(running.groupBy("sid").agg(F.sum("n").alias("had")), "sid", "left").select("sid", "blocks", "quota", F.coalesce("had", F.lit(0)).alias("had"))
    known = known.withColumn("lack", F.greatest(F.lit(0), F.col("quota") - F.col("had"))).withColumn("hi", F.sum("lack").over(W.orderBy("sid"))).withColumn("lo", F.col("hi") - F.col("lack"))
    known = stored(known, "mix-quotas")
    lacking = known.agg(F.sum("lack")).first()[0] or 0
    over = running.join(known.select("sid", "quota"), "sid").withColumn("over", F.col("n") - F.least(F.col("n"), F.greatest(F.lit(0), F.col("quota") - F.col("before"))))
    extra = over.groupBy("shard").agg(F.sum("over").alias("over"))
    # shards are about as many as slots in one, so that this running sum over all shards is one shard's work
    extra = extra.withColumn("over_before", F.sum("over").over(W.orderBy("shard")) - F.col("over")).drop("over")
    numbered = drawn.withColumn("nth", F.row_number().over(W.partitionBy("shard", "sid").orderBy("slot")) - 1)
    numbered = numbered.join(running.select("shard", "sid", "before"), ["shard", "sid"]).withColumn("j", F.col("before") + F.col("nth")).join(known.select("sid", "quota"), "sid")
    kept = numbered.filter("j < quota").select("sid", "j")
    moved = numbered.filter("j >= quota").withColumn("g", F.row_number().over(W.partitionBy("shard").orderBy("slot")) - 1).join(extra, "shard").select((F.col("g") + F.col("over_before")).alias("g"))
    moved = on_line(moved, F.col("g"), known.select("sid", "had", "lo", "hi", F.col("lo").alias("from")), max(1, lacking), n_sources)
    moved = moved.select("sid", (F.col("had") + F.col("g") - F.col("from")).alias("j"))
    slots_of = kept.unionByName(moved).join(known.select("sid", F.col("blocks").alias("n")), "sid").select("sid", "n", F.expr("j div n").alias("pass"), F.expr("j % n").alias("x"))
    # what follows costs time, not bytes: parts of equal numbers, which adaptive execution leaves as they are
    slots_of = slots_of.repartition(max(1, -(-slots // PART)))
    return slots_of.select("sid", F.expr(permuted("x", seed)).alias("block")).groupBy("sid", "block").agg(F.count("*").alias("times"))


def round_key(k: str, seed: int) -> str:
    return f"({mixed_hash(f'sid * 1000003 + pass * 7919 + {k} * 104729', str(seed + 1))} % n)"


def permuted(x: str, seed: int) -> str:
    """Swap-or-not: in each round x meets its partner key - x (mod n), and one bit, the same for both, says whether they swap."""
    partner = f"pmod({round_key('k', seed)} - x, n)"
    bit = f"({mixed_hash(f'greatest(x, {partner}) * 64 + k', str(seed + 2))} div 65536) % 2"
    return f"aggregate(sequence(1, {ROUNDS}), {x}, (x, k) -> if({bit} = 1, {partner}, x))"


def pieces(m: Mix) -> DataFrame:
    """A row for each document and block that it has words in: doc_id, tie, sid, start, size, offset (in the document), words, times."""
    b = m.block
    cut = m.docs.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
    cut = cut.withColumns({"offset": F.expr(f"greatest(0, block * {b} - start)"), "words": F.expr(f"least(start + size, (block + 1) * {b}) - greatest(start, block * {b})")})
    return cut.join(m.takes, ["sid", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    m = mix(docs, **options)
    if m is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, size long, source_size long, target double, taken long")
    some = pieces(m).groupBy("doc_id", "sid", "start", "size").agg(F.sum(F.col("words") * F.col("times")).alias("taken")).drop("start")
    none = m.docs.filter("size = 0").select("doc_id", "sid", "size", F.lit(0).cast("long").alias("taken"))
    sources = m.sources.select("sid", F.col("size").alias("source_size"), "target")
    return some.unionByName(none).join(sources, "sid").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, columns as in docs: for each pass, the words of a document that the pass takes, in order.

    A document that a pass takes whole keeps its text as it is; of one taken in part the taken words are joined by a
    space. A document that no slot took is left out, one taken twice comes twice. Null ids, texts and sources are values like
    others; each of several equal rows is a document of its own; columns beginning with an underscore must not be there.
    """
    m = mix(docs, **options)
    if m is None:
        return docs
    key = ["doc_id", "tie", "source"]
    of = pieces(m).filter("times > 0").groupBy(*key, "start", "size").agg(F.sort_array(F.collect_list(F.struct("offset", "words", "times"))).alias("_pieces"))
    wide = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_tie": F.xxhash64(F.col("text").cast("string")), "_from": F.col("source").cast("string")})

    def same(x: DataFrame, y: DataFrame, how: str, *more: Column) -> DataFrame:
        y = y.withColumnsRenamed({"doc_id": "_id2", "tie": "_tie2", "source": "_from2", "size": "_size"})
        on = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_tie") == F.col("_tie2")) & F.col("_from").eqNullSafe(F.col("_from2"))
        for c in more:
            on = on & c
        return x.join(y, on, how)

    # rows that are equal in id, text and source stand at different places of the stream: the n-th takes the n-th place
    again = stored(m.docs.filter("size > 0").groupBy(*key).count().filter("count > 1").select(*key), "mix-again")
    if again.isEmpty():
        joined = same(wide, of, "inner")
    else:
        nth = lambda by, order: F.row_number().over(W.partitionBy(*by).orderBy(*order))
        places = same(m.docs.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("source").alias("_from"), "start"), again, "left_semi")
        places = places.withColumn("_place", nth(["_id", "_tie", "_from"], ["start"])).select(F.col("_id").alias("doc_id"), F.col("_tie").alias("tie"), F.col("_from").alias("source"), F.col("start").alias("_start"), "_place")
        numbered = same(wide, again, "left_semi").withColumn("_nth", nth(["_id", "_tie", "_from"], ["_id"]))
        located = same(numbered, places, "inner", F.col("_nth") == F.col("_place")).drop("_id2", "_tie2", "_from2")
        columns = [*wide.columns, "_size", "_pieces"]
        joined = same(wide, again, "left_anti").transform(lambda x: same(x, of, "inner")).select(*columns)
        joined = joined.unionByName(same(located, of, "inner", F.col("_start") == F.col("start")).select(*columns))
    each = joined.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.lit(options.get("repeats", REPEATS)))))
    each = each.withColumn("_own", F.filter("_pieces", lambda p: p["times"] >= F.col("_pass"))).filter(F.size("_own") > 0)
    each = each.withColumns({"_n": F.aggregate("_own", F.lit(0).cast("long"), lambda s, p: s + p["words"]), "_words": words_of(F.col("text"))})
    part = F.array_join(F.flatten(F.transform("_own", lambda p: F.slice("_words", (p["offset"] + 1).cast("int"), p["words"].cast("int")))), " ")
    each = each.withColumn("text", F.when(F.col("_n") == F.col("_size"), F.col("text")).otherwise(part))
    return each.select(*docs.columns)


def oracle_sql(block: int = BLOCK, seed: int = SEED) -> str:
    """The same mix over ``documents`` in DuckDB SQL."""
    rounds = []
    for k in range(1, ROUNDS + 1):
        partner = f"((({round_key(str(k), seed)} - x) % n + n) % n)"
        bit = f"({mixed_hash(f'greatest(x, q) * 64 + {k}', str(seed + 2))} // 65536) % 2"
        rounds.append(f"y{k} AS MATERIALIZED (SELECT *, {partner} AS q FROM x{k - 1})")
        rounds.append(f"x{k} AS MATERIALIZED (SELECT sid, pass, n, CASE WHEN {bit} = 1 THEN q ELSE x END AS x FROM y{k})")
    draw = mixed_hash("id", str(seed))
    return f"""
WITH base AS MATERIALIZED (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))::BIGINT AS size FROM documents),
tot AS (SELECT source, sum(size)::BIGINT AS s FROM base GROUP BY source),
src AS (SELECT source, s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM tot),
wt AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
fill AS (
  SELECT *, ({SHARE} * sum(s) OVER () - coalesce(sum({REPEATS} * s) OVER (ORDER BY {REPEATS}.0 * s / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY {REPEATS}.0 * s / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam,
         row_number() OVER (ORDER BY {REPEATS}.0 * s / w, sid) AS ord FROM wt),
lev AS (SELECT min(ord) AS m, min_by(lam, ord) AS lam FROM fill WHERE lam * w <= {REPEATS} * s),
tgt AS (SELECT f.*, CASE WHEN f.ord < lev.m THEN ({REPEATS} * s)::DOUBLE ELSE lev.lam * w END AS target FROM fill f, lev),
q AS MATERIALIZED (
  SELECT *, ceil(s / {block}.0)::BIGINT AS n, CASE WHEN s = 0 THEN 0 ELSE least({REPEATS} * ceil(s / {block}.0), floor(ceil(s / {block}.0) * target / s + 0.5))::BIGINT END AS quota FROM tgt),
e AS (SELECT *, ({PRIME} * (sum(quota) OVER (ORDER BY sid))::HUGEINT // greatest(1, sum(quota) OVER ())::HUGEINT)::BIGINT AS fin FROM q),
num AS (SELECT sum(quota)::BIGINT AS slots FROM q),
dr AS MATERIALIZED (SELECT id, (SELECT count(*) FROM e WHERE e.fin <= {draw}) AS sid FROM num, range(num.slots) r(id)),
jj AS MATERIALIZED (SELECT id, sid, row_number() OVER (PARTITION BY sid ORDER BY id) - 1 AS j FROM dr),
had AS (SELECT sid, count(*) AS h FROM dr GROUP BY sid),
lack AS (SELECT q.sid, coalesce(h, 0) AS h, greatest(0, quota - coalesce(h, 0)) AS lk FROM q LEFT JOIN had USING (sid)),
lk2 AS (SELECT *, sum(lk) OVER (ORDER BY sid) AS hi, sum(lk) OVER (ORDER BY sid) - lk AS lo FROM lack),
kept AS (SELECT jj.sid, j FROM jj JOIN q USING (sid) WHERE j < quota),
mv AS (SELECT row_number() OVER (ORDER BY id) - 1 AS g FROM jj JOIN q USING (sid) WHERE j >= quota),
sl AS (SELECT * FROM kept UNION ALL SELECT lk2.sid, h + g - lo FROM mv JOIN lk2 ON g >= lo AND g < hi),
x0 AS MATERIALIZED (SELECT sl.sid, (j // n)::BIGINT AS pass, n, (j % n)::BIGINT AS x FROM sl JOIN q USING (sid)),
{", ".join(rounds)},
tk AS (SELECT sid, x AS block, count(*) AS times FROM x{ROUNDS} GROUP BY ALL),
cnt AS (SELECT greatest(1, floor(sqrt(count(*)))::BIGINT) AS b FROM base),
pl AS (SELECT base.doc_id, base.size, q.sid, q.s, q.target, sum(size) OVER (PARTITION BY q.sid ORDER BY coalesce(doc_id, 0) % cnt.b, doc_id) - size AS a
       FROM base JOIN q ON base.source IS NOT DISTINCT FROM q.source, cnt),
pc AS (SELECT *, unnest(CASE WHEN size > 0 THEN range((a // {block})::BIGINT, ((a + size - 1) // {block} + 1)::BIGINT) ELSE [-1] END) AS block FROM pl)
SELECT doc_id, size, s AS source_size, target::DOUBLE AS target,
       sum(coalesce(times, 0) * CASE WHEN size = 0 THEN 0 ELSE least(a + size, (pc.block + 1) * {block}) - greatest(a, pc.block * {block}) END)::BIGINT AS taken
FROM pc LEFT JOIN tk ON tk.sid = pc.sid AND tk.block = pc.block GROUP BY doc_id, size, s, target, a, pc.sid
"""
