"""Document fingerprints by winnowing.

Every run of K code points has a rolling hash; of each W consecutive hashes the smallest is chosen, the rightmost
of equal ones, with its position. Two texts that share any K + W - 1 code points in a row share at least one chosen
hash; no shared run shorter than K is ever reported. K and W are what winnow() takes when not told otherwise; the
fingerprints of documents are by GRAM and WINDOW, which leave a short text several chosen hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import importable
from .common import map_batches, small_batches, spark_of, texts

K = 24
W = 105
#: Of documents: any 15 code points in a row that two texts share are a hit; about two hashes in nine are kept.
GRAM = 8
WINDOW = 8
#: Chosen hashes carry 40 bits of hash and 24 of position; longer texts go segment by segment, positions modulo 2**24.
PLACE_BITS = 24
SEGMENT = 1 << 22
#: Hex digits of fingerprints after which the comparison hands a batch on; they take several times their text's room.
HANDED = 32 << 20
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k code points, by doubling: a run of a + b is that of a, shifted by b powers, and that of b."""
    power = [M1]
    level, span = points.astype(np.uint64) * M3 + M2, 1
    parts: list[tuple[np.ndarray, int]] = []
    while span <= k:
        if k & span:
            parts.append((level, span))
        if 2 * span <= k:
            level = level[: len(level) - span] * power[-1] + level[span:]
            power.append(power[-1] * power[-1])
        span *= 2
    n, out, at = len(points) - k + 1, None, 0
    for h, s in parts:
        h = h[at : at + n]
        out = h if out is None else out * M1 ** np.uint64(s) + h
        at += s
    return scramble(out)


def window_min(v: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (w - span)], v[w - span :]) if w > span else v


def winnow(text: str, k: int = K, w: int = W) -> np.ndarray:
    """Chosen entries in order of position, each hash << 24 | position. A text shorter than k is one gram; an empty one has none."""
    if not text:
        return np.empty(0, np.uint64)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = min(k, len(points))
    found = []
    with np.errstate(over="ignore"):
        n = len(points) - k + 1
        for base in range(0, n, SEGMENT):
            h = gram_hashes(points[base : base + SEGMENT + w - 1 + k - 1], k)
            place = np.arange(base, base + len(h), dtype=np.uint64) & mask
            v = (h & ~mask) | (mask - (place - np.uint64(base) & mask))  # within a segment the later of equal hashes is the smaller value
            low = window_min(v, min(w, len(v)))
            low = low[np.r_[True, low[1:] != low[:-1]]]
            found.append((low & ~mask) | ((mask - (low & mask)) + np.uint64(base) & mask))
    out = np.concatenate(found)
    return out[np.r_[True, out[1:] != out[:-1]]]


def as_string(entries: np.ndarray) -> str:
    """16 hex digits for each entry: 10 of the hash, 6 of the position."""
    return entries.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of the chosen hashes; two empty fingerprints are alike."""
    x, y = np.unique(a >> np.uint64(PLACE_BITS)), np.unique(b >> np.uint64(PLACE_BITS))
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint as array<struct<hash, pos>>, for every row; a null text has an empty one."""
    small_batches(spark_of(docs))
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())]))

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [winnow(t or "", GRAM, WINDOW) for t in b.column(1).to_pylist()]
            out = [[{"hash": int(x) >> PLACE_BITS, "pos": int(x) & 0xFFFFFF} for x in r] for r in rows]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "fingerprint"])

        return step

    return map_batches(texts(docs, id_col, text_col), make, "doc_id long, fingerprint array<struct<hash:long,pos:int>>")


def edited(text: str, following: str) -> str:
    """The last half of a text, replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def bucket_of(bounds: list[int]) -> F.Column:
    """How many bounds are at most doc_id: first in steps of about the root of their number, then one by one."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = ", ".join(f"{g[0]}L" for g in groups[1:]) or "9223372036854775807L"
    fine = ", ".join("array(" + ", ".join(f"{b}L" for b in g) + ")" for g in groups)
    at = f"size(filter(array({coarse}), b -> b <= doc_id))"
    return F.expr(f"CASE WHEN doc_id IS NULL THEN 0 ELSE {at} * {step} + size(filter(element_at(array({fine}), {at} + 1), b -> b <= doc_id)) END")


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Rows by descending doc_id within buckets of consecutive ids: bucket, edge, doc_id, text. After each bucket's
    rows stands its edge, the row that follows in the whole order (after the last: the first). Null ids come last; rows of one id go by text."""
    spark = spark_of(docs)
    rows = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)})
    rows = rows.withColumn("bucket", bucket_of(bounds))
    tops = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    follows = [(b, tops[order[i - 1]]) for i, b in enumerate(order)]  # i = 0: the last bucket of all holds the first row
    edge_ids = spark.createDataFrame(follows or [(0, None)], "edge_of int, edge_id long")
    edges = rows.join(F.broadcast(edge_ids), F.col("doc_id").eqNullSafe(F.col("edge_id"))).groupBy("edge_of", "doc_id").agg(F.min("text").alias("text"))
    both = rows.select("bucket", F.lit(False).alias("edge"), "doc_id", "text").unionByName(edges.select(F.col("edge_of").alias("bucket"), F.lit(True).alias("edge"), "doc_id", "text"))
    return both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket", "edge", F.desc_nulls_last("doc_id"), "text")


def edit_comparison(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    small_batches(spark_of(docs))
    importable(spark_of(docs))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        last = None  # bucket, doc_id, text, fingerprint of the row before
        for b in batches:
            out, size = [], 0
            for bucket, edge, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                print_ = winnow(text, GRAM, WINDOW)
                if last and last[0] == bucket:
                    _, own_id, own, own_print = last
                    new = edited(own, text)
                    new_print = winnow(new, GRAM, WINDOW)
                    out.append((own_id, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_string(own_print), as_string(new_print), likeness(own_print, new_print), likeness(own_print, print_)))
                    size += 16 * (len(own_print) + len(new_print))
                    if size >= HANDED:
                        yield handed()
                        out, size = [], 0
                last = None if edge else (bucket, doc_id, text, print_)
            if out:
                yield handed()

    return with_following(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
