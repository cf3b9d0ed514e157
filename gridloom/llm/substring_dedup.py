"""Removal of passages that stand in an earlier document, by suffix automata of reference shards.

1. Blocks of window hashes find, for each window of ``length`` words that several documents hold, an owner: the smallest
   document of the map task's block or of all. Owners and the buckets of documents that need them are what is kept.
2. The owners' repeated windows, joined to maximal spans, are the reference. A shard of it goes to each bucket of
   documents: the spans that some document of the bucket shares.
3. Each bucket builds the suffix automaton of its shard and streams its documents through it. The matching
   statistic at a word is the length of the longest match that ends there; where it reaches ``length`` and an owner of the window is a
   smaller document, the window's words go. Maximal spans fall out as unions of such windows.

The automaton compares words themselves, so that nothing is removed for equal hashes only. A window found in a third of
all documents is one reference span in each shard, whatever their number. The whole reference is not broadcast to
every document, as documents times shards would grow with the square of the input; each shard meets the documents that need it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import importable
from .common import small_batches, spark_of, stored, texts
from .incidence import FLUSH, WordHashes, bucket_of_doc, gather, pack, range_of, ranges
from .winnowing import gram_hashes

LENGTH = 13
#: Bytes of owners' places up to which they are broadcast to the scan of documents; beyond, a shuffled join.
BROADCAST_BYTES = 16 << 20
BREAK = b"\n"  # no word, so that it parts spans


class SuffixAutomaton:
    """Of several word sequences, each with an owner; ``least[v]`` is the smallest owner of any place of a state's words."""

    def __init__(self, length: int):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len, self.least = [-1], [0], [2**63 - 1]
        self.length = length

    def add(self, words: list[bytes], owner: int) -> None:
        nxt, link, ln, least = self.next, self.link, self.len, self.least
        last = 0
        for w in words:
            if w in nxt[last]:  # known from an earlier sequence
                q = nxt[last][w]
                if ln[q] != ln[last] + 1:
                    q = self._clone(last, q, w)
                last = q
            else:
                cur = len(nxt)
                nxt.append({})
                ln.append(ln[last] + 1)
                link.append(0)
                least.append(2**63 - 1)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[cur] = q if ln[q] == ln[p] + 1 else self._clone(p, q, w)
                last = cur
            if owner < least[last]:
                least[last] = owner

    def _clone(self, p: int, q: int, w: bytes) -> int:
        nxt, link, ln = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        ln.append(ln[p] + 1)
        link.append(link[q])
        self.least.append(self.least[q])
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        link[q] = new
        return new

    def close(self) -> None:
        """Carry owners to shorter words of the same places, and find for each state the one that holds its last ``length`` words."""
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        for v in order:
            p = self.link[v]
            if p > 0 and self.least[v] < self.least[p]:
                self.least[p] = self.least[v]
        self.short = list(range(len(self.len)))
        for v in reversed(order):
            p = self.link[v]
            if self.len[p] >= self.length:
                self.short[v] = self.short[p]

    def open_stretches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Stretches of words outside which no window matches, each a window's length at least.

        A window of ``length`` words holds a whole block of ``half`` words at a multiple of ``half``, so that it lies within reach of a
        block that the automaton has. Most blocks fail at their first words.
        """
        nxt, n, half = self.next, self.length, (self.length + 1) // 2
        root, out = nxt[0], []
        for k in range(0, len(words) - half + 1, half):
            arcs = root
            for w in words[k : k + half]:
                to = arcs.get(w)
                if to is None:
                    break
                arcs = nxt[to]
            else:
                a, b = max(0, k + half - n), min(len(words), k + n)
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
        return out

    def covered(self, words: list[bytes], doc: int) -> np.ndarray:
        """Which words lie in a window that an owner smaller than doc has."""
        ends = []
        nxt, link, ln, n, least, short = self.next, self.link, self.len, self.length, self.least, self.short
        for begin, end in self.open_stretches(words):
            state = matched = 0
            for i in range(begin, end):
                w = words[i]
                to = nxt[state].get(w)
                while to is None and state:
                    state = link[state]
                    matched = ln[state]
                    to = nxt[state].get(w)
                if to is None:
                    matched = 0
                    continue
                state = to
                matched += 1
                if matched >= n and least[short[to]] < doc:
                    ends.append(i)
        step = np.zeros(len(words) + 1, np.int32)
        if ends:
            at = np.array(ends)
            np.add.at(step, at - n + 1, 1)
            np.add.at(step, at + 1, -1)
        return np.cumsum(step[:-1]) > 0


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs (a, b), in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def window_blocks(docs: DataFrame, length: int, n_ranges: int, n_buckets: int) -> DataFrame:
    """(r, blob): r >= 0 holds window entries of a column range; r < 0 what a map task could decide by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, serial = WordHashes(), 0
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, serial
            h = np.concatenate([x for _, x in held])
            doc = np.repeat(np.array([d for d, _ in held], np.int64), [len(x) for _, x in held])
            pos = np.concatenate([np.arange(len(x)) for _, x in held])
            held, size = [], 0
            order = np.lexsort((pos, doc))
            order = order[np.argsort(h[order], kind="stable")]
            h, doc, pos = h[order], doc[order], pos[order]
            first = np.r_[True, h[1:] != h[:-1]]
            owner = np.flatnonzero(first)[np.cumsum(first) - 1]
            later = doc != doc[owner]  # other documents of this block hold the window, too
            rs, blobs = [], []
            if later.any():
                packed = pack(*distinct(doc[owner[later]], pos[owner[later]]))
                rs.append(-1 - serial % n_ranges)
                blobs.append(len(packed).to_bytes(4, "little") + packed + pack(*distinct(doc[owner[later]], bucket_of_doc(doc[later], n_buckets))))
            serial += 1
            h, doc, pos = h[first], doc[first], pos[first]
            r = range_of(h, n_ranges)
            order = np.lexsort((pos, doc, r))
            h, doc, pos, r = h[order], doc[order], pos[order], r[order]
            cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rs.append(int(r[a]))
                blobs.append(pack(doc[a:b], pos[a:b], hashes=h[a:b]))
            return pa.RecordBatch.from_arrays([pa.array(rs, pa.int64()), pa.array(blobs, pa.binary())], ["r", "blob"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if doc_id is not None and len(words) >= length:
                    with np.errstate(over="ignore"):
                        x = gram_hashes(hashes.of(words), length)
                    held.append((doc_id, x))
                    size += len(x)
                    if size >= FLUSH:
                        yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, "r long, blob binary")


def shared_windows(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """(kind, owner, value): kind 0, a window of owner at word value is reference; kind 1, bucket value needs owner."""

    def reduce(table: pa.Table) -> pa.Table:
        r, blobs = table.column("r")[0].as_py(), table.column("blob").to_pylist()
        if r < 0:
            refs, needs = [], []
            for b in blobs:
                n = int.from_bytes(b[:4], "little")
                refs.append(b[4 : 4 + n])
                needs.append(b[4 + n :])
            (ro, rp), (no, nb) = gather(refs, 2), gather(needs, 2)
        else:
            doc, pos, h = gather(blobs, 2, True)
            order = np.lexsort((pos, doc, h))
            h, doc, pos = h[order], doc[order], pos[order]
            first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
            owner = np.flatnonzero(first)[np.cumsum(first) - 1]
            later = doc != doc[owner]
            ro, rp = doc[owner[later]], pos[owner[later]]
            no, nb = doc[owner[later]], bucket_of_doc(doc[later], n_buckets)
        (ro, rp), (no, nb) = distinct(ro, rp), distinct(no, nb)
        kind = np.r_[np.zeros(len(ro), np.int32), np.ones(len(no), np.int32)]
        return pa.table({"kind": pa.array(kind, pa.int32()), "owner": pa.array(np.r_[ro, no], pa.int64()), "value": pa.array(np.r_[rp, nb], pa.int64())})

    return blocks.groupBy("r").applyInArrow(reduce, "kind int, owner long, value long")


def reference_spans(docs: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """(owner, spans): each owner's repeated windows as maximal runs of words, one span a line."""
    places = stored(shared.filter("kind = 0").groupBy("owner").agg(F.sort_array(F.collect_set("value")).alias("places")), "places")
    size = places.agg(F.sum(8 * F.size("places") + 64)).first()[0] or 0
    places = F.broadcast(places) if size <= BROADCAST_BYTES else places.hint("shuffle_merge")
    owners = docs.join(places, F.col("doc_id") == F.col("owner")).select("owner", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for owner, text, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                at = np.array([p for p in places if p + length <= len(words)], np.int64)
                cuts = np.flatnonzero(np.r_[True, np.diff(at) > 1, True]) if len(at) else []
                spans = [b" ".join(words[at[x] : at[y - 1] + length]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                out.append((owner, BREAK.join(spans)))
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], ["owner", "spans"])

    return owners.mapInArrow(run, "owner long, spans binary")


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space) and the columns ``carry`` for every row.

    With ``as_is`` a text that loses nothing is kept as it stands, white space and all.
    A null or empty text has no words. A null id is never an owner and loses nothing. Rows of one id are one document
    as owners, and each row loses what a smaller id has.
    """
    spark = spark_of(docs)
    small_batches(spark)
    importable(spark)
    rows = texts(docs, id_col, text_col)
    n_ranges = ranges(rows)
    n_buckets = 2 * n_ranges + 1
    shared = stored(shared_windows(window_blocks(rows, length, n_ranges, n_buckets), n_buckets), "shared-windows")
    spans = reference_spans(rows, shared, length)
    shards = shared.filter("kind = 1").select("owner", F.col("value").alias("bucket")).distinct().join(spans, "owner")
    extra = [f"_carried_{i}" for i in range(len(carry))]
    placed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(x) for c, x in zip(carry, extra, strict=True)])
    placed = placed.withColumn("bucket", F.pmod(F.coalesce("doc_id", F.xxhash64("text")), F.lit(n_buckets)))

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        auto = SuffixAutomaton(length)
        for owner, lines in zip(right.column("owner").to_pylist(), right.column("spans").to_pylist(), strict=True):
            for line in lines.split(BREAK):
                auto.add(line.split(b" "), owner)
        auto.close()
        some = right.num_rows > 0
        out = []
        for doc_id, text in zip(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            gone = auto.covered(words, doc_id) if some and doc_id is not None and len(words) >= length else None
            n = int(gone.sum()) if gone is not None else 0
            kept = [w for w, g in zip(words, gone, strict=True) if not g] if n else words
            out.append((doc_id, len(words), n, text if as_is and not n else b" ".join(kept).decode("utf-8", "surrogatepass")))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        made = [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)]
        return pa.table(made + [left.column(x) for x in extra], names=["doc_id", "n_words", "n_removed", "kept", *extra])

    schema = "doc_id long, n_words long, n_removed long, kept string" + "".join(f", {x} {placed.schema[x].dataType.simpleString()}" for x in extra)
    cleaned = placed.groupBy("bucket").cogroup(shards.groupBy("bucket")).applyInArrow(clean, schema)
    return cleaned.select("doc_id", "n_words", "n_removed", "kept", *[F.col(x).alias(c) for c, x in zip(carry, extra, strict=True)])


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
