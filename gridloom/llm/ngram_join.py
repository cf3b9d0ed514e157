"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Two documents link when their sets of word n-grams have a Jaccard likeness of at least PERCENT / 100, that is when they share
at least ``needed`` n-grams, a bound by their two sizes.

1. Pruning by blocks. Of a set of n, the p = n - ceil(t n) + l smallest hashes meet at least l of any linked
   partner's (t n is the least overlap that its size allows). Blocks of these entries, dealt out by column range, count for each
   document how many other documents have; with fewer than l there is no link. Map tasks resolve n-grams repeated within
   their own block and deal out one entry for each, so that a very common n-gram costs an entry a block.
2. Sets of what is left; documents of equal sets become one class, represented by its smallest id.
3. The representatives' incidence gives exact document frequencies. Each set is ordered rarest first; its first n-grams, as
   many as any partner can ask for, are its index.
4. Masked products. In a few rounds every document meets one other: of the n-grams of its index each has a centre, the holder whose
   n-grams are most common and thus likeliest the original of near copies, and the centre that most n-grams name is met. The
   whole rows of such pairs are multiplied block by block, overlaps are summed over the blocks, and pairs below the bound
   fall. Groups of near copies come together without their pairs.
5. The product of the index with itself, for n-grams that still stand in several components: column blocks accumulate the overlap of
   every pair of different components, sums over the blocks below the bound of the prefix are discarded, and the
   rest goes through the masked product.
6. Components of the links, by hooking, pointer jumping and contraction.

Lists of n-grams are gathered by row bucket first, so that a common n-gram costs an entry a bucket; a list that is multiplied and
longer than CELL is cut into chunks, and each pair of chunks is a cell of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import importable
from .common import drop, small_batches, spark_of, stored, texts
from .incidence import FLUSH, WordHashes, bucket_of_doc, dealt, gather, pack, range_of, ranges, runs
from .winnowing import gram_hashes

N = 5
PERCENT = 75
#: Rounds of masked products end after so many, when less than one pair in FRUITLESS links, or when so FEW documents had a pair.
ROUNDS, FRUITLESS, FEW = 6, 20, 100
#: Documents that pruning leaves up to which their ids are broadcast to the scan (8 bytes each); beyond, a shuffled join.
BROADCAST_ROWS = 200_000
#: Entries of one n-gram that are multiplied in one piece, and products that are held at once.
CELL, HELD = 20_000, 1 << 21


def shingles(text: str | None, words: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams, A-Z lower-cased; with fewer words, of the whole sequence."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        return np.unique(gram_hashes(words.of(w), min(n, len(w))) + np.uint64(n - min(n, len(w))))


def least_overlap(n: np.ndarray | int, percent: int):
    """ceil(percent * n / 100): what a set of n shares with any linked one."""
    return -(-n * percent // 100)


def needed(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """What sets of n and m must share to link: 100 both >= percent (n + m - both)."""
    return -(-(n + m) * percent // (100 + percent))


def met(need: np.ndarray | int):
    """l of a prefix: of two sets that share ``need``, so many shared n-grams stand among the first n - need + l of each."""
    return 1 + (need - 1) // 8


def pruning_blocks(docs: DataFrame, n: int, percent: int, n_ranges: int) -> DataFrame:
    """(r, blob): r >= 0 holds (doc, hash) entries; r < 0 documents with their set sizes and the counts that the task resolved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, serial = WordHashes(), 0
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, serial
            ids, sizes = np.array([d for d, _, _ in held], np.int64), np.array([s for _, s, _ in held], np.int64)
            h = np.concatenate([x for _, _, x in held])
            row = np.repeat(np.arange(len(held)), [len(x) for _, _, x in held])
            held, size = [], 0
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
            group = np.cumsum(first) - 1
            many = np.bincount(group)[group] > 1 if len(h) else first
            known = np.bincount(row[many], minlength=len(ids))
            # one entry for each n-gram; doc is the row's own where nobody here shares it, else -1 - row: already counted
            rs, blobs = [-1 - serial % n_ranges], [pack(ids, sizes, known)]
            serial += 1
            h, doc, done = h[first], ids[row[first]], many[first].astype(np.int64)
            order = np.argsort(doc, kind="stable")
            r, more = dealt(range_of(h[order], n_ranges), doc[order], done[order], hashes=h[order])
            return pa.RecordBatch.from_arrays([pa.array(rs + r, pa.int64()), pa.array(blobs + more, pa.binary())], ["r", "blob"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if doc_id is None:
                    continue
                x = shingles(text, words, n)
                most = len(x) - least_overlap(len(x), percent) + sharing(len(x))
                held.append((doc_id, len(x), x[:most]))
                size += most + 1
                if size >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, "r long, blob binary")


def sharing(n):
    """l of the pruning prefix: an eighth of the set, at least one. As rounding may differ by one between partners, one less is asked for."""
    return -(-n // 8)


def pruning_counts(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """(kind, bucket, blob): kind 0 lists documents of the row bucket with size and count so far, kind 1 with more counts."""

    def reduce(table: pa.Table) -> pa.Table:
        r, blobs = table.column("r")[0].as_py(), table.column("blob").to_pylist()
        if r < 0:
            doc, n, count = gather(blobs, 3)
        else:
            at, done, h = gather(blobs, 2, True)
            order = np.argsort(h, kind="stable")
            h, at, done = h[order], at[order], done[order]
            group = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
            shared = (np.bincount(group)[group] > 1) & (done == 0)
            doc, count = np.unique(at[shared], return_counts=True)
            n = np.zeros(len(doc), np.int64)
        order = np.argsort(doc, kind="stable")
        bucket, blobs = dealt(bucket_of_doc(doc[order], n_buckets), doc[order], n[order], count[order])
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return blocks.groupBy("r").applyInArrow(reduce, "bucket long, blob binary")


def sizes_and_counts(counts: DataFrame) -> DataFrame:
    """(doc_id, n, shared): set size and how many of the prefix other documents have."""

    def add(table: pa.Table) -> pa.Table:
        doc, n, count = gather(table.column("blob").to_pylist(), 3)
        ids, at = np.unique(doc, return_inverse=True)
        most = np.zeros(len(ids), np.int64)
        np.maximum.at(most, at, n)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(most, pa.int64()), "shared": pa.array(np.bincount(at, count, len(ids)).astype(np.int64) if len(ids) else [], pa.int64())})

    return counts.groupBy("bucket").applyInArrow(add, "doc_id long, n long, shared long")


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, key, grams): the sorted 64-bit hashes as bytes, and a digest that equal sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            sets = [shingles(t, words, n).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "n", "key", "grams"])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, grams binary")


def index_of(sets: DataFrame, percent: int, n_ranges: int, n_buckets: int) -> DataFrame:
    """(bucket, doc_id, n, weight, grams, places): each set's rarest n-grams that other sets have, with their places in the order
    rarest first; weight: mean frequency of the set's n-grams."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            h = np.concatenate([x for _, x in held])
            sizes = np.array([len(x) for _, x in held], np.int64)
            doc, n = np.repeat(np.array([d for d, _ in held], np.int64), sizes), np.repeat(sizes, sizes)
            held, size = [], 0
            r, blobs = dealt(range_of(h, n_ranges), doc, n, hashes=h)
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(blobs, pa.binary())], ["r", "blob"])

        for b in batches:
            for d, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((d, np.frombuffer(g, np.uint64)))
                size += len(held[-1][1])
                if size >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    def frequencies(table: pa.Table) -> pa.Table:
        doc, n, h = gather(table.column("blob").to_pylist(), 2, True)
        order = np.argsort(h, kind="stable")
        h, doc, n = h[order], doc[order], n[order]
        df = np.repeat(np.diff(runs(h)), np.diff(runs(h)))
        more = df > 1
        h, doc, n, df = h[more], doc[more], n[more], df[more]
        order = np.lexsort((h, doc))
        bucket, blobs = dealt(bucket_of_doc(doc[order], n_buckets), doc[order], n[order], df[order], hashes=h[order])
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def rarest(table: pa.Table) -> pa.Table:
        doc, n, df, h = gather(table.column("blob").to_pylist(), 3, True)
        order = np.lexsort((h, df, doc))
        doc, n, df, h = doc[order], n[order], df[order], h[order]
        at = runs(doc)
        start, length = at[:-1], np.diff(at)
        sizes = n[start]
        single = sizes - length  # those that no other set has come first
        place = np.arange(len(doc)) - np.repeat(start - single, length)
        weight = np.add.reduceat(df, start) / sizes if len(start) else np.zeros(0)
        least = least_overlap(sizes, percent)
        most = np.clip(sizes - least + met(least) - single, 0, length)
        some = np.flatnonzero(most)
        grams = [h[start[i] : start[i] + most[i]].tobytes() for i in some]
        places = [place[start[i] : start[i] + most[i]].astype("<i4").tobytes() for i in some]
        ids = doc[start[some]]
        return pa.table({"bucket": pa.array(bucket_of_doc(ids, n_buckets), pa.int64()), "doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes[some], pa.int64()), "weight": pa.array(weight[some], pa.float64()), "grams": pa.array(grams, pa.binary()), "places": pa.array(places, pa.binary())})

    blocks = sets.select("doc_id", "grams").mapInArrow(deal, "r long, blob binary")
    return blocks.groupBy("r").applyInArrow(frequencies, "bucket long, blob binary").groupBy("bucket").applyInArrow(rarest, "bucket long, doc_id long, n long, weight double, grams binary, places binary")


def entries(live: pa.Table) -> tuple[np.ndarray, ...]:
    """The index entries of a bucket's documents (doc_id, n, weight, comp, grams, places, ...): row, hash, place, and by row doc, n, comp, weight."""
    grams = [np.frombuffer(g, np.uint64) for g in live.column("grams").to_pylist()]
    places = [np.frombuffer(p, "<i4") for p in live.column("places").to_pylist()]
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    one = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    doc, n, comp = (live.column(c).to_numpy() for c in ("doc_id", "n", "comp"))
    # positive doubles keep their order as integers
    return row, one(grams, np.uint64), one(places, np.int64), doc, n, comp, live.column("weight").to_numpy().view(np.int64)


def open_grams(live: DataFrame, n_ranges: int) -> DataFrame:
    """(bucket, blob): of each n-gram that stands in more than one component, told to each bucket that has it: how many documents have it, and
    its centre's id, size, place and component. A bucket asks once for an n-gram, however many of its documents have it."""

    def ask(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        row, h, place, doc, n, comp, weight = entries(table)
        order = np.lexsort((doc[row], weight[row], h))
        row, h, place = row[order], h[order], place[order]
        at = runs(h)
        first, last = at[:-1], at[1:] - 1
        lo, hi = (f.reduceat(comp[row], first) if len(first) else first for f in (np.minimum, np.maximum))
        top = row[last]
        r, blobs = dealt(range_of(h[last], n_ranges), np.full(len(last), bucket), np.diff(at), lo, hi, doc[top], n[top], place[last], comp[top], weight[top], hashes=h[last])
        return pa.table({"r": pa.array(r, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def tell(table: pa.Table) -> pa.Table:
        bucket, many, lo, hi, doc, n, place, comp, weight, h = gather(table.column("blob").to_pylist(), 9, True)
        order = np.lexsort((doc, weight, h))
        at = runs(h[order])
        first, last, length = at[:-1], order[at[1:] - 1], np.diff(at)
        if not len(first):
            return pa.table({"bucket": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        is_open = np.repeat(np.minimum.reduceat(lo[order], first) < np.maximum.reduceat(hi[order], first), length)
        total, top = np.repeat(np.add.reduceat(many[order], first), length)[is_open], np.repeat(last, length)[is_open]
        to = bucket[order][is_open]
        back, blobs = dealt(to, total, doc[top], n[top], place[top], comp[top], hashes=h[order][is_open])
        return pa.table({"bucket": pa.array(back, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    asked = live.groupBy("bucket").applyInArrow(ask, "r long, blob binary")
    return asked.groupBy("r").applyInArrow(tell, "bucket long, blob binary")


def found_in(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of h stands in the sorted ``known``, and whether it does."""
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    return at, known[at] == h if len(known) else np.zeros(len(h), bool)


def met_centres(live: DataFrame, told: DataFrame, percent: int) -> DataFrame:
    """(a, b, need): for each document the centre that most of its open n-grams name, of another component and not yet tried."""

    def choose(own: pa.Table, replies: pa.Table) -> pa.Table:
        row, h, place, doc, n, comp, _ = entries(own)
        _, c_doc, c_n, c_place, c_comp, known = gather(replies.column("blob").to_pylist(), 5, True)
        order = np.argsort(known)
        at, ok = found_in(h, known[order])
        row, place, at = row[ok], place[ok], order[at[ok]] if len(order) else at[ok]
        need = needed(n[row], c_n[at], percent)
        limit = met(need) - need
        ok = (comp[row] != c_comp[at]) & (place < n[row] + limit) & (c_place[at] < c_n[at] + limit) & (need <= np.minimum(n[row], c_n[at]))
        row, centre, need = row[ok], c_doc[at[ok]], need[ok]
        order = np.lexsort((centre, row))
        row, centre, need = row[order], centre[order], need[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (centre[1:] != centre[:-1])]) if len(row) else np.zeros(0, np.int64)
        votes = np.diff(np.r_[first, len(row)])
        row, centre, need = row[first], centre[first], need[first]
        tried = [set(x or ()) for x in own.column("tried").to_pylist()]
        new = np.array([c not in tried[k] for k, c in zip(row.tolist(), centre.tolist(), strict=True)], bool)
        row, centre, need, votes = row[new], centre[new], need[new], votes[new]
        order = np.lexsort((centre, votes, row))
        best = order[runs(row[order])[1:] - 1]
        return pa.table({"a": pa.array(doc[row[best]], pa.int64()), "b": pa.array(centre[best], pa.int64()), "need": pa.array(need[best], pa.int64())})

    return live.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(choose, "a long, b long, need long")


def close_pairs(live: DataFrame, told: DataFrame, percent: int, n_ranges: int, n_buckets: int) -> DataFrame:
    """(a, b, need): pairs of different components whose indexes share enough, by the product of the open part of the index with itself."""

    def deal(own: pa.Table, replies: pa.Table) -> pa.Table:
        row, h, place, doc, n, comp, _ = entries(own)
        total, _, _, _, _, known = gather(replies.column("blob").to_pylist(), 5, True)
        order = np.argsort(known)
        at, ok = found_in(h, known[order])
        row, h, place = row[ok], h[ok], place[ok]
        chunks = 1 + total[order[at[ok]]] // CELL if len(order) else at[ok]
        # chunk i of a list of k meets chunk j in the cell (i, j): an entry goes to k cells
        each = np.repeat(np.arange(len(h)), chunks)
        other = np.arange(len(each)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        mine = (doc[row] % chunks)[each]
        lo, hi, k = np.minimum(mine, other), np.maximum(mine, other), chunks[each]
        row, h, place = row[each], h[each], place[each]
        with np.errstate(over="ignore"):
            to = h + (lo * k + hi).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        r, blobs = dealt(range_of(to, n_ranges), doc[row], n[row], place, comp[row], mine, lo, hi, hashes=h)
        return pa.table({"r": pa.array(r, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def multiply(table: pa.Table) -> pa.Table:
        doc, n, place, comp, mine, lo, hi, h = gather(table.column("blob").to_pylist(), 7, True)
        order = np.lexsort((doc, comp, hi, lo, h))
        doc, n, place, comp, mine, lo, hi, h = (x[order] for x in (doc, n, place, comp, mine, lo, hi, h))
        new = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        cell = np.flatnonzero(np.r_[True, new, True]) if len(h) else np.zeros(1, np.int64)
        run = np.flatnonzero(np.r_[True, new | (comp[1:] != comp[:-1]), True]) if len(h) else cell
        # an entry meets those of its cell that stand after its component's, so that each pair of components meets once
        begin, end = np.repeat(run[1:], np.diff(run)), np.repeat(cell[1:], np.diff(cell))
        many = end - begin
        total = np.r_[0, np.cumsum(many)]
        sums, k = Sums(), 0
        while k < len(h):
            stop = max(k + 1, int(np.searchsorted(total, total[k] + HELD, "right")) - 1)
            part = many[k:stop]
            x = np.repeat(np.arange(k, stop), part)
            y = np.arange(len(x)) + np.repeat(begin[k:stop] - total[k:stop] + total[k], part)
            k = stop
            need = needed(n[x], n[y], percent)
            limit = met(need) - need
            ok = (place[x] < n[x] + limit) & (place[y] < n[y] + limit) & (need <= np.minimum(n[x], n[y])) & ((lo[x] == hi[x]) | (mine[x] != mine[y]))
            x, y = x[ok], y[ok]
            sums.add(np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y]), need[ok])
        a, b, need, both = sums.all()
        bucket, blobs = dealt(bucket_of_doc(a, n_buckets), a, b, need, both)
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    entries_ = live.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(deal, "r long, blob binary")
    return summed(entries_.groupBy("r").applyInArrow(multiply, "bucket long, blob binary"), met)


class Sums:
    """Overlaps of pairs, accumulated."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray, need: np.ndarray, both: np.ndarray | None = None) -> None:
        self.parts.append(np.stack([a, b, need, np.ones_like(a) if both is None else both]))
        self.size += len(a)
        if self.size > 2 * HELD:
            self.parts = [self.all()]
            self.size = self.parts[0].shape[1]

    def all(self) -> np.ndarray:
        if not self.parts:
            return np.zeros((4, 0), np.int64)
        m = np.concatenate(self.parts, 1)
        m = m[:, np.lexsort((m[1], m[0]))]
        first = np.flatnonzero(np.r_[True, (m[0, 1:] != m[0, :-1]) | (m[1, 1:] != m[1, :-1])]) if m.shape[1] else np.zeros(0, np.int64)
        both = np.add.reduceat(m[3], first) if len(first) else first
        return np.stack([m[0, first], m[1, first], m[2, first], both])


def summed(partial: DataFrame, bound=None) -> DataFrame:
    """(a, b, need) of the pairs whose overlaps, summed over the column blocks, reach a bound by what is needed; itself unless told otherwise."""

    def add(table: pa.Table) -> pa.Table:
        sums = Sums()
        for blob in table.column("blob").to_pylist():
            sums.add(*gather([blob], 4))
        a, b, need, both = sums.all()
        ok = both >= (bound(need) if bound else need)
        return pa.table({"a": pa.array(a[ok], pa.int64()), "b": pa.array(b[ok], pa.int64()), "need": pa.array(need[ok], pa.int64())})

    return partial.groupBy("bucket").applyInArrow(add, "a long, b long, need long")


def linked(pairs: DataFrame, sets: DataFrame, n_ranges: int, n_buckets: int) -> DataFrame:
    """Of pairs (a, b, need) those that share what they need: the product of their whole rows, masked to the pairs, block by block.

    The row of an ``a`` is dealt out with its pair, that of a ``b`` once, whatever the number of its pairs.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            h = np.concatenate([x for *_, x in held])
            k = np.repeat(np.arange(len(held)), [len(x) for *_, x in held])
            a, b, need = (np.array([x[i] for x in held], np.int64) for i in range(3))
            held, size = [], 0
            r, blobs = dealt(range_of(h, n_ranges), a[k], b[k], need[k], hashes=h)
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(blobs, pa.binary())], ["r", "blob"])

        for batch in batches:
            for a, b, need, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((a, b, need, np.frombuffer(g, np.uint64)))
                size += len(held[-1][3])
                if size >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    def multiply(table: pa.Table) -> pa.Table:
        a, b, need, h = gather(table.column("blob").to_pylist(), 3, True)
        column = need == 0
        grams = np.unique(h[column])
        docs = np.unique(b[column])
        code = np.sort(np.searchsorted(docs, b[column]) * len(grams) + np.searchsorted(grams, h[column]))
        a, b, need, h = a[~column], b[~column], need[~column], h[~column]
        (i, is_doc), (j, is_gram) = found_in(b, docs), found_in(h, grams)
        _, hit = found_in(i * len(grams) + j, code)
        hit &= is_doc & is_gram
        sums = Sums()
        sums.add(a[hit], b[hit], need[hit])
        a, b, need, both = sums.all()
        bucket, blobs = dealt(bucket_of_doc(a, n_buckets), a, b, need, both)
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    grams = sets.select(F.col("doc_id").alias("of"), "grams")
    rows = pairs.select("a", "b", "need").join(grams, F.col("a") == F.col("of")).select("a", "b", "need", "grams")
    columns = pairs.select("b").distinct().join(grams, F.col("b") == F.col("of")).select(F.col("b").alias("a"), "b", F.lit(0).cast("long").alias("need"), "grams")
    blocks = rows.unionByName(columns).mapInArrow(deal, "r long, blob binary")
    return summed(blocks.groupBy("r").applyInArrow(multiply, "bucket long, blob binary")).select("a", "b")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, comp) with the least label that links (a, b) reach.

    Labels that links join are the nodes. Each hooks onto its least neighbour, if that is smaller, pointers jump until all show to a
    root, and the links between roots are what is left. The nodes that are left fall by half at least, the jumps are as many as the
    logarithm of the longest way.
    """
    at = lambda side: labels.select(F.col("doc_id").alias(side), F.col("comp").alias(f"{side}_comp"))

    def between(df: DataFrame, x: str, y: str) -> DataFrame:
        return stored(df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a < b").distinct(), "links")

    edges = between(links.select("a", "b").join(at("a"), "a").join(at("b"), "b"), "a_comp", "b_comp")
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(ends.groupBy("a").agg(F.min("b").alias("up")).select("a", F.least("a", "up").alias("up")), "hooks")
        while True:
            over = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
            next_ = stored(up.join(over, "up").select("a", F.col("top").alias("up"), (F.col("top") < F.col("up")).alias("moved")), "hooks")
            drop(up)
            up = next_
            if up.filter("moved").isEmpty():
                break
        root = lambda side: up.select(F.col("a").alias(side), F.col("up").alias(f"{side}_root"))  # noqa: E731, B023
        left = between(edges.join(root("a"), "a").join(root("b"), "b"), "a_root", "b_root")
        drop(edges)
        edges = left
        labels = labels.join(up.select(F.col("a").alias("comp"), F.col("up").alias("root")), "comp", "left").select("doc_id", F.coalesce("root", "comp").alias("comp"))
    return stored(labels, "labels")


def classes(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every id.

    An empty or null text has no n-grams and links with nothing. A null id takes no part (its component is null). Rows
    of one id are one document: its n_shingles is the largest, its links are those of any row.
    """
    spark = spark_of(docs)
    small_batches(spark)
    importable(spark)
    rows = texts(docs, id_col, text_col)
    again = stored(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("again")), "again")
    n_again = again.count()
    if n_again == 0:
        return row_classes(rows, n, percent)
    # rows of an id that others have too go by a hash of id and text, and are tied when components are known
    keyed = rows.join(F.broadcast(again) if n_again <= BROADCAST_ROWS else again, "doc_id", "left").withColumn("row", F.when(F.col("again"), F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).otherwise(F.col("doc_id")))
    owners = stored(keyed.filter("again").select("row", F.col("doc_id").alias("owner")).distinct(), "owners")
    found = row_classes(texts(keyed, "row"), n, percent).join(owners, F.col("doc_id") == F.col("row"), "left")
    found = stored(found.select(F.coalesce("owner", "doc_id").alias("doc_id"), "n_shingles", F.col("component_id").alias("label")), "rows")
    low = found.groupBy("doc_id").agg(F.min("label").alias("a"))
    ties = found.join(low, "doc_id").filter("a < label").select("a", F.col("label").alias("b")).distinct()
    # each starts from its least id: components that share it are one already
    labels = components(found.groupBy("label").agg(F.min("doc_id").alias("comp")).select(F.col("label").alias("doc_id"), "comp"), ties)
    return found.join(labels.withColumnRenamed("doc_id", "label"), "label").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("comp").alias("component_id"))


def row_classes(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """classes() of rows (doc_id, text) of which none share an id, unless they share the text too."""
    n_ranges = ranges(rows)
    n_buckets = n_ranges | 1
    counts = stored(pruning_counts(pruning_blocks(rows, n, percent, n_ranges), n_buckets), "pruning")
    sizes = stored(sizes_and_counts(counts), "sizes")
    drop(counts)
    left = sizes.filter((F.col("n") > 0) & (F.col("shared") >= F.greatest(F.lit(1), F.expr("(n + 7) div 8 - 1")))).select("doc_id")
    left = F.broadcast(left) if left.count() <= BROADCAST_ROWS else left
    sets = stored(sets_of(rows.join(left, "doc_id", "left_semi"), n).filter("n > 0"), "sets")
    # stored, so that a class of many copies is a skewed join, which Spark splits, and not an aggregate's partition
    members = stored(sets.groupBy("key").agg(F.min("doc_id").alias("rep")), "members")
    reps = stored(sets.join(members.withColumnRenamed("rep", "doc_id"), ["key", "doc_id"]).select("doc_id", "n", "key", "grams").dropDuplicates(["doc_id", "key"]), "reps")
    own = stored(sets.select("doc_id", "key").join(members, "key").select("doc_id", F.col("rep").alias("label")), "own")
    drop(sets)
    labels = representatives(reps, percent, n_ranges, n_buckets)
    drop(reps)
    # a document of several rows has several sets; their classes are one
    comp = own.join(labels.withColumnRenamed("doc_id", "label"), "label", "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "label")).alias("comp"))
    return sizes.join(comp, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def representatives(reps: DataFrame, percent: int, n_ranges: int, n_buckets: int) -> DataFrame:
    """Components (doc_id, comp) of the representatives that have an index."""
    index = stored(index_of(reps, percent, n_ranges, n_buckets), "index")
    labels = index.select("doc_id", F.col("doc_id").alias("comp"))
    tried = index.select("doc_id", F.expr("cast(array() AS array<long>)").alias("tried"))
    told = None
    for _ in range(ROUNDS):
        live = index.join(labels, "doc_id").join(tried, "doc_id")
        told = stored(open_grams(live, n_ranges), "open")
        best = stored(met_centres(live, told, percent), "centres")
        n_best = best.count()
        new = stored(linked(best, reps, n_ranges, n_buckets), "found")
        n_new = new.count() if n_best else 0
        if not n_new:
            break
        labels = components(labels, new)
        drop(told)
        told = None
        if n_new * FRUITLESS < n_best or n_best <= FEW:
            break
        more = best.select(F.col("a").alias("doc_id"), F.array("b").alias("more"))
        tried = stored(tried.join(more, "doc_id", "left").select("doc_id", F.concat("tried", F.coalesce("more", F.expr("cast(array() AS array<long>)"))).alias("tried")), "tried")
    live = index.join(labels, "doc_id")
    told = told or stored(open_grams(live, n_ranges), "open")
    rest = stored(close_pairs(live, told, percent, n_ranges, n_buckets), "rest")
    drop(told)
    return components(labels, linked(rest, reps, n_ranges, n_buckets))


def per_row(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """classes() once for each row of docs."""
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    found = classes(docs, id_col=id_col, **options)
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), "component_id")
