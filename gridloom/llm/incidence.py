"""Blocks of the sparse incidence matrix of documents by n-grams, dealt out by column range.

An entry is (hash of an n-gram, document, payload). A map task packs the entries of a few hundred thousand n-grams into one compressed
block for each column range; a reduce task gets all blocks of its range. Entries never become Spark rows. Hashes keep all 64 bits.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that a map task gathers before it packs them.
FLUSH = 300_000
#: Bytes of text for each column range: about a million entries. While there are fewer ranges than shuffle partitions they may be smaller.
RANGE_BYTES, LEAST_BYTES = 16 << 20, 1 << 20


def ranges(docs: DataFrame, text_col: str = "text") -> int:
    """Number of column ranges by the bytes of text that there are, so that a range's entries fit a worker at any size of the table."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    few = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // LEAST_BYTES)
    return max(1, few, min(1 << 30, -(-size // RANGE_BYTES)))


def range_of(h: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the upper half of a hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length of the array at the end."""
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1], True]) if len(sorted_) else np.zeros(1, np.int64)


class WordHashes(dict):
    """Word to 64-bit hash, kept up to a number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def deltas(v: np.ndarray) -> bytes:
    v = np.asarray(v, np.int64)
    d = np.diff(v, prepend=np.int64(0))
    kind = np.int16 if len(d) and d.max() < 32_767 and d.min() > -32_767 else np.int64
    return (b"\1" if kind is np.int16 else b"\0") + d.astype(kind).tobytes()


def undeltas(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, np.int16 if b[:1] == b"\1" else np.int64, offset=1), dtype=np.int64)


def pack(*columns: np.ndarray, hashes: np.ndarray | None = None) -> bytes:
    """Integer columns, delta-coded and compressed; hashes whole and as they are. Columns may differ in length."""
    parts = [zstandard.compress(deltas(c), 1) for c in columns]
    head = np.array([len(p) for p in parts], np.int32).tobytes()
    return head + b"".join(parts) + (b"" if hashes is None else np.ascontiguousarray(hashes, "<u8").tobytes())


def unpack(blob: bytes, columns: int, hashed: bool = False) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int32, columns)
    at, out = 4 * columns, []
    for n in sizes:
        out.append(undeltas(zstandard.decompress(blob[at : at + n])))
        at += int(n)
    return out + [np.frombuffer(blob[at:], "<u8")] * hashed


def gather(blobs: list[bytes], columns: int, hashed: bool = False) -> list[np.ndarray]:
    """The columns of many blobs, one after another."""
    each = [unpack(b, columns, hashed) for b in blobs]
    kinds = [np.int64] * columns + [np.uint64] * hashed
    return [np.concatenate([e[i] for e in each]) if each else np.empty(0, k) for i, k in enumerate(kinds)]


def dealt(to: np.ndarray, *columns: np.ndarray, hashes: np.ndarray | None = None) -> tuple[list[int], list[bytes]]:
    """Blobs of entries by where they go, the order within each kept."""
    order = np.argsort(to, kind="stable")
    to, columns = to[order], [c[order] for c in columns]
    hashes = None if hashes is None else hashes[order]
    cuts = runs(to)
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
    return [int(to[a]) for a, _ in parts], [pack(*[c[a:b] for c in columns], hashes=None if hashes is None else hashes[a:b]) for a, b in parts]


def bucket_of_doc(doc: np.ndarray, n: int) -> np.ndarray:
    """A document's row bucket, as pmod(doc_id, n) in SQL; ids in sequence spread evenly."""
    return doc % np.int64(n)
