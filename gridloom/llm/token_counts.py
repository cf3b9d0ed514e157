"""Token counts by a map-side two-tier lookup.

Tier one is a compact broadcast table of the lengths of frequent pre-tokens: the vocabulary's own entries, which
are the frequent pre-tokens of the text that the merges come from. Its size is that of the vocabulary, whatever the
input. Tier two is each worker's cache of the pre-tokens that missed, encoded by the library. No pre-token is shuffled.
A text is cut into chunks at safe spaces, chunks into pre-tokens by the file's own rule; sums of chunks are kept in the worker, too.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .bpe import PATTERN, TreeEncoder, byte_alphabet
from .common import map_batches, small_batches, spark_of, texts


#: Chunks and missed pre-tokens whose lengths a worker keeps: a number each.
CHUNKS = 400_000


def frequent_lengths(path: str) -> dict[str, int]:
    """Pre-token to number of tokens, for each vocabulary entry that is one pre-token by the file's rule."""
    lib = Tokenizer.from_file(path)
    back = {c: b for b, c in enumerate(byte_alphabet())}
    whole = [bytes(back[c] for c in t).decode("utf-8", "replace") for t in lib.get_vocab(with_added_tokens=False) if all(c in back for c in t)]
    found = [w for w in whole if "\ufffd" not in w and len(lib.pre_tokenizer.pre_tokenize_str(w)) == 1]
    return {w: len(e.ids) for w, e in zip(found, lib.encode_batch_fast(found, add_special_tokens=False), strict=True)}


class Lengths:
    """Number of tokens of a chunk, by its pre-tokens where the file's rule is the known pattern, else by the library."""

    def __init__(self, enc: TreeEncoder, frequent: dict[str, int]):
        self.enc, self.frequent = enc, frequent
        self.missed: dict[str, int] = {}
        self.split = regex.compile(PATTERN).findall

    def __call__(self, chunk: str) -> int:
        if not self.enc.plain(chunk):
            return len(self.enc.ids_of(chunk))
        n = 0
        for p in self.split(chunk):
            k = self.frequent.get(p) or self.missed.get(p)
            if k is None:
                if len(self.missed) > self.enc.limit:
                    self.missed.clear()
                k = self.missed[p] = len(self.enc.ids_of(p))
            n += k
        return n


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. A null text counts as empty; repeated rows and null ids are rows like others."""
    spark = spark_of(docs)
    small_batches(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(path))

    def make():
        enc = TreeEncoder(path, cache=CHUNKS)
        lengths = enc.coder(Lengths(enc, table.value))

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [t or "" for t in b.column(1).to_pylist()]
            tokens = [sum(lengths(t)) for t in rows]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in rows], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return step

    return map_batches(texts(docs, id_col, text_col), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
