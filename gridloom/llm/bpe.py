"""Byte-level BPE over whole texts: cached chunks, and tree concatenation for long unsplit text.

A text is cut at each single space that stands between two characters that are not white space; the
pre-tokenizer always starts a pre-token there, so chunks can be encoded apart and cached. A chunk is encoded by the
library itself, unless one of its pre-tokens is longer than ``leaf`` bytes. Such a pre-token has no place to cut by
rule: it is halved down to leaves, the leaves are encoded in one parallel batch, and neighbours are joined
pairwise. A join re-encodes a window of tokens around the seam and doubles the window until its first token is the
left side's own and its last token is the right side's own. All pairs of neighbouring tokens are then pairs that
BPE itself made next to each other, which makes the joined ids those of the undivided text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import int_lists, map_batches, small_batches, spark_of, texts

#: White space other than space and newline; texts with it are cut by the general pattern.
RARE_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Chunks that a worker keeps; beyond it starts anew. Bounds memory, not results.
CACHE = 200_000
#: Fixed value: the public pattern that byte-level vocabularies of this kind pre-tokenize by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this character the two libraries' Unicode tables agree on what is a letter, a number or a space.
COMMON = "\u0250"
LEAF = 2048


def chunks(text: str) -> list[str]:
    """Parts between safe cuts; each but the first has lost its leading space."""
    odd = text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text or RARE_SPACE.search(text)
    return SAFE.split(text) if odd else text.split(" ")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [rest.get(b, chr(b)) for b in range(256)]


def by_rank(path: str) -> Callable[[str], list[int]] | None:
    """The rank-based encoder for the same merges, quicker on short text; None where ids are not in the order of merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, back = model["vocab"], {c: b for b, c in enumerate(byte_alphabet())}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if model["type"] != "BPE" or made != sorted(made) or not all(c in back for t in vocab for c in t):
        return None
    ranks = {bytes(back[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("by_rank", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


def known_rule(path: str) -> bool:
    """Whether the file pre-tokenizes by PATTERN, without normalizer, prefix space or post-processing that changes ids."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    parts = made.get("pre_tokenizer") or {}
    parts = parts.get("pretokenizers", [parts])
    first, last = parts[0], parts[-1]
    split = first.get("type") == "Split" and first.get("pattern", {}).get("Regex") == PATTERN and len(parts) == 2 and not last.get("use_regex", True)
    plain = len(parts) == 1 and first.get("use_regex", True)
    return bool(made.get("normalizer") is None and last.get("type") == "ByteLevel" and not last.get("add_prefix_space", True) and (split or plain))


class Codes(dict):
    """Chunk to what is kept of its ids, filled as chunks come."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> object:
        self[chunk] = made = self.make(chunk)
        return made


class TreeEncoder:
    """Encodes as the library does, long unsplit text by tree concatenation."""

    def __init__(self, path: str, leaf: int = LEAF, cache: int = CACHE):
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.raw = Tokenizer(self.lib.model)  # the merges alone, over stand-in characters
        added = [re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added) if added else r"(?!)")
        self.leaf, self.limit = leaf, cache
        #: Whether the file's rule is the known pattern: texts may be cut at safe spaces, and the rank-based encoder may be used.
        self.cuts = known_rule(path)
        self.quick = by_rank(path) if self.cuts else None
        self.width = {i: len(t) for t, i in self.lib.get_vocab(with_added_tokens=False).items()}
        self.alphabet = byte_alphabet()

    def _raw(self, many: list[str]) -> list[list[int]]:
        return [e.ids for e in self.raw.encode_batch_fast(many, add_special_tokens=False)]

    def _join(self, whole: str, at: int, a: list[int], b: list[int]) -> list[int]:
        """a encodes what stands before ``at``, b what follows; ids of both together."""
        span = 4
        while True:
            left, right = a[-span:], b[:span]
            lo, hi = at - sum(map(self.width.__getitem__, left)), at + sum(map(self.width.__getitem__, right))
            mid = self._raw([whole[lo:hi]])[0]
            left_done, right_done = span >= len(a), span >= len(b)
            if (left_done or mid[0] == left[0]) and (right_done or mid[-1] == right[-1]):
                return a[:-span] + mid + b[span:] if not left_done else mid + b[span:]
            span *= 2

    def unsplit(self, stood: str) -> list[int]:
        """One pre-token in stand-in characters."""
        if len(stood) <= self.leaf:
            return self._raw([stood])[0]
        n = 1 << ((len(stood) - 1) // self.leaf).bit_length()
        cuts = [len(stood) * k // n for k in range(n + 1)]
        level = self._raw([stood[x:y] for x, y in zip(cuts, cuts[1:], strict=False)])
        while len(level) > 1:
            whole = [stood[x:y] for x, y in zip(cuts[:-2:2], cuts[2::2], strict=True)]
            level = [self._join(t, cuts[2 * k + 1] - cuts[2 * k], level[2 * k], level[2 * k + 1]) for k, t in enumerate(whole)]
            cuts = cuts[::2]
        return level[0]

    def chunk(self, text: str) -> list[int]:
        if len(text) * 4 <= self.leaf or self.special.search(text):
            return self.lib.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for stood, _ in self.lib.pre_tokenizer.pre_tokenize_str(text):
            out += self.unsplit(stood)
        return out

    def plain(self, chunk: str) -> bool:
        """A short chunk that the known pattern cuts as the file's own rule does, without special strings."""
        return bool(self.quick) and len(chunk) * 4 < self.leaf and (chunk.isascii() or max(chunk) < COMMON) and not self.special.search(chunk)

    def ids_of(self, chunk: str) -> list[int]:
        return self.quick(chunk) if self.plain(chunk) else self.chunk(chunk)

    def coder(self, code: Callable[[str], object]) -> Callable[[str], list]:
        """A function from a text to its chunks' codes, which ``code`` makes of a chunk and which are kept."""
        if not self.cuts:  # a rule that is not known: the text as a whole
            return lambda text: [code(text)] if text else []
        later = Codes(lambda c: code(" " + c))

        def of(text: str) -> list:
            if not text:
                return []
            if len(later) > self.limit:
                later.clear()
            p = chunks(text)
            return [code(p[0]), *map(later.__getitem__, p[1:])]

        return of

    def ids(self, batch: list[str]) -> list[bytes]:
        """Raw int32 ids of each text."""
        if not hasattr(self, "_as_bytes"):
            self._as_bytes = self.coder(lambda c: array("i", self.ids_of(c)).tobytes())
        return [b"".join(self._as_bytes(t)) for t in batch]


class Decoder:
    """ids to text as the library decodes them, special tokens kept: their bytes in order, bad UTF-8 replaced."""

    def __init__(self, path: str, lib: Tokenizer | None = None):
        lib = lib or Tokenizer.from_file(path)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.table: list[bytes] = [b""] * (max(lib.get_vocab().values()) + 1)
        for t, i in lib.get_vocab().items():
            self.table[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()

    def __call__(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id, ids array<int> for every row. A null or empty text has no ids; repeated rows stay repeated."""
    small_batches(spark_of(docs))

    def make():
        enc = TreeEncoder(path, leaf)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = enc.ids([t or "" for t in b.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays([b.column(0), int_lists(rows)], ["doc_id", "ids"])

        return step

    return map_batches(texts(docs, id_col, text_col), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded for rows of doc_id and ids; null ids decode to the empty text."""

    def make():
        dec = Decoder(path)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            out = [dec(i or ()) for i in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

        return step

    return map_batches(encoded.select("doc_id", "ids"), make, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """decode(encode(docs)) in one pass: doc_id, ids, decoded. One worker a task does both, with one vocabulary in memory."""
    small_batches(spark_of(docs), 500, 8)

    def make():
        enc = TreeEncoder(path, leaf)
        dec = Decoder(path, enc.lib)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = enc.ids([t or "" for t in b.column(1).to_pylist()])
            out = [dec(array("i", r)) for r in rows]
            return pa.RecordBatch.from_arrays([b.column(0), int_lists(rows), pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

        return step

    return map_batches(texts(docs, id_col, text_col), make, "doc_id long, ids array<int>, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode and decode returned."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
