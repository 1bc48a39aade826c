"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two of
n's binary form (as many full ``max_len`` pieces as fit come first).  Every piece
is a sequence of its own, in the bucket of its length: no sequence crosses
documents, and as each length is a power of two nothing is padded.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, trimmed

PIECE = "doc_id long, start long, length long, bucket int, doc_tokens long, ids binary"


class PieceEncoder(dict):
    """Byte-level BPE ids of texts, with a bounded memory of recent words.

    A blank that has no other white space beside it begins a new pre-token, so
    the text between two such blanks encodes alike everywhere.  Texts with other
    runs of blanks go to the tokenizer whole.  The file is one of ``tokenizers``
    (.json), or the same vocabulary as ranks (.tiktoken) with its word pattern;
    both give the same ids.
    """

    def __init__(self, path: str, pattern: str | None = None, remembered: int = 400_000):
        self.remembered = remembered
        self.odd = re.compile(r" \s|\s |^ | $")
        if path.endswith(".tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.remembered:
            self.clear()
        ids = self[word] = np.array(self.encode(" " + word), "<u4").tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        if self.odd.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.encode(first), "<u4").tobytes() + b"".join(map(self.__getitem__, rest))


@remembered
def encoder(path: str, pattern: str | None) -> PieceEncoder:
    """One a worker: later tasks find the words of earlier ones."""
    return PieceEncoder(path, pattern)


def binary_lengths(n: int, max_len: int) -> list[int]:
    """Full pieces first, then the powers of two of the rest, largest first."""
    full, rest = divmod(n, max_len)
    return [max_len] * full + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str | None = None, max_len: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: PIECE's columns, ``sequence_id``, ``offset``.

    A null text is empty: one piece with the end id alone.  ``ids`` are unsigned
    little-endian 32-bit numbers.  Rows with the same or no ``doc_id`` are packed
    each on its own; other columns are left out; no row gives no row.  It runs in
    one pass over the scan without a shuffle: ``sequence_id`` is unique and comes
    from the piece's place in the scan, so a task that runs again gives it again.
    """
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, pattern)
        end = np.array([end_id], "<u4").tobytes()

        def rows(cols: tuple[list, ...]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                ["doc_id", "start", "length", "bucket", "doc_tokens", "ids"],
            )

        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(6))
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encode.ids(text.as_py() or "") + end
                at, doc, total = 0, doc_id.as_py(), len(ids) // 4
                for n in binary_lengths(total, max_len):
                    piece = ids[4 * at : 4 * (at + n)]
                    for c, v in zip(out, (doc, at, n, n.bit_length() - 1, total, piece)):
                        c.append(v)
                    at += n
                    held += len(piece)
                    if held > 8 << 20:
                        yield rows(out)
                        out, held = tuple([] for _ in range(6)), 0
            if out[0]:
                yield rows(out)

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run, encoder), PIECE)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per length, so that a batch is read from sequences of one length."""
    packed.write.partitionBy("bucket").parquet(path)
