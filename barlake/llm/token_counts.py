"""Token counts by overlap resynchronisation.

A document of up to ``chunk`` characters is encoded where it is read.  A huge one
is cut into chunks, each of which also holds ``overlap`` characters of its
neighbours, so that its chunks are encoded by many tasks.  Two neighbours are
spliced at a token that both have at one place of their common text; the left
chunk counts up to it, the right one from it on.

Why such a place is proven.  A byte pair encoding is right if each adjacent pair of
its tokens is, and every pair of the spliced sequence is adjacent in one of the two
encodings.  A chunk's end can only cut the pre-token there; what is left of it is the
beginning (end) of the whole one, as a pre-token is a run of one class of characters
and the pattern looks one character ahead and never back.  The token in common lies in
what both chunks have of its pre-token, so from it on the right chunk's pre-tokens end
where the whole text's do, and up to it the left chunk's begin where those do.

Where two encodings have no token in common, the document is cut again with an overlap
eight times as wide and chunks to match; the last resort is the whole text in one
chunk.  No overlap is thus too narrow and no text too long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, trimmed

CHUNK, OVERLAP, WIDER = 1 << 15, 256, 8
#: Characters that are encoded in one call, and that a batch of chunks holds.
CALL, BATCH = 1 << 20, 1 << 22
SIDES = "uid long, junction long, side int, first long, at array<int>, ids array<int>"


class WordCounts(dict):
    """Numbers of tokens of texts, with a bounded memory of recent words.

    A blank without other white space beside it begins a pre-token, so what lies
    between two such blanks encodes alike everywhere; texts with other runs of
    blanks are encoded whole.
    """

    def __init__(self, path: str, remembered: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.remembered = remembered
        self.odd = re.compile(r" \s|\s |^ | $")

    def __missing__(self, word: str) -> int:
        if len(self) >= self.remembered:
            self.clear()
        n = self[word] = self.whole(" " + word)
        return n

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.odd.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + sum(map(self.__getitem__, rest))

    @cached_property
    def partial(self) -> np.ndarray:
        """Which tokens don't begin with a whole character."""
        n = max(self.tokenizer.get_vocab().values()) + 1
        return np.array([self.tokenizer.decode([i], skip_special_tokens=False).startswith("\ufffd") for i in range(n)])

    def places(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text (first character, id) of its tokens; those that may begin inside a character have -1."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CALL):
                size, j = size + len(texts[j]), j + 1
            for e in self.tokenizer.encode_batch(texts[i:j], add_special_tokens=False):
                at = np.array([a for a, _ in e.offsets], np.int64)
                ids = np.array(e.ids, np.int64)
                at[1:][at[1:] == at[:-1]] = -1
                at[self.partial[ids]] = -1
                yield at, ids
            i = j


@lru_cache(1)
def counter(path: str) -> WordCounts:
    """One a worker: later tasks find the words of earlier ones."""
    return WordCounts(path)


def splice(left: tuple[int, np.ndarray, np.ndarray], right: tuple[int, np.ndarray, np.ndarray]) -> int | None:
    """Tokens of the left chunk before a token in common less those of the right chunk before it, or None.

    Each side: number of tokens before the given ones, their places, their ids.
    Of several tokens in common the one nearest to the middle, place 0, is taken.
    """
    (a, at_a, ids_a), (b, at_b, ids_b) = left, right
    inside_a, inside_b = np.flatnonzero(at_a > -(1 << 30)), np.flatnonzero(at_b > -(1 << 30))
    _, x, y = np.intersect1d(at_a[inside_a], at_b[inside_b], assume_unique=True, return_indices=True)
    x, y = inside_a[x], inside_b[y]
    # the same token, which ends at the same place: another one follows it in both
    ok = (x + 1 < len(at_a)) & (y + 1 < len(at_b)) & (ids_a[x] == ids_b[y])
    x, y = x[ok], y[ok]
    same = at_a[x + 1] == at_b[y + 1]
    x, y = x[same], y[same]
    if not len(x):
        return None
    k = np.argmin(np.abs(at_a[x]))
    return int(a + x[k] - b - y[k])


def cut(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``(uid, no, last, lead, text)``: the chunks of ``texts(uid, text)``; ``lead`` characters are the chunk's before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(cols: list[list]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["uid", "no", "last", "lead", "text"])

        for b in batches:
            out: list[list] = [[], [], [], [], []]
            held = 0
            for uid, text in zip(b.column(0), b.column(1)):
                u, t = uid.as_py(), text.as_py()
                chunks = max(1, -(-len(t) // chunk))
                for i in range(chunks):
                    begin = max(0, i * chunk - overlap)
                    piece = t[begin : (i + 1) * chunk + overlap]
                    for c, v in zip(out, (u, i, i == chunks - 1, i * chunk - begin, piece)):
                        c.append(v)
                    held += len(piece)
                    if held > BATCH:
                        yield rows(out)
                        out, held = [[], [], [], [], []], 0
            if out[0]:
                yield rows(out)

    return texts.select("uid", "text").mapInArrow(trimmed(run), "uid long, no long, last boolean, lead int, text string")


def encoded(chunks: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """SIDES of the chunks: the tokens near each junction with a neighbour, places counted from it, and each last chunk's number of tokens (side 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = counter(tokenizer)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        names = ["uid", "junction", "side", "first", "at", "ids"]
        for b in batches:
            out: list[list] = [[] for _ in names]
            uids, nos, lasts, leads = (b.column(k).to_pylist() for k in range(4))
            for uid, no, last, lead, (at, ids) in zip(uids, nos, lasts, leads, encode.places(b.column(4).to_pylist())):
                begun = at >= 0
                near = []
                if no:
                    some = slice(0, int(np.searchsorted(np.maximum.accumulate(at), lead + overlap)))
                    near.append((no - 1, 1, some, lead))
                if last:
                    near.append((no, 2, slice(len(at), len(at)), 0))
                else:
                    some = slice(int(np.searchsorted(np.maximum.accumulate(at), lead + chunk - overlap)), len(at))
                    near.append((no, 0, some, lead + chunk))
                for junction, side, some, middle in near:
                    place = np.where(begun[some], at[some] - middle, -(1 << 30))
                    for c, v in zip(out, (uid, junction, side, some.start, place, ids[some])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return chunks.mapInArrow(trimmed(run), SIDES)


def spliced(sides: DataFrame) -> DataFrame:
    """``(uid, n_tokens)``, null where two chunks have no token in common."""
    side = lambda k: F.max(F.when(F.col("side") == k, F.struct("first", "at", "ids")))
    both = sides.groupBy("uid", "junction").agg(side(0).alias("l"), side(1).alias("r"), F.max(F.when(F.col("side") == 2, F.col("first"))).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(x: pa.StructScalar) -> tuple[int, np.ndarray, np.ndarray]:
            return x["first"].as_py(), x["at"].values.to_numpy().astype(np.int64), x["ids"].values.to_numpy()

        for b in batches:
            n = [x.as_py() if x.is_valid else splice(of(left), of(right)) for left, right, x in zip(b.column(2), b.column(3), b.column(4))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["uid", "n"])

    parts = both.select("uid", "junction", "l", "r", "n").mapInArrow(trimmed(run), "uid long, n long")
    whole = parts.groupBy("uid").agg(F.sum("n").alias("n_tokens"), F.bool_or(F.col("n").isNull()).alias("failed"))
    return whole.select("uid", F.when(~F.col("failed"), F.col("n_tokens")).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of each row of ``docs(doc_id, text)``, as the tokenizer file gives them for the whole text.

    A null or empty text has no byte and no token; a special string in a text is one
    token, the library's default.  Rows that share an id, or have none, are counted
    each; other columns are left out; no row gives no row.  Texts above ``chunk``
    characters, which are far fewer, are written to the shared folder once.
    """
    if overlap < 1 or chunk < 2 * overlap:
        raise ValueError("a chunk must hold two overlaps of at least a character")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    huge = F.length("text") > chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for b in batches:
            n = pa.array([count(t.as_py()) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    short = docs.where(~huge).select("doc_id", "n_bytes", "text").mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_tokens long")
    long = materialize(docs.where(huge).withColumn("uid", F.monotonically_increasing_id()), "huge")
    if long.isEmpty():
        forget(long)
        return short
    pending, found = long, []
    while True:
        chunks = cut(pending, chunk, overlap).repartition("uid", "no")
        got = materialize(spliced(encoded(chunks, tokenizer, chunk, overlap)), "counted")
        found.append(got)
        failed = got.where("n_tokens is null").select("uid")
        if failed.isEmpty():
            break
        pending = long.join(failed, "uid", "left_semi")
        overlap *= WIDER
        chunk = max(chunk, 4 * overlap)
    known = found[0]
    for more in found[1:]:
        known = known.union(more)
    counts = materialize(long.select("uid", "doc_id", "n_bytes").join(known.where("n_tokens is not null"), "uid").select("doc_id", "n_bytes", "n_tokens"), "counts")
    forget(long, *found)
    return short.union(counts)
