"""Interpolated modified Kneser-Ney n-gram scores, of order 2 or 3.

Counted in Spark, stored as sorted hash arrays in the shared folder, and
memory-mapped by the workers that score.

Words travel as 64-bit hashes.  Each task counts its texts' bigrams before the
shuffle and sends them as packed arrays, keyed by a bucket of the context; the
bigrams of the few contexts that are more than a bucket's fair share are spread
over all buckets by the whole bigram.  A bucket's task merges its arrays and
writes one file of sorted bigram hashes with their counts.  Only sums of counts
reach the driver.

Order 3 counts trigrams in the same way, by buckets of the whole trigram, and
takes for the counts of bigrams how many different words stand before them.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path
from .shingles import U, mix, slices, word_hashes

BEGIN, END = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
#: Bigrams that a task holds before it sends them off.
HELD = 1_500_000
#: Tokens whose bigrams a bucket takes, so that merging one needs as much memory at any size.
BUCKET = 2_000_000
#: A count of this is looked up in the list of large counts.
LARGE = 255
PARTS = "bucket int, contexts binary, sizes binary, words binary, counts binary"
MERGED = "kind string, h long, a long, b long, c long, d long, path string"


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens with one end a text, the token before each, and where texts begin and end."""
    h, at = word_hashes(texts)
    return np.insert(h, at[1:], END), np.insert(h, at[:-1], BEGIN), at + np.arange(len(at))


def before_that(context: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The token two before each, by the tokens before each of texts that begin at ``at``."""
    out = np.concatenate([context[:1], context[:-1]])
    out[at[:-1]] = BEGIN
    return out


def bigram_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * U(0xD1342543DE82EF95) + word)


def bucket_of(context: np.ndarray, key: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    spread = np.isin(context, hot)
    return ((np.where(spread, key, mix(context)) >> U(20)) % U(buckets)).astype(np.int64)


def _distinct(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key stands first in sorted order, and its summed count."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order[first], np.add.reduceat(count[order], first) if len(first) else count


def count_words(texts: DataFrame) -> DataFrame:
    """``(h, c)``: each token's hash and count over ``texts(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for _, some in slices(b.column(0)):
                parts.append(np.unique(sequences(some)[0], return_counts=True))
            if parts:
                h, c = (np.concatenate(x) for x in zip(*parts))
                at, c = _distinct(h, c.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(c)], ["h", "c"])

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def count_bigrams(texts: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Packed bigram counts of ``texts(text)``, several rows a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            context, word = (np.concatenate(x) for x in zip(*held))
            key = bigram_key(context, word)
            at, count = _distinct(key, np.ones(len(key), np.uint32))
            context, word = context[at], word[at]
            bucket = bucket_of(context, key[at], hot, buckets)
            order = np.lexsort((word, context, bucket))
            context, word, count, bucket = context[order], word[order], count[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            rows = []
            for a, z in zip(cut, np.append(cut[1:], len(bucket))):
                some = context[a:z]
                first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
                sizes = np.diff(np.append(first, z - a)).astype(np.uint32)
                rows.append((int(bucket[a]), some[first].tobytes(), sizes.tobytes(), word[a:z].tobytes(), count[a:z].astype(np.uint32).tobytes()))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "contexts", "sizes", "words", "counts"]
            )

        for b in batches:
            for _, some in slices(b.column(0)):
                word, context, _ = sequences(some)
                held.append((context, word))
                size += len(word)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, PARTS)


def count_trigrams(texts: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, before, middle, word, count)``: packed trigram counts of ``texts(text)``, several rows a bucket."""
    names = ["bucket", "before", "middle", "word", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            u, v, w = (np.concatenate(x) for x in zip(*held))
            key = bigram_key(bigram_key(u, v), w)
            at, count = _distinct(key, np.ones(len(key), np.uint32))
            bucket = ((key[at] >> U(20)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at, count, bucket = at[order], count[order].astype(np.uint32), bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            rows = [(int(bucket[a]), *(x[at[a:z]].tobytes() for x in (u, v, w)), count[a:z].tobytes()) for a, z in zip(cut, np.append(cut[1:], len(bucket)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(zip(*rows))], names)

        for b in batches:
            for _, some in slices(b.column(0)):
                word, before, at = sequences(some)
                held.append((before_that(before, at), before, word))
                size += len(word)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in names[1:]))


def merge_trigrams(folder: str):
    """As :func:`merge_bucket`; besides, kind "pair": h and a, the last two words of a different trigram each."""

    def merge(rows: pa.Table) -> pa.Table:
        take = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in rows.column(c).combine_chunks()])
        u, v, w, count = take("before", U), take("middle", U), take("word", U), take("count", np.uint32).astype(np.int64)
        context = bigram_key(u, v)
        at, count = _distinct(bigram_key(context, w), count)
        context, v, w = context[at], v[at], w[at]
        key = bigram_key(context, w)
        large = count >= LARGE
        path = write_array(folder, [key, key[large], count[large], np.minimum(count, LARGE).astype(np.uint8)])
        bucket = rows.column("bucket")[0].as_py()
        out = [pa.table({"kind": ["file"], "h": [bucket], "a": [len(key)], "b": [int(large.sum())], "c": [0], "d": [0], "path": [path]})]
        out.append(pa.table({"kind": ["counts"], "h": [bucket], **{c: [int((count == k).sum())] for k, c in enumerate("abcd", 1)}, "path": pa.nulls(1, pa.string())}))
        order = np.argsort(context, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(context[order]) != 0]))
        c = count[order]
        out.append(_table("context", context[order][first], [np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c > 2)]))
        zero = np.zeros(len(v), np.int64)
        out.append(_table("pair", v, [w.view(np.int64), zero, zero, zero]))
        return pa.concat_tables(out)

    return merge


def pack_pairs(pairs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """``pairs(h, a, n)``, bigrams and their counts, packed as :func:`count_bigrams` does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            context, word = (b.column(k).to_numpy().view(U) for k in (0, 1))
            count = b.column(2).to_numpy().astype(np.uint32)
            bucket = bucket_of(context, bigram_key(context, word), hot, buckets)
            order = np.lexsort((word, context, bucket))
            context, word, count, bucket = context[order], word[order], count[order], bucket[order]
            rows = []
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            for a, z in zip(cut, np.append(cut[1:], len(bucket))):
                rows.append((int(bucket[a]), context[a:z].tobytes(), np.ones(z - a, np.uint32).tobytes(), word[a:z].tobytes(), count[a:z].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(zip(*rows))], ["bucket", "contexts", "sizes", "words", "counts"])

    return pairs.select("h", "a", "n").mapInArrow(run, PARTS)


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_array(uri: str, arrays: list[np.ndarray]) -> str:
    """The arrays one after another in a new file; the name is unique to this attempt."""
    where, folder = open_folder(uri)
    where.create_dir(folder, recursive=True)
    name = f"{uuid.uuid4().hex}.arr"
    with where.open_output_stream(f"{folder}/{name}") as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    return name


@lru_cache(4096)
def map_file(uri: str) -> np.ndarray:
    """The file's bytes, memory-mapped; a file that isn't on a mounted path is first copied to an unnamed local one."""
    where, path = open_folder(uri)
    if where.type_name == "local":
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with tempfile.TemporaryFile() as copy:
        with where.open_input_stream(path) as f:
            while part := f.read(8 << 20):
                copy.write(part)
        copy.flush()
        return np.memmap(copy, np.uint8, "r")


def merge_bucket(folder: str):
    """A function that merges a bucket's rows, writes its file and gives the rows of MERGED.

    kind "file": h the bucket, a entries, b large counts; "context": h, a total, b c d
    how many words followed once, twice, more often; "word": h, a distinct contexts;
    "counts": how many bigrams were counted 1, 2, 3 and 4 times.
    """

    def merge(rows: pa.Table) -> pa.Table:
        context, word, count = [], [], []
        for b in rows.to_batches():
            for i in range(b.num_rows):
                c, s, w, n = (b.column(k)[i].as_buffer() for k in ("contexts", "sizes", "words", "counts"))
                context.append(np.repeat(np.frombuffer(c, U), np.frombuffer(s, np.uint32)))
                word.append(np.frombuffer(w, U))
                count.append(np.frombuffer(n, np.uint32))
        bucket = rows.column("bucket")[0].as_py()
        context, word, count = np.concatenate(context), np.concatenate(word), np.concatenate(count).astype(np.int64)
        key = bigram_key(context, word)
        at, count = _distinct(key, count)
        key, context, word = key[at], context[at], word[at]
        large = count >= LARGE
        path = write_array(folder, [key, key[large], count[large], np.minimum(count, LARGE).astype(np.uint8)])
        out = [pa.table({"kind": ["file"], "h": [bucket], "a": [len(key)], "b": [int(large.sum())], "c": [0], "d": [0], "path": [path]})]
        n = [int((count == k).sum()) for k in (1, 2, 3, 4)]
        out.append(pa.table({"kind": ["counts"], "h": [bucket], **{k: [v] for k, v in zip("abcd", n)}, "path": pa.nulls(1, pa.string())}))
        order = np.argsort(context, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(context[order]) != 0]))
        c = count[order]
        sums = [np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c > 2)]
        out.append(_table("context", context[order][first], sums))
        h, n = np.unique(word, return_counts=True)
        zero = np.zeros(len(h), np.int64)
        out.append(_table("word", h, [n.astype(np.int64), zero, zero, zero]))
        return pa.concat_tables(out)

    return merge


def _table(kind: str, h: np.ndarray, cols: list[np.ndarray]) -> pa.Table:
    return pa.table({"kind": [kind] * len(h), "h": h.view(np.int64), **dict(zip("abcd", cols)), "path": pa.nulls(len(h), pa.string())})


def discounts(n: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more; 1/2, 1 and 3/2 where the counts of counts give none."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    got = [1 - 2 * y * n2 / n1 if n1 else 0, 2 - 3 * y * n3 / n2 if n2 else 0, 3 - 4 * y * n4 / n3 if n3 else 0]
    return tuple(g if 0 < g < k + 1 else (k + 1) / 2 for k, g in enumerate(got))


@dataclass(frozen=True)
class Model:
    """Where the sorted arrays lie, and the few numbers that all lookups need."""

    folder: str
    tokens: int
    types: int
    hot: tuple[int, ...]
    buckets: int
    bigram_files: dict = field(default_factory=dict)  # bucket: (name, entries, large counts)
    word_files: tuple = ()  # (least hash, name, entries), in order
    discount: tuple[float, float, float] = (0.5, 1.0, 1.5)
    floor: float = 1.0  # the lower-order probability of an unknown word
    order: int = 2
    trigram_files: dict = field(default_factory=dict)
    context_files: tuple = ()
    trigram_discount: tuple[float, float, float] = (0.5, 1.0, 1.5)

    def words(self, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per hash: count, lower-order probability, total and leftover weight as a context."""
        return self._ranged(h, self.word_files, (0.0, self.floor, 0.0, 1.0))

    def pairs(self, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per hash of two words: total and leftover weight as a context."""
        return self._ranged(h, self.context_files, (0.0, 1.0))

    def _ranged(self, h: np.ndarray, files: tuple, without: tuple[float, ...]) -> tuple[np.ndarray, ...]:
        out = np.repeat(np.array(without)[:, None], len(h), axis=1)
        x = h.view(np.int64)
        lows = np.array([f[0] for f in files], np.int64)
        which = np.searchsorted(lows, x, "right") - 1
        order = np.argsort(x)
        for k in np.unique(which[which >= 0]):
            _, name, n = files[k]
            data = map_file(f"{self.folder}/{name}")
            keys = data[: 8 * n].view(np.int64)
            some = order[which[order] == k]
            at = np.minimum(np.searchsorted(keys, x[some]), n - 1)
            hit = keys[at] == x[some]
            for j in range(len(without)):
                col = data[8 * n * (j + 1) : 8 * n * (j + 2)].view(np.float64)
                out[j][some[hit]] = col[at[hit]]
        return tuple(out)

    def bigram_counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        key = bigram_key(context, word)
        return self._counts(key, bucket_of(context, key, np.array(self.hot, U), self.buckets), self.bigram_files)

    def trigram_counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        key = bigram_key(context, word)
        return self._counts(key, ((key >> U(20)) % U(self.buckets)).astype(np.int64), self.trigram_files)

    def _counts(self, key: np.ndarray, bucket: np.ndarray, files: dict) -> np.ndarray:
        order = np.lexsort((key, bucket))
        out = np.zeros(len(key), np.int64)
        edges = np.flatnonzero(np.diff(bucket[order])) + 1
        for some in np.split(order, edges) if len(order) else ():
            if (found := files.get(int(bucket[some[0]]))) is None:
                continue
            name, n, large = found
            data = map_file(f"{self.folder}/{name}")
            keys, q = data[: 8 * n].view(U), key[some]
            at = np.minimum(np.searchsorted(keys, q), n - 1)
            c = np.where(keys[at] == q, data[8 * n + 16 * large :][at], 0).astype(np.int64)
            if (c == LARGE).any():
                big = c == LARGE
                where = np.searchsorted(data[8 * n : 8 * (n + large)].view(U), q[big])
                c[big] = data[8 * (n + large) : 8 * (n + 2 * large)].view(np.int64)[where]
            out[some] = c
        return out


def _weights(context: DataFrame, d: tuple[float, float, float]) -> DataFrame:
    """``(h, total, gamma)`` of each context."""
    context = context.groupBy("h").agg(*(F.sum(c).alias(c) for c in "abcd"))
    gamma = (F.col("b") * d[0] + F.col("c") * d[1] + F.col("d") * d[2]) / F.col("a")
    return context.select("h", F.col("a").cast("double").alias("total"), gamma.alias("gamma"))


def _sharded(rows: DataFrame, folder: str, what: str) -> tuple:
    """``rows``, h and doubles, as sorted arrays in files by ranges of h: (least hash, name, entries) of each."""
    columns = len(rows.columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            cols = [np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(columns)]
            name = write_array(folder, cols)
            yield pa.RecordBatch.from_arrays([pa.array([cols[0][0]]), pa.array([name]), pa.array([len(cols[0])])], ["h", "path", "n"])

    ordered = rows.repartitionByRange("h").sortWithinPartitions("h")
    shards = materialize(ordered.mapInArrow(write, "h long, path string, n long"), what).collect()
    return tuple(sorted((r["h"], r["path"], r["n"]) for r in shards))


def fit(texts: DataFrame, order: int = 2) -> Model:
    """Learn from ``texts(text)``; null texts are empty; with no row every token is unknown."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = texts.sparkSession
    words = materialize(count_words(texts), "words")
    tokens, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // BUCKET)
    # fewer than 4 * buckets words can be this frequent
    hot = tuple(int(r["h"]) & (1 << 64) - 1 for r in words.where(F.col("c") > max(1, tokens // (4 * buckets))).select("h").collect())
    hot += (int(BEGIN),)
    folder = scratch_path(spark, "bigrams")
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in "abcd"]
    place = lambda rows: {r["h"]: (r["path"], r["a"], r["b"]) for r in rows.where("kind = 'file'").collect()}
    more: dict = {"order": order}
    if order == 3:
        high = materialize(count_trigrams(texts, buckets).groupBy("bucket").applyInArrow(merge_trigrams(folder), MERGED), "trigrams")
        more["trigram_files"] = place(high)
        more["trigram_discount"] = discounts(tuple(high.where("kind = 'counts'").agg(*sums).first()))
        more["context_files"] = _sharded(_weights(high.where("kind = 'context'"), more["trigram_discount"]), folder, "contexts")
        packed = pack_pairs(high.where("kind = 'pair'").groupBy("h", "a").agg(F.count("*").alias("n")), np.array(hot, U), buckets)
    else:
        packed = count_bigrams(texts, np.array(hot, U), buckets)
    merged = materialize(packed.groupBy("bucket").applyInArrow(merge_bucket(folder), MERGED), "merged")
    files = place(merged)
    d = discounts(tuple(merged.where("kind = 'counts'").agg(*sums).first()))
    context = _weights(merged.where("kind = 'context'"), d)
    follows = merged.where("kind = 'word'").groupBy("h").agg(F.sum("a").alias("n"))
    all_n, *n = follows.agg(F.coalesce(F.sum("n"), F.lit(0)), *(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)), F.count_if(F.col("n") > 2)).first()
    e = discounts(tuple(n[:4]))
    left = (e[0] * n[0] + e[1] * n[1] + e[2] * n[4]) / max(1, all_n) if all_n else 1.0
    floor = left / (types + 1)
    cut = F.when(F.col("n") == 1, e[0]).when(F.col("n") == 2, e[1]).otherwise(e[2])
    lower = F.coalesce(F.greatest(F.col("n") - cut, F.lit(0.0)) / float(max(1, all_n)), F.lit(0.0)) + floor
    whole = words.join(follows, "h", "full").join(context, "h", "full")
    whole = whole.select(
        "h", F.coalesce("c", F.lit(0)).cast("double").alias("c"), lower.alias("p"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("gamma", F.lit(1.0)).alias("gamma")
    )

    return Model(folder, tokens, types, hot, buckets, files, _sharded(whole, folder, "shards"), d, floor, **more)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` of each row of ``docs(doc_id, text)``.

    A null text is empty and has one token, its end.  Rows with equal or null ids
    are scored each on its own; other columns are left out.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        d = np.array([0.0, *m.discount])
        for b in batches:
            sums: list[list[np.ndarray]] = [[], [], [], []]
            for _, texts in slices(b.column(1)):
                word, before, at = sequences(texts)
                distinct, place = np.unique(np.concatenate([word, before]), return_inverse=True)
                count, lower, total, gamma = m.words(distinct)
                w, u = place[: len(word)], place[len(word) :]
                pair, back = np.unique(bigram_key(before, word), return_index=True, return_inverse=True)[1:]
                c = m.bigram_counts(before[pair], word[pair])[back]
                t = total[u]
                high = np.where(t > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(t, 1), 0)
                likely = high + np.where(t > 0, gamma[u], 1.0) * lower[w]
                if m.order == 3:
                    two = bigram_key(before_that(before, at), before)
                    some, back = np.unique(two, return_inverse=True)
                    t, left = (x[back] for x in m.pairs(some))
                    pair, back = np.unique(bigram_key(two, word), return_index=True, return_inverse=True)[1:]
                    c = m.trigram_counts(two[pair], word[pair])[back]
                    d3 = np.array([0.0, *m.trigram_discount])
                    likely = np.where(t > 0, np.maximum(c - d3[np.minimum(c, 3)], 0) / np.maximum(t, 1), 0) + left * likely
                p = np.log10(likely)
                base = np.log10((count[w] + 1) / (m.tokens + m.types + 1))
                known = (count[w] > 0).astype(np.int64)
                for k, x in enumerate((np.ones(len(w), np.int64), known, base, p)):
                    sums[k].append(np.add.reduceat(x, at[:-1]))
            if sums[0]:
                cols = [pa.array(np.concatenate(x)) for x in sums]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
