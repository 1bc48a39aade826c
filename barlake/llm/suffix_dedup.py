"""Repeated windows by a depth-limited radix sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else
too.  Suffixes are ordered by their first ``length`` bytes only, digit by digit
from the most significant one: suffixes alone in their group leave at once, and
suffixes still together at full depth are exactly the repeated windows.

To keep the rows far below one a byte, neighbouring suffixes travel as a bundle.
In every window the k-gram of least hash is its anchor, so equal windows have
equal anchors at equal offsets; the windows of one anchor are its bundle and the
anchor's k bytes, which all of them contain, are the first digit.  In each pass a
bundle has two hashes: of its *core*, the bytes that all its windows share, and of
its *context*, the bytes that any of them touches.  A core met once: no window is
repeated.  A context met again: all are.  Else the bundle is split and its parts
have longer cores, until at full depth a part is one window.  When equal contexts
are done, one of them goes on if bundles of other contexts may still match it.

Runs of words go the same way: each word is spelled as the eight bytes of its
hash, and only windows that begin with a word count.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import uuid
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, scratch_path, small_batches, spread_join, trimmed
from .shingles import U, hashed_words, mix, powers

DEPTH = 3
#: Bytes of text that are looked at in one go, some 60 bytes of memory each; longer texts are read in blocks.
BLOCK = 1 << 20
ROWS = "core long, context long, uid long, code long"
#: Bytes that a word is spelled with, and the bit of a code whose places are counted in these.
SPELLED, WORDS = 8, 62


def branching(length: int) -> int:
    """Parts of a split: the largest b whose cube leaves a seventh of the window to the first digit."""
    b = 2
    while (b + 1) ** DEPTH <= length * 6 // 7 + 1:
        b += 1
    return b


def _code(pos: int | np.ndarray, before_first, before_last, part):
    return pos << 29 | before_first << 19 | before_last << 9 | part


def _parts(code: int) -> tuple[int, int, int, int]:
    """Anchor, first window, last window, part."""
    pos = code >> 29 & (1 << WORDS - 29) - 1
    return pos, pos - (code >> 19 & 1023), pos - (code >> 9 & 1023), code & 511


def _anchor_runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window) of the texts that lie in ``data`` from begins to ends."""
    w = length - k + 1
    n = len(data) - k + 1
    ok = np.flatnonzero(ends - begins >= length)
    if not len(ok):
        return (np.zeros(0, np.int64),) * 4
    p, q = powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p, out=total[1:])
    key = mix((total[k:] - total[:-k]) * q[:n])
    key = (key >> U(32) << U(32)) | (U(0xFFFFFFFF) - np.arange(n, dtype=U))  # ties: the last place
    rows = -(-n // w) + 1
    key = np.concatenate([key, np.full(rows * w - n, 2**64 - 1, U)]).reshape(rows, w)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    count = ends[ok] - begins[ok] - length + 1
    first = np.cumsum(count) - count
    start = np.repeat(begins[ok] - first, count) + np.arange(count.sum())
    low = np.minimum(behind[start], ahead[start + w - 1])
    pos = (U(0xFFFFFFFF) - (low & U(0xFFFFFFFF))).astype(np.int64)
    text = np.repeat(ok, count)
    head = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (text[1:] != text[:-1])]))
    tail = np.append(head[1:], len(pos)) - 1
    return text[head], pos[head], start[head], start[tail]


def anchors(texts: list[bytes], length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, anchor, first window, last window), places counted in each text."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > BLOCK:
            held = None
            for at in range(0, len(texts[i]) - length + 1, BLOCK):
                data = np.frombuffer(texts[i], np.uint8)[at : at + BLOCK + length - 1]
                _, pos, a, z = _anchor_runs(data, np.array([0]), np.array([len(data)]), length, k)
                pos, a, z = pos + at, a + at, z + at
                if held is not None:
                    if len(pos) and held[0][-1] == pos[0]:
                        held[2][-1] = z[0]
                        pos, a, z = pos[1:], a[1:], z[1:]
                    if not len(pos):
                        continue
                    yield np.full(len(held[0]) - 1, i), *(x[:-1] for x in held)
                    pos, a, z = (np.concatenate([h[-1:], x]) for h, x in zip(held, (pos, a, z)))
                held = [pos, a, z]
            if held is not None:
                yield np.full(len(held[0]), i), *held
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and (size := size + len(texts[j])) <= BLOCK:
            j += 1
        ends = np.cumsum([len(t) for t in texts[i:j]])
        begins = ends - np.array([len(t) for t in texts[i:j]])
        data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        if len(data) >= length:
            text, pos, a, z = _anchor_runs(data, begins, ends, length, k)
            yield text + i, pos - begins[text], a - begins[text], z - begins[text]
        i = j


def spelled(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Each text's words as SPELLED bytes each, and where they begin and end in it."""
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and (size := size + len(texts[j])) <= BLOCK:
            j += 1
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[i:j])])
        start, end, h = hashed_words(b"\n".join(texts[i:j]), BLOCK)
        at = np.searchsorted(start, begins)
        for begin, a, z in zip(begins[:-1], at[:-1], at[1:]):
            yield h[a:z].tobytes(), start[a:z] - begin, end[a:z] - begin
        i = j


def _hash(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _rows(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["core", "context", "uid", "code"])


def first_digit(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """A bundle for each anchor: ROWS of ``texts(uid, text)``; the second of two lengths is of spelled words."""

    def bundles(some: list[bytes], uid: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        length = lengths[kind]
        w = branching(length) ** DEPTH - 1
        k = length - w
        for text, pos, first, last in anchors(some, length, k):
            core, context = [], []
            for t, p in zip(text.tolist(), pos.tolist()):
                data = some[t]
                core.append(_hash(data[p : p + k]))
                inside = p >= w and p + length <= len(data)
                context.append(_hash(data[p - w : p + length]) if inside else _hash(b"%d %d %d" % (kind, uid[t], p)))
            if core:
                yield _rows([core, context, uid[text], kind << WORDS | _code(pos, pos - first, pos - last, 0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            uid = b.column(0).to_numpy()
            some = [t.as_py() for t in b.column(1)]
            yield from bundles(some, uid, 0)
            if len(lengths) > 1:
                yield from bundles([s[0] for s in spelled(some)], uid, 1)

    return texts.mapInArrow(trimmed(run), ROWS)


def next_digit(texts: DataFrame, lengths: list[int], level: int) -> DataFrame:
    """The parts of the bundles that go on: ROWS of ``texts(uid, text, codes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for u, t, codes in zip(batch.column(0), batch.column(1), batch.column(2)):
                uid, text, words = u.as_py(), t.as_py(), None
                for code in codes.as_py():
                    kind = code >> WORDS
                    if kind and words is None:
                        words = next(spelled([text]))[0]
                    data, length = words if kind else text, lengths[kind]
                    b = branching(length)
                    w = b**DEPTH - 1
                    width = b ** (DEPTH - level)
                    pos, first, last, parent = _parts(code)
                    for part in range(parent * b, parent * b + b):
                        lo = pos - w + part * width
                        hi = lo + width - 1
                        if hi < first or lo > last or kind and -lo % SPELLED >= width:
                            continue
                        if level == DEPTH:
                            whole = blake2b(data[lo : lo + length], digest_size=16).digest()
                            core, context = (int.from_bytes(x, "little", signed=True) for x in (whole[:8], whole[8:]))
                        else:
                            core = _hash(data[hi : lo + length])
                            inside = lo >= 0 and hi + length <= len(data)
                            context = _hash(data[lo : hi + length]) if inside else _hash(b"%d %d %d %d" % (kind, uid, pos, part))
                        for c, v in zip(out, (core, context, uid, code >> 9 << 9 | part)):
                            c.append(v)
                if len(out[0]) > 50_000:
                    yield _rows(out)
                    out = [[], [], [], []]
            if out[0]:
                yield _rows(out)

    return texts.mapInArrow(trimmed(run), ROWS)


def sort_out(rows: DataFrame) -> DataFrame:
    """``(uid, code, repeated, open)`` of the bundles whose core is met again.

    A core or context that a good share of all bundles has doesn't gather them in
    one task: counts are combined before the shuffle, and such groups are broadcast.
    """
    # met several times below, and dear to make again
    with small_batches(rows.sparkSession):
        rows = materialize(rows, "bundles")
    total = rows.count()
    cores = rows.groupBy("core").agg(F.count("*").alias("c"), F.min("context").alias("x"), F.max("context").alias("y"))
    cores = materialize(cores.where("c > 1").select("core", "c", (F.col("x") != F.col("y")).alias("mixed")), "cores")
    met = spread_join(rows, cores, "core", "c", total)
    met = materialize(met.select("uid", "code", "mixed", F.struct("core", "context").alias("pair"), F.xxhash64("uid", "code").alias("one")), "met")
    contexts = materialize(met.groupBy("pair").agg(F.count("*").alias("m"), F.min("one").alias("least")), "contexts")
    done = spread_join(met, contexts, "pair", "m", total)
    goes_on = F.col("mixed") & ((F.col("m") == 1) | (F.col("one") == F.col("least")))
    done = done.select("uid", "code", (F.col("m") > 1).alias("repeated"), goes_on.alias("open")).where("repeated or open")
    done = materialize(done, "digit")
    forget(rows, cores, met, contexts)
    return done


def stage_texts(docs: DataFrame) -> DataFrame:
    """The rows with a ``uid`` each, written once to the shared folder, in buckets of it.

    The passes join small tables to the texts; in buckets the texts stay where
    they are.  Only a table can be written in buckets: it leaves the catalogue at
    once, its files stay in the shared folder.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"barlake_texts_{uuid.uuid4().hex}"
    rows = docs.withColumn("uid", F.monotonically_increasing_id()).repartition(n, "uid")
    rows.write.bucketBy(n, "uid").option("path", scratch_path(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)
    texts.schema  # the plan now knows files and buckets
    spark.sql(f"DROP TABLE {name}")
    return texts


def repeated_windows(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """``(uid, level, code)``: bundles all of whose windows are repeated."""
    bare = texts.select("uid", "text")
    rows, found, passes = first_digit(bare, lengths), [], []
    for level in range(DEPTH + 1):
        got = sort_out(rows)
        passes.append(got)
        found.append(got.where("repeated").select("uid", F.lit(level).alias("level"), "code"))
        if level < DEPTH:
            todo = got.where("open").groupBy("uid").agg(F.collect_list("code").alias("codes"))
            rows = next_digit(bare.join(todo, "uid").select("uid", "text", "codes"), lengths, level + 1)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    out = materialize(out, "repeated")
    forget(*passes)
    return out


def spans(codes: list[tuple[int, int]], data: bytes, lengths: list[int]) -> list[list[int]]:
    """Maximal runs [begin, end) of ``data`` that the bundles (level, code) cover."""
    runs, words = [], None
    for level, code in codes:
        kind = code >> WORDS
        b = branching(lengths[kind])
        pos, first, last, part = _parts(code)
        lo = pos - b**DEPTH + 1 + part * b ** (DEPTH - level)
        a, z = max(lo, first), min(lo + b ** (DEPTH - level) - 1, last)
        if not kind:
            runs.append((a, z + lengths[0]))
            continue
        words = words or next(spelled([data]))
        a, z = -(-a // SPELLED), z // SPELLED
        if a <= z:
            runs.append((int(words[1][a]), int(words[2][z + lengths[1] // SPELLED - 1])))
    out: list[list[int]] = []
    for a, z in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return out


def remove_repeats(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """All columns of ``docs`` and n_bytes, n_removed, n_spans, kept_sha256, kept.

    ``kept`` is the text's remaining bytes.  Every byte covered by a window of
    ``length`` bytes that starts elsewhere too goes, in each copy, judged on the
    input.  Windows lie within one text; a null text is empty; each row is a text
    of its own, so rows repeated whole lose all but short texts.  Texts shorter
    than ``length`` stay as they are.  Columns with the added names are replaced.

    With ``words``, runs of so many words that are met elsewhere too, whatever
    blanks stand between them, go besides, from their first word to their last,
    however few bytes they have.
    """
    if not 16 <= length <= 600:
        raise ValueError("length must be from 16 to 600 bytes")
    if words is not None and not 16 <= words * SPELLED <= 600:
        raise ValueError(f"words must be from {16 // SPELLED} to {600 // SPELLED}")
    lengths = [length] if words is None else [length, words * SPELLED]
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    keep = [c for c in docs.columns if c not in (*added, "text")]
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    texts = stage_texts(docs.select(F.struct(*keep).alias("row") if keep else F.struct(F.lit(0)).alias("row"), body.alias("text")))
    found = repeated_windows(texts, lengths).groupBy("uid").agg(F.collect_list(F.struct("level", "code")).alias("codes"))
    whole = texts.join(found, "uid", "left").select("row", "text", "codes")
    row = texts.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                out: list[list] = [[], [], [], [], []]
                for t, codes in zip(part.column(1), part.column(2)):
                    data, gone, end, left = t.as_py(), 0, 0, []
                    runs = spans([(c["level"], c["code"]) for c in codes.as_py() or []], data, lengths)
                    for a, z in runs:
                        left.append(data[end:a])
                        gone, end = gone + z - a, z
                    left = b"".join([*left, data[end:]])
                    for c, v in zip(out, (len(data), gone, len(runs), sha256(left).hexdigest(), left)):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["row", *added])

    from pyspark.sql.types import StructType

    schema = StructType().add("row", row).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary")
    done = whole.mapInArrow(trimmed(run), schema)
    return done.select(*[F.col("row")[c].alias(c) for c in keep], *added)
