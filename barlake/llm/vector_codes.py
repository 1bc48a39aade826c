"""Vector codes by product quantisation, its codebooks learned by ball k-means.

A vector is cut into equal parts; each part position has a codebook, and a vector's
code is the number of the nearest entry for each part.  All values are integers, so
codes, means and ties are exact whatever the order of the rows.

Ball k-means: the parts of an entry are a ball about it, whose radius is the
distance of the farthest.  Another entry is a neighbour if half its distance from the
entry is within the radius; no other entry can be nearer to any part of the ball.  A
part within half the distance of the nearest neighbour lies in the stable core: it
stays without another look.  The rest lies in annular rings, cut by half the
distances of the neighbours: in the k-th ring only the k nearest neighbours are
candidates, and they are compared exactly.  Only the first assignment, which has no
balls, looks at every entry.

Spark deals the rows; a pass sends sums, counts and radii of each part and entry to
the driver, so many numbers as the codebooks have.  Between the rounds the rows are
written to the shared folder with the codes that they have so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, trimmed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components from which squared distances might leave 64 bits.
LARGEST = 1 << 20
#: Rows and candidate pairs that are compared in one go.
BLOCK, PAIRS = 4096, 1 << 20
#: So many labels' sums are broadcast; beyond them the rows are shuffled.
BROADCAST_LABELS = 1_000_000


@dataclass
class Codebooks:
    """``entries[part, entry]``: integer components; of ``rows`` each has a part, its code so far."""

    entries: np.ndarray
    rows: DataFrame

    def sha256(self) -> str:
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


@dataclass
class Balls:
    """Of each part and entry: its neighbours by distance, itself first, their squared distances, and how many there are."""

    order: np.ndarray
    apart: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(entries: np.ndarray, radius: np.ndarray) -> Balls:
        """``radius[part, entry]``: largest squared distance, -1 of an empty ball."""
        apart = ((entries[:, :, None] - entries[:, None]) ** 2).sum(-1)
        own = np.eye(entries.shape[1], dtype=np.int64)
        order = np.lexsort((np.broadcast_to(1 - own, apart.shape), apart), axis=-1)
        apart = np.take_along_axis(apart, order, -1)
        return Balls(order, apart, (apart <= 4 * radius[..., None]).sum(-1))


def whole_vectors(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """``(vec_id, label, x)``: the usable rows, components scaled to integers.

    A vector that is null or has a null or non-finite component goes.  So does one
    that can't be cut into ``parts`` equal parts of at least a component, or differs
    in length from the first usable one by ``vec_id``.  A component of 2**20 or more
    is an error, as distances might then leave 64 bits.
    """
    v = F.col("embedding").cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v")).where(fine & (F.size(v) > 0) & (F.size(v) % parts == 0))
    first = rows.select("vec_id", F.size("v").alias("n")).orderBy(F.asc_nulls_last("vec_id"), "n").limit(1).select(F.col("n").alias("_n"))
    # one row: the length of the vectors
    rows = rows.join(F.broadcast(first), F.size("v") == F.col("_n"))
    small = F.forall("v", lambda x: F.abs(x) < LARGEST)
    x = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    return rows.select("vec_id", "label", F.when(small, x).otherwise(F.raise_error(F.lit(f"a component is {LARGEST} or more")).cast("array<long>")).alias("x"))


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest of all entries; ties to the lower number."""
    apart = ((x[:, None] - entries[None]) ** 2).sum(-1)
    code = apart.argmin(1)
    return code, apart[np.arange(len(x)), code]


def _nearest_in_balls(x: np.ndarray, code: np.ndarray, entries: np.ndarray, order: np.ndarray, apart: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``_nearest`` from the ball each part was in; and the number of distances worked out."""
    own = ((x - entries[code]) ** 2).sum(-1)
    near = apart[:, 1] if apart.shape[1] > 1 else np.full(len(apart), np.iinfo(np.int64).max)
    unsettled = np.flatnonzero(4 * own >= near[code])  # outside the stable core
    best, least, looked = code.copy(), own.copy(), len(x)
    # the ring: so many neighbours, itself included, lie within twice the part's distance
    ring = np.empty(len(unsettled), np.int64)
    for e in np.unique(code[unsettled]):
        here = code[unsettled] == e
        ring[here] = np.searchsorted(apart[e, : count[e]], 4 * own[unsettled[here]], "right")
    for at in _blocks(ring):
        some, k = unsettled[at], ring[at]
        first = np.cumsum(k) - k
        row = np.repeat(some, k)
        entry = order[code[row], np.arange(len(row)) - np.repeat(first, k)]
        d = ((x[row] - entries[entry]) ** 2).sum(-1)
        low = np.minimum.reduceat(d, first)
        tie = np.where(d == np.repeat(low, k), entry, len(entries))
        best[some], least[some] = np.minimum.reduceat(tie, first), low
        looked += len(row)
    return best, least, looked


def _blocks(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows that have PAIRS pairs in all, or a single row."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        yield slice(at, end)
        at = end


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """The vectors of a batch as [part, row, component]."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), parts, -1).transpose(1, 0, 2)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts).T.astype(np.int64)


def assigned(rows: DataFrame, entries: np.ndarray, balls: Balls | None = None) -> DataFrame:
    """``(vec_id, label, x, code, error, looked)``: nearest entries as a byte for each part, squared distances summed, and the distances worked out."""
    parts = len(entries)
    label = rows.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = _matrix(b.column(2), parts)
                before = _codes(b.column(3), parts) if balls is not None else None
                code, error, looked = np.empty((parts, b.num_rows), np.int64), np.zeros(b.num_rows, np.int64), 0
                for p in range(parts):
                    if balls is None:
                        code[p], least = _nearest(x[p], entries[p])
                        looked += entries.shape[1] * b.num_rows
                    else:
                        code[p], least, n = _nearest_in_balls(x[p], before[p], entries[p], balls.order[p], balls.apart[p], balls.count[p])
                        looked += n
                    error += least
                each = np.zeros(b.num_rows, np.int64)
                each[0] = looked
                codes = [c.tobytes() for c in code.T.astype(np.uint8)]
                cols = [b.column(0), b.column(1), b.column(2), pa.array(codes, pa.binary()), pa.array(error), pa.array(each)]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "x", "code", "error", "looked"])

    read = rows.select("vec_id", "label", "x", *(["code"] if balls is not None else []))
    return read.mapInArrow(trimmed(run), f"vec_id long, label {label.simpleString()}, x array<long>, code binary, error long, looked long")


def means(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries with each used one replaced by the componentwise mean of its parts, rounded down."""
    parts, n, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * n, width), np.int64), np.zeros(parts * n, np.int64)
        for b in filter(len, batches):
            x, code = _matrix(b.column(0), parts), _codes(b.column(1), parts)
            slot = (code + np.arange(parts)[:, None] * n).ravel()
            np.add.at(sums, slot, x.reshape(-1, width))
            counts += np.bincount(slot, minlength=parts * n)
        used = np.flatnonzero(counts)
        cols = [pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["slot", "n", "sums"])

    found = rows.select("x", "code").mapInArrow(trimmed(run), "slot long, n long, sums array<long>")
    total = found.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)))
    out = entries.reshape(-1, width).copy()
    for r in total.collect():  # a row for each entry
        out[r["slot"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out.reshape(entries.shape)


def radii(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The largest squared distance of each entry's parts from it, -1 where it has none."""
    parts, n, _ = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.full(parts * n, -1, np.int64)
        for b in filter(len, batches):
            x, code = _matrix(b.column(0), parts), _codes(b.column(1), parts)
            for p in range(parts):
                np.maximum.at(far, code[p] + p * n, ((x[p] - entries[p][code[p]]) ** 2).sum(-1))
        used = np.flatnonzero(far >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(far[used])], ["slot", "far"])

    found = rows.select("x", "code").mapInArrow(trimmed(run), "slot long, far long").groupBy("slot").agg(F.max("far").alias("far"))
    out = np.full(parts * n, -1, np.int64)
    for r in found.collect():  # a row for each entry
        out[r["slot"]] = r["far"]
    return out.reshape(parts, n)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``whole_vectors``, or None if there is no usable vector.

    The first entries are the parts of the usable vectors of smallest id (null ids
    last, ties by content); with fewer vectors there are fewer entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte for each part: 1 to 256 entries")
    rows = whole_vectors(vectors, parts)
    seeds = rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    if not seeds:
        return None
    books = np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    state = materialize(assigned(rows, books), "codes")
    for _ in range(rounds):
        books = means(state, books)
        last, state = state, materialize(assigned(state, books, Balls.of(books, radii(state, books))), "codes")
        forget(last)
    return Codebooks(books, state)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, label, code, error, label_error, codebooks_sha256, looked)`` of each usable row of ``vectors(vec_id, embedding, label)``.

    ``code`` is a byte for each part, ``looked`` the distances worked out in the last
    assignment, at the first row of each block.  Which rows are usable says
    ``whole_vectors``.  Rows with one vec_id, or none, are coded each; nulls among
    the labels are one label; other columns are left out; no usable row gives none.
    """
    model = fit(vectors, parts, entries, rounds)
    if model is None:
        rows = whole_vectors(vectors, parts).limit(0)
        long = [F.lit(0).cast("long").alias(c) for c in ("error", "label_error")]
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), *long, F.lit("").alias("codebooks_sha256"), F.lit(0).cast("long").alias("looked"))
    rows = model.rows.drop("x")
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    rows = rows.join(F.broadcast(sums) if few else sums, rows["label"].eqNullSafe(sums["_label"]))
    return rows.select("vec_id", "label", "code", "error", "label_error", F.lit(model.sha256()).alias("codebooks_sha256"), "looked")
