"""Exact n-gram Jaccard self-join by universe partition and the pigeonhole principle.

Two sets with Jaccard 3/4 or more differ in at most (|r|+|s|)//7 elements.  Sizes
fall into bands a factor 4/3 apart, so partners lie in one band or in neighbours.
For a band the universe of tokens (here: shingles) is hashed into m segments, and
a set's tokens in a segment are its subset there.  A set that probes a band gives
every segment a limit: -1 (skipped), 0 (equal subsets) or 1 (subsets one token
apart).  If the limits plus one add up to more than the largest difference, every
partner agrees with it in some segment within that segment's limit.

*Indexed*: the hash of every non-empty subset; in the designated segments, which
hold all segments of small bands, also those of the subsets less one token.
*Allocation*: empty subsets are skipped at once.  What is left over above the
needed sum may be skipped too, and the costliest groups are, once group sizes are
known: that cuts off subsets that very many unlike texts share.  A signature of a
designated segment counts for two then, as its segment may give that much.  A set whose
non-empty subsets don't suffice is indexed again with another hash, together with
the sets of its own and the neighbouring bands.

*Verified* in three steps, none of which makes a row per pair.  Equal sets are one
class from the start.  Each class first meets the members of two of its groups, the
most frequent and the largest: leaders are taken in turn, whoever parity bits, a
lower bound of the difference, don't rule out is proposed to its leader, and whole
texts decide.  Then, in every group, members of different parts are compared by
parity bits and each part proposes its likeliest pair; large groups of near copies
are then few components.  Last, the members that still have a possible partner in
another part are compared by bits four to eight times as many, and what is then
left brings its whole sets to the group, which decides: it returns the links that
join parts, fewer than it has members.

A group of many members is cut into cells of bounded size, each for some members
of the group's own band and some that probe; a member that skips the group needn't
probe, and members of the group's largest part needn't meet each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, forget, materialize, trimmed
from .shingles import U, mix, shingle_sets, slices

NUM, DEN = 3, 4
ALL_DESIGNATED, DESIGNATED = 40, 12
#: So many document ids are broadcast to thin out the texts before they are shuffled.
BROADCAST_IDS = 1_000_000
#: Signatures that are grouped in one call, and that one run of texts holds.
BUCKET, RUN = 1_000_000, 500_000
#: Shingles of all members of a cell, and members, from which a group is cut.
CELL_SHINGLES, CELL = 2_000_000, 4096
#: Leaders that a group has in the first step; whoever meets none of them is left to the next steps.
LEADERS = 64
PAYLOAD = "bucket int, key binary, role binary, node binary, low binary, high binary"
GROUPS = "g1 long, g2 long, size int, piece int, mult long, keys array<long>, roles array<byte>"
#: What skipping a signature of a designated segment takes from the sum at most, and that of another segment.
SPECIAL, PLAIN = 2, 1


@lru_cache(None)
def bands(n: int) -> tuple[int, ...]:
    """The least size of each band, up to the one after that of size n."""
    low = [1]
    while low[-1] <= n:
        low.append(max(low[-1] + 1, -(-low[-1] * DEN // NUM)))
    low.append(-(-low[-1] * DEN // NUM))
    return tuple(low)


@lru_cache(100_000)
def plan(n: int) -> tuple[tuple[int, int, int, int, int], ...]:
    """(role, band, segments, designated segments, needed sum) of a set of n: role 0 its own band, 1 the band below."""
    low = bands(n)
    k = int(np.searchsorted(low, n, "right")) - 1
    out = []
    for role in (0, 1):
        b = k - role
        if b < 0:
            continue
        top = low[b + 1] - 1
        if role and (top * DEN < n * NUM or (n + top) // 7 == 0):
            continue
        m = -(-36 * top // 100) + 2
        out.append((role, b, m, m if top <= ALL_DESIGNATED else DESIGNATED, (n + min(n, top)) // 7 + 1))
    return tuple(out)


class Segments:
    """The subsets of many sets at once: ``sets`` one after the other, set i of size n[i], each for its own (band, m, designated)."""

    def __init__(self, sets: np.ndarray, n: np.ndarray, band: np.ndarray, m: np.ndarray, designated: np.ndarray, seed: int):
        self.sets, self.n = sets, n
        self.salt = mix((seed * 1_000_003 + band + 1).astype(U))
        self.first = np.cumsum(m) - m
        seg = (mix(sets ^ np.repeat(self.salt, n)) >> U(32)) * np.repeat(m.astype(U), n) >> U(32)
        self.slot = seg.astype(np.int64) + np.repeat(self.first, n)
        self.size = np.bincount(self.slot, minlength=int(m.sum()))
        self.place = np.arange(len(self.size)) - np.repeat(self.first, m)
        self.owner = np.repeat(np.arange(len(n)), m)
        self.special = self.place < designated[self.owner]

    def possible(self) -> np.ndarray:
        """The sum that each set's non-empty subsets can give."""
        gives = (self.size > 0).astype(np.int64) + (self.special & (self.size > 1))
        return np.add.reduceat(gives, self.first)

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """(set, signature): the last bit tells designated segments."""
        term = mix(self.sets + np.repeat(self.salt, self.n))
        total = np.zeros(len(self.size), U)
        np.add.at(total, self.slot, term)
        place = mix(self.place.astype(U) + self.salt[self.owner] * U(3))
        some = np.flatnonzero(self.size)
        whole = mix(total[some] + place[some]) << U(1) | self.special[some].astype(U)
        less = np.flatnonzero((self.special & (self.size > 1))[self.slot])
        at = self.slot[less]
        gone = mix(total[at] - term[less] + place[at]) << U(1) | U(1)
        return np.concatenate([self.owner[some], self.owner[at]]), np.concatenate([whole, gone])


def planned(n: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each role (sets that have it, band, m, designated, need) of sets of sizes n."""
    out = []
    for role in (0, 1):
        of = {int(k): next((p[1:] for p in plan(int(k)) if p[0] == role), None) for k in np.unique(n)}
        ok = np.array([of[int(k)] is not None for k in n], bool)
        cols = np.array([of[int(k)] for k in n[ok]], np.int64).reshape(-1, 4)
        out.append((np.flatnonzero(ok), *cols.T))
    return out


def _some(sets: np.ndarray, n: np.ndarray, which: np.ndarray) -> np.ndarray:
    if len(which) == len(n):
        return sets
    take = np.zeros(len(n), bool)
    take[which] = True
    return sets[np.repeat(take, n)]


def subsets(h: np.ndarray, band: int, m: int, designated: int, seed: int) -> tuple[np.ndarray, int]:
    """The signatures of one set for one band, and the sum that its non-empty subsets can give."""
    got = Segments(h, *(np.array([x]) for x in (len(h), band, m, designated)), seed)
    return got.signatures()[1], int(got.possible()[0])


def spare(sets: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first hash under which each set's subsets suffice for each band that it probes, and (two columns) what they give above need under hash 0."""
    over, short = np.zeros((len(n), 2), np.int64), np.zeros(len(n), bool)
    for role, (which, band, m, designated, need) in enumerate(planned(n)):
        if len(which):
            left = Segments(_some(sets, n, which), n[which], band, m, designated, 0).possible() - need
            over[which, role] = np.clip(left, 0, 30_000)
            short[which] |= left < 0
    seed, begin = np.zeros(len(n), np.int64), np.cumsum(n) - n
    for i in np.flatnonzero(short):  # rare, and small sets only; sooner or later a hash spreads them
        h = sets[begin[i] : begin[i] + n[i]]
        seed[i] = next(k for k in count(1) if all(subsets(h, b, m, d, k)[1] >= need for _, b, m, d, need in plan(len(h))))
    return seed, over


def parities(sets: np.ndarray, n: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of all sets, and bytes of each, for their own band or the one below.

    A bit for each of about 3/2 as many slots as the band's largest set has
    tokens: whether their number there is odd.  The bits in which two sets differ
    are at most the tokens in which they differ.
    """
    low = np.array(bands(int(n.max(initial=1))))
    k = np.maximum(0, np.searchsorted(low, n, "right") - 1 - below)
    slots = 64 * -(-3 * (low[k + 1] - 1) // 128)
    at = (mix(sets + U(0x632BE59BD9B4E019)) >> U(32)) * np.repeat(slots.astype(U), n) >> U(32)
    at = at.astype(np.int64) + np.repeat(np.cumsum(slots) - slots, n)
    return np.packbits((np.bincount(at, minlength=int(slots.sum())) & 1).astype(np.uint8)), slots // 8


def sharp_parities(sets: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``parities``, with 6 to 12 slots a token, a power of two that can be folded to a smaller one."""
    slots = np.maximum(64, 2 ** np.ceil(np.log2(6 * n)).astype(np.int64))
    at = (mix(sets + U(0x9FB21C651E98DF25)) & np.repeat(slots.astype(U) - U(1), n)).astype(np.int64) + np.repeat(np.cumsum(slots) - slots, n)
    return np.packbits((np.bincount(at, minlength=int(slots.sum())) & 1).astype(np.uint8)), slots // 8


def set_key(h: np.ndarray) -> int:
    return int.from_bytes(blake2b(h, digest_size=8).digest(), "little", signed=True)


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _flat(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """All sets of the texts in one array, their sizes and keys."""
    sets = list(shingle_sets(texts, n))
    return np.concatenate(sets), np.array([len(h) for h in sets]), [set_key(h) for h in sets]


def describe(docs: DataFrame, n: int = 5) -> DataFrame:
    """``(doc_id, key, n_shingles, seed, spare0, spare1, bits0, bits1)`` of each row; equal sets have equal (key, n_shingles)."""
    names = ["doc_id", "key", "n_shingles", "seed", "spare0", "spare1", "bits0", "bits1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in slices(b.column(1)):
                sets, size, keys = _flat(texts, n)
                used = np.flatnonzero(size > 2)  # smaller sets are linked with equal ones only
                seed, over, bits = np.zeros(len(size), np.int64), np.zeros((len(size), 2), np.int64), [np.zeros(len(size), np.int64) for _ in "01"]
                data = [np.zeros(0, np.uint8)] * 2
                if len(used):
                    big = _some(sets, size, used)
                    seed[used], over[used] = spare(big, size[used])
                    for k in (0, 1):
                        data[k], bits[k][used] = parities(big, size[used], k)
                cols = [pa.array(x) for x in (keys, size, seed, over[:, 0], over[:, 1])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *cols, *(_binary(d, w) for d, w in zip(data, bits))], names)

    return docs.mapInArrow(trimmed(run), "doc_id long, " + ", ".join(f"{k} long" for k in names[1:6]) + ", bits0 binary, bits1 binary")


def signatures(docs: DataFrame, buckets: int, seed: int, n: int = 5) -> DataFrame:
    """Signatures of all sets as compact rows, one per bucket and run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        held_count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            base = np.cumsum([0, *(len(x[0]) for x in held)])
            key, role = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            node = np.concatenate([x[2] + a for x, a in zip(held, base)]).astype(np.int32)
            sig = np.concatenate([x[3] for x in held])
            bucket = ((sig >> U(41)) % U(buckets)).astype(np.int32)
            order = np.lexsort((node, bucket))
            sig, node, bucket = sig[order], node[order], bucket[order]
            cut = _starts(bucket)
            rows = []
            for a, z in zip(cut, np.append(cut[1:], len(sig))):
                steps = np.diff(node[a:z], prepend=node[a]) > 0  # in order of node: a 1 where the next set begins
                some = node[a:z][np.concatenate([[True], steps[1:]])]
                part = sig[a:z]
                rows.append((int(bucket[a]), key[some].tobytes(), role[some].tobytes(), steps.astype(np.uint8).tobytes(),
                             (part & U(0xFFFFFFFF)).astype(np.uint32).tobytes(), ((part >> U(32)) & U(0xFF)).astype(np.uint8).tobytes()))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "key", "role", "node", "low", "high"]
            )

        for b in batches:
            seen: set[tuple[int, int]] = set()
            for _, texts in slices(b.column(1)):
                sets, size, keys = _flat(texts, n)
                new = [i for i, name in enumerate(zip(keys, size.tolist())) if name[1] > 2 and not (name in seen or seen.add(name))]
                if not new:
                    continue
                sets, size, keys = _some(sets, size, np.array(new)), size[new], np.array(keys, np.int64)[new]
                for role, (which, band, m, designated, _) in enumerate(planned(size)):
                    if len(which):
                        node, sig = Segments(_some(sets, size, which), size[which], band, m, designated, seed).signatures()
                        held.append((keys[which], np.full(len(which), role, np.uint8), node, sig))
                        held_count += len(sig)
                if held_count > RUN:
                    yield from flush()
                    held, held_count = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(trimmed(run), PAYLOAD)


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = False
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def shared_groups(rows: pa.Table, seed: int = 0) -> pa.Table:
    """The groups of one bucket in which at least two different sets agree; groups with the same members are one.

    ``mult`` is what skipping all of them takes from a member's sum, at most.
    (g1, g2) names a group by its members, so that equal groups of other buckets
    can be added.  A group of more than CELL members comes in pieces.
    """
    keys, roles, nodes, vals, base = [], [], [], [], 0
    for r in rows.to_batches():
        for i in range(r.num_rows):
            key, role, node, low, high = (r.column(k)[i].as_buffer() for k in ("key", "role", "node", "low", "high"))
            keys.append(np.frombuffer(key, np.int64))
            roles.append(np.frombuffer(role, np.uint8))
            nodes.append(np.cumsum(np.frombuffer(node, np.uint8), dtype=np.int32) + np.int32(base))
            vals.append(np.frombuffer(high, np.uint8).astype(U) << U(32) | np.frombuffer(low, np.uint32).astype(U))
            base += len(keys[-1])
    key, role, node, val = (np.concatenate(x) for x in (keys, roles, nodes, vals))
    order = np.lexsort((role, key))  # one set met in several rows is one member for each role
    first = _starts(key[order], role[order])
    rank = np.empty(len(order), np.int32)
    rank[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(order))))
    key, role = key[order[first]], role[order[first]]
    member = rank[node]
    order = np.lexsort((member, val))
    val, member = val[order], member[order]
    keep = _starts(val, member)
    val, member = val[keep], member[keep]
    first = _starts(val)
    size = np.diff(np.append(first, len(val)))
    own = np.add.reduceat((role[member] == 0).astype(np.int64), first)
    good = (size > 1) & (own > 0)
    inside = np.repeat(good, size)
    val, member, size = val[inside], member[inside], size[good]
    names = ["g1", "g2", "size", "piece", "mult", "keys", "roles"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8())]
    if not len(size):
        return pa.Table.from_arrays([pa.nulls(0, k) for k in kinds], names)
    first = np.cumsum(size) - size
    # groups with the same members are one
    special = (val[first] & U(1)).astype(np.int64)
    who = mix(key.view(U) * U(2) + role.astype(U) + U(seed) * U(0xD1342543DE82EF95))[member]
    g1, g2 = np.add.reduceat(who, first), np.add.reduceat(mix(who + U(1)), first)
    order = np.lexsort((special, size, g2, g1))
    new = _starts(g1[order], g2[order], size[order])
    pick = order[new]
    mult = np.add.reduceat(np.where(special[order] == 1, SPECIAL, PLAIN), new)
    length, begin = size[pick], first[pick]
    pieces = -(-length // CELL)
    row = np.repeat(np.arange(len(pick)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin[row] + piece * CELL
    width = np.minimum(CELL, begin[row] + length[row] - start)
    m = member[np.repeat(start - (np.cumsum(width) - width), width) + np.arange(width.sum())]
    offsets = pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32))
    cols = [g1[pick][row].view(np.int64), g2[pick][row].view(np.int64), length[row], piece, mult[row]]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (key[m], role[m].astype(np.int8))]
    return pa.Table.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), *lists], names)


def _bits(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U) for x in column]


def _apart(bits: list[np.ndarray], x: np.ndarray, y: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Bits in which members one[x] and two[y] differ."""
    a, b = np.stack([bits[i] for i in one]), np.stack([bits[i] for i in two])
    out = np.zeros(len(x), np.int64)
    step = max(1, (1 << 18) // a.shape[1])
    for at in range(0, len(x), step):
        out[at : at + step] = np.bitwise_count(a[x[at : at + step]] ^ b[y[at : at + step]]).sum(-1, dtype=np.int64)
    return out


def proposals(rows: DataFrame) -> DataFrame:
    """Pairs of a leader and a member that parity bits don't rule out: keys ``(a, b)`` and ids ``(u, v)``; each member has one leader at most.

    ``rows(members)``: the members (n, key, rep, bits) of one group that are to meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for i in range(batch.num_rows):
                m = batch.column(0)[i].values
                (n, key, rep), bits = (m.field(k).to_numpy() for k in range(3)), _bits(m.field(3))
                width = np.array([len(b) for b in bits])
                left = np.lexsort((rep, n))
                left = left[np.argsort(np.abs(n[left] - np.median(n)), kind="stable")]  # from the middle sizes outwards
                for _ in range(LEADERS):
                    if len(left) < 2:
                        break
                    at, left = left[0], left[1:]
                    some = left[width[left] == width[at]]
                    some = some[np.minimum(n[some], n[at]) * DEN >= np.maximum(n[some], n[at]) * NUM]
                    if len(some):
                        apart = _apart(bits, np.zeros(len(some), int), np.arange(len(some)), np.array([at]), some)
                        some = some[apart <= (n[some] + n[at]) // 7]
                    if len(some):
                        found.append((np.full(len(some), key[at]), key[some], np.full(len(some), rep[at]), rep[some]))
                        left = left[~np.isin(left, some)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k)) for k in zip(*found)], ["a", "b", "u", "v"])

    return rows.select("members").mapInArrow(trimmed(run), "a long, b long, u long, v long")


def _possible(m: pa.Array, fold: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(own, probing, bits apart) of members of different parts that parity bits leave as partners, in blocks.

    ``m``: each member (role, skip, n, key, rep, part, bits).  Members of the
    largest part aren't compared with each other.  ``fold`` brings the bits of all
    to one width.
    """
    role, skip, n, _, rep, part = (m.field(k).to_numpy(zero_copy_only=False) for k in range(6))
    bits = _bits(m.field(6))
    which = np.unique(part, return_inverse=True)[1]
    main = which == np.bincount(which).argmax()
    least = min(map(len, bits))
    for i in range(len(bits) if fold else 0):
        while len(bits[i]) > least:
            bits[i] = bits[i][: len(bits[i]) // 2] ^ bits[i][len(bits[i]) // 2 :]
    width = np.array([len(b) for b in bits])
    for w in np.unique(width[role == 0]):
        own, probing = (role == 0) & (width == w), ~skip & (width == w)
        for r, s in ((own, probing & ~main), (own & ~main, probing & main)):
            r, s = np.flatnonzero(r), np.flatnonzero(s)
            step = max(1, 500_000 // max(1, len(r)))
            for at in range(0, len(s) if len(r) else 0, step):
                few = s[at : at + step]
                x, y = (k.ravel() for k in np.meshgrid(np.arange(len(r)), np.arange(len(few)), indexing="ij"))
                a, b = r[x], few[y]
                ok = (part[a] != part[b]) & ((n[a] < n[b]) | ((n[a] == n[b]) & (rep[a] < rep[b]))) & (n[a] * DEN >= n[b] * NUM)
                x, y = x[ok], y[ok]
                apart = _apart(bits, x, y, r, few)
                ok = apart <= (n[r[x]] + n[few[y]]) // 7
                if ok.any():
                    yield r[x[ok]], few[y[ok]], apart[ok]


def likeliest_pairs(cells: DataFrame) -> DataFrame:
    """``(cell, a, b, u, v)``: for each part in ``cells(cell, members)`` the pair with another part that is fewest bits apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell: list[str] = []
            found: list[np.ndarray] = []
            for i in range(batch.num_rows):
                m = batch.column(1)[i].values
                blocks = list(_possible(m))
                if not blocks:
                    continue
                x, y, apart = (np.concatenate(k) for k in zip(*blocks))
                key, rep, part = (m.field(k).to_numpy() for k in (3, 4, 5))
                who, pair = np.concatenate([part[x], part[y]]), np.tile(np.arange(len(x)), 2)
                order = np.lexsort((key[y[pair]], key[x[pair]], apart[pair], who))
                pick = np.unique(pair[order[_starts(who[order])]])
                found.append(np.stack([key[x[pick]], key[y[pick]], rep[x[pick]], rep[y[pick]]]))
                cell += [batch.column(0)[i].as_py()] * len(pick)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.string()), *(pa.array(k) for k in np.concatenate(found, axis=1))], ["cell", "a", "b", "u", "v"])

    return cells.select("cell", "members").mapInArrow(trimmed(run), "cell string, a long, b long, u long, v long")


def possible_members(cells: DataFrame, fold: bool = False) -> DataFrame:
    """``(cell, key)`` of the members of ``cells(cell, members)`` that parity bits leave a partner of another part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, keys = [], []
            for i in range(batch.num_rows):
                m = batch.column(1)[i].values
                stays = np.zeros(len(m), bool)
                for x, y, _ in _possible(m, fold):
                    stays[x] = stays[y] = True
                if stays.any():
                    keys.append(np.unique(m.field(3).to_numpy()[stays]))
                    cell += [batch.column(0)[i].as_py()] * len(keys[-1])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.string()), pa.array(np.concatenate(keys))], ["cell", "key"])

    return cells.select("cell", "members").mapInArrow(trimmed(run), "cell string, key long")


def joining_links(cells: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between members of a cell, by their whole sets, that join all parts that any link joins.

    ``cells(members)``: each member (rep, part, tokens).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                m = batch.column(0)[i].values
                rep = m.field(0).to_numpy()
                sets = _bits(m.field(2))
                _, root = np.unique(m.field(1).to_numpy(), return_inverse=True)
                n = np.array([len(s) for s in sets])
                begin = np.cumsum(n) - n
                token = np.unique(np.concatenate(sets), return_inverse=True)[1]
                mark = np.zeros(len(token), bool)
                most = np.bincount(root).argmax()
                for x in np.flatnonzero(root != most):  # every pair of parts has one such member
                    mine = token[begin[x] : begin[x] + n[x]]
                    mark[mine] = True
                    common = np.add.reduceat(mark[token], begin, dtype=np.int64)
                    mark[mine] = False
                    linked = np.flatnonzero(100 * common >= 75 * (n + n[x] - common))
                    for y in linked[np.unique(root[linked], return_index=True)[1]]:
                        if root[y] != root[x]:
                            root[root == root[y]] = root[x]
                            found.append((rep[x], rep[y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in zip(*found)], ["u", "v"])

    return cells.select("members").mapInArrow(trimmed(run), "u long, v long")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids: by broadcast while the ids are few, else by a shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def whole_sets(docs: DataFrame, ids: DataFrame, n: int = 5, of: Callable = lambda sets, size: (sets, size * 8)) -> DataFrame:
    """``(key, tokens)``: the sets, as hashed shingles or as ``of`` makes of them, of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in slices(b.column(0)):
                sets, size, keys = _flat(texts, n)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _binary(*of(sets, size))], ["key", "tokens"])

    found = _only(docs, ids).select("text").mapInArrow(trimmed(run), "key long, tokens binary")
    return found.groupBy("key").agg(F.first("tokens").alias("tokens"))


def verify(pairs: DataFrame, docs: DataFrame, n: int = 5) -> DataFrame:
    """``(u, v)`` of the pairs ``(a, b, u, v)`` whose whole texts' sets reach the similarity."""
    sets = whole_sets(docs, pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), n)
    one = sets.select(F.col("key").alias("a"), F.col("tokens").alias("tokens_a"))
    two = sets.select(F.col("key").alias("b"), F.col("tokens").alias("tokens_b"))
    both = pairs.join(one, "a").join(two, "b").select("u", "v", "tokens_a", "tokens_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for r, s in zip(*(_bits(batch.column(k)) for k in (2, 3))):
                common = len(np.intersect1d(r, s, assume_unique=True))
                ok.append(100 * common >= 75 * (len(r) + len(s) - common))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(trimmed(run), "u long, v long")


def _labelled(classes: DataFrame, label: DataFrame | None) -> DataFrame:
    """The classes with the part in which they are so far."""
    if label is None:
        return classes.withColumn("part", F.col("rep"))
    return classes.join(label, classes["rep"] == label["node"], "left").select(*classes.columns, F.coalesce("component", "rep").alias("part"))


def _exploded(groups: DataFrame) -> DataFrame:
    rows = groups.select("g1", "g2", "seed", "size", "mult", F.explode(F.arrays_zip("keys", "roles")).alias("x"))
    return rows.select("g1", "g2", "seed", "size", "mult", F.col("x.keys").alias("key"), F.col("x.roles").alias("role"))


def _own_bits() -> F.Column:
    return F.when(F.col("role") == 0, F.col("bits0")).otherwise(F.col("bits1")).alias("bits")


def first_meetings(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """``(members)``: each class in its most frequent and its largest group, which is dealt by a salt if it is large."""
    orders = (("mult", "size", "g1", "g2", "role"), ("size", "mult", "g1", "g2", "role"))
    best = _exploded(groups).groupBy("key").agg(*(F.max(F.struct(*o)).alias(f"p{k}") for k, o in enumerate(orders)))
    chosen = best.select("key", F.explode(F.array_distinct(F.array(*(F.struct(*(F.col(f"p{k}")[c].alias(c) for c in orders[0])) for k in (0, 1))))).alias("p"))
    rows = chosen.select("key", "p.*").join(classes, "key")
    rows = rows.select("g1", "g2", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / CELL)).alias("salt"), F.struct("n", "key", "rep", _own_bits()).alias("m"))
    return rows.groupBy("g1", "g2", "salt").agg(F.collect_list("m").alias("members")).where(F.size("members") > 1)


def mixed_members(groups: DataFrame, place: DataFrame) -> DataFrame:
    """``(g, blocks, role, skip, n, key, rep, bits)``: the members of groups that hold several parts.

    The costliest groups are skipped where a set can spare them; ``place`` has the
    classes with their part.
    """
    name = ["g1", "g2"]
    parts = _exploded(groups).join(place.select("key", "n", "part"), "key")
    mixed = parts.groupBy(*name).agg(F.min("part").alias("p"), F.max("part").alias("q"), F.sum("n").alias("weight")).where("p <> q")
    rows = _exploded(groups).join(mixed.select(*name, "weight"), name).join(place, "key")
    spare_sum = F.when(F.col("seed") > 0, 0).when(F.col("role") == 0, F.col("spare0")).otherwise(F.col("spare1"))
    costly = Window.partitionBy("key", "n", "role", "seed").orderBy(F.desc("size"), *name).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("skip", (F.sum("mult").over(costly) <= spare_sum) & (F.col("size") > 2))
    blocks = F.greatest(F.ceil(F.col("weight") / CELL_SHINGLES), F.ceil(F.col("size") / CELL)).cast("int")
    return rows.select(F.concat_ws(":", *name).alias("g"), blocks.alias("blocks"), "role", "skip", "n", "key", "rep", _own_bits())


def meeting_cells(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``(cell, members)`` of ``mixed_members``, with the part of each by ``label(node, component)``.

    A pair meets if one member is of the group's own band and the other probes, that
    is doesn't skip the group; so a group where all skip is left out.  A group above
    CELL members or CELL_SHINGLES is dealt to cells, each for a block of its own
    members and one of those that probe: p that probe among g members are at most
    g * (p / CELL + 2) + p * (g / CELL + 2) rows.  Those of the largest part needn't
    meet each other.
    """
    few = label.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    parts = label.select(F.col("node").alias("rep"), "component")
    rows = rows.join(F.broadcast(parts) if few else parts, "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    member = lambda role, skip: F.struct(role.alias("role"), skip.alias("skip"), "n", "key", "rep", "part", "bits").alias("m")
    small = rows.where("blocks = 1").select(F.col("g").alias("cell"), member(F.col("role"), F.col("skip")))

    big = rows.where("blocks > 1")
    own, probes = F.col("role") == 0, ~F.col("skip")
    counts = [F.count("*").alias("c"), F.sum("n").alias("w"), F.count_if(own).alias("own"), F.count_if(probes).alias("probes")]
    of_parts = big.groupBy("g", "part").agg(*counts)
    top = F.max(F.struct("c", "part", "own", "probes")).alias("t")
    total = of_parts.groupBy("g").agg(top, *(F.sum(c).alias(c) for c in ("c", "w", "own", "probes"))).where("probes > 0")
    wide = F.greatest(F.lit(1.0), F.col("w") / F.col("c") * CELL / CELL_SHINGLES) / CELL
    blocks = {f"{who}_{where}": F.ceil(wide * (F.col(f"t.{who}") if where == "top" else F.col(who) - F.col(f"t.{who}"))).cast("int") for who in ("own", "probes") for where in ("top", "rest")}
    big = big.join(total.select("g", F.col("t.part").alias("top"), *(c.alias(k) for k, c in blocks.items())), "g")

    def cells(mine: str, others: str) -> F.Column:
        """The cells of this row as one of the ``mine`` blocks, with every block of ``others``."""
        block = F.pmod(F.xxhash64("rep"), F.greatest(F.col(mine), F.lit(1)))
        name = lambda j: F.concat_ws(":", "g", *((F.lit(f"{mine}-{others}"), block, j) if mine < others else (F.lit(f"{others}-{mine}"), j, block)))
        return F.when(F.col(others) > 0, F.transform(F.sequence(F.lit(0), F.col(others) - 1), name)).otherwise(F.array().cast("array<string>"))

    main = F.col("part") == F.col("top")
    as_own = F.when(main, cells("own_top", "probes_rest")).otherwise(F.concat(cells("own_rest", "probes_rest"), cells("own_rest", "probes_top")))
    as_probe = F.when(main, cells("probes_top", "own_rest")).otherwise(F.concat(cells("probes_rest", "own_rest"), cells("probes_rest", "own_top")))
    dealt_own = big.where(own).select(F.explode(as_own).alias("cell"), member(F.col("role"), F.lit(True)))
    dealt_probes = big.where(probes).select(F.explode(as_probe).alias("cell"), member(F.lit(1).cast(rows.schema["role"].dataType), F.col("skip")))
    met = small.union(dealt_own).union(dealt_probes).groupBy("cell").agg(F.collect_list("m").alias("members"))
    return met.where((F.size("members") > 1) & F.exists("members", lambda m: ~m["skip"]))


def join_components(docs: DataFrame, n: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs(doc_id, text)``.

    A null, empty or blank text has no shingle and is linked with nothing.  Rows
    with one doc_id are one document for linking and each keeps its row; a row
    without a doc_id gets no component.  Copies are one class.  Other columns are
    left out; no row gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    known = materialize(describe(docs, n), "sets")
    named = known.where("n_shingles > 0 and doc_id is not null")
    same = [F.first(c).alias(c) for c in ("spare0", "spare1", "bits0", "bits1")]
    classes = materialize(named.groupBy("key", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), *same), "classes")
    signed = classes.agg(F.sum(F.when(F.col("n") > 2, F.col("n") * 0.7 + 60))).first()[0] or 0  # about so many signatures
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(signed / BUCKET) + 1)

    def indexed(rows: DataFrame, seed: int) -> DataFrame:
        found = signatures(rows, buckets, seed, n).groupBy("bucket").applyInArrow(lambda t: shared_groups(t, seed), GROUPS)
        return found.withColumn("seed", F.lit(seed))

    found = indexed(docs.where("doc_id is not null"), 0)
    odd = known.where("seed > 0").select("seed", "n_shingles").distinct().collect()  # a few small sizes
    for seed in sorted({r["seed"] for r in odd}):
        near = [bands(r["n_shingles"]) for r in odd if r["seed"] == seed]
        low, high = min(b[max(0, len(b) - 5)] for b in near), max(b[-1] * DEN // NUM + 1 for b in near)
        found = found.union(indexed(_only(docs, named.where(F.col("n_shingles").between(low, high)).select("doc_id").distinct()), seed))
    found = materialize(found, "groups")
    lists = [F.first("keys").alias("keys"), F.first("roles").alias("roles"), F.sum("mult").alias("mult")]
    groups = materialize(found.groupBy("seed", "g1", "g2", "size", "piece").agg(*lists), "lists")
    forget(found)

    first = materialize(proposals(first_meetings(groups, classes)).distinct(), "pairs")
    links = materialize(verify(first, docs, n), "links")
    near = connected_components(links, "u", "v")
    rows = materialize(mixed_members(groups, _labelled(classes, near)), "members")
    forget(groups, first)
    pairs = materialize(likeliest_pairs(meeting_cells(rows, near)), "pairs")
    got = verify(pairs.select("a", "b", "u", "v").distinct(), docs, n)
    found, links = links, materialize(links.union(got), "links")
    forget(found, near)
    label = connected_components(links, "u", "v")

    # a group without a possible pair so far has none later
    some = rows.join(pairs.select(F.substring_index("cell", ":", 2).alias("g")).distinct(), "g", "left_semi")
    left = materialize(possible_members(meeting_cells(some, label)), "possible")
    forget(rows, pairs)
    place = materialize(_labelled(classes, label).select("key", "n", "rep", "part"), "places")

    def bring(left: DataFrame, of: Callable, *member) -> DataFrame:
        members = left.join(place, "key")
        sets = whole_sets(docs, members.select(F.col("rep").alias("doc_id")).distinct(), n, of)
        return members.join(sets, "key").groupBy("cell").agg(F.collect_list(F.struct(*member)).alias("members"))

    sharp = bring(left, lambda sets, size: sharp_parities(sets, size), F.lit(0).alias("role"), F.lit(False).alias("skip"), "n", "key", "rep", "part", "tokens")
    last = materialize(possible_members(sharp, fold=True), "possible")
    more = materialize(joining_links(bring(last, lambda sets, size: (sets, size * 8), "rep", "part", "tokens")), "links")
    forget(left, last)
    if not more.isEmpty():
        before, label = label, connected_components(links.union(more), "u", "v")
        forget(before)

    done = _labelled(classes, label).select(F.col("key").alias("_k"), F.col("n").alias("_n"), F.col("part").alias("c"))
    out = known.join(done, (known["key"] == done["_k"]) & (known["n_shingles"] == done["_n"]), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    out = materialize(out.select("doc_id", "n_shingles", component.alias("component_id")), "joined")
    forget(known, classes, links, more, place, label)
    return out
