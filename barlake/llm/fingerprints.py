"""Document fingerprints by invertible Bloom lookup sketches, with built-in functions only.

A text is the set of the hashes of its paragraph pieces.  Each piece's hash goes
to one cell of each of three rows of a sketch; a cell keeps how many hashes it
got, their xor and the xor of their check hashes.  The sketch as a string is the
fingerprint; it is read back, and one is subtracted from the other, which leaves
the pieces in which the two texts differ.  A cell with one of them left shows it
(its check fits); taking it out of its other cells frees more.  If peeling stops
before all cells are empty, the difference is too large for sketches of that size:
larger ones are built in the same way, first of both texts, with a group of cells
for every few pieces, then of the groups that still couldn't be peeled, until none
is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize

#: Longest piece of a paragraph, in code points.
PIECE = 240
#: Cells a row of a fingerprint, and so of a group of a larger one.
WIDTH = 8
#: Pieces of both texts that a group holds on average.
GROUP = 6
#: Rounds of peeling; all cells that show a piece are used in a round.
ROUNDS = 8
CELL = "struct<n:bigint,k:bigint,h:bigint>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digests(text: Column) -> Column:
    """The distinct hashes of a text's pieces: paragraphs, cut every PIECE code points from their beginning."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^\n]{1,%d}" % PIECE), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda x: F.xxhash64(x)))


def place(key: Column, row: int, width: int) -> Column:
    """The cell of a key in a row, counted over all rows."""
    return F.pmod(F.xxhash64(key, F.lit(row), F.lit(width)), F.lit(width)).cast("int") + row * width


def check(key: Column) -> Column:
    """A second hash of a key, of 32 bits."""
    return F.xxhash64(key, F.lit(-1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _xor(items: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(of(x)))


def _spots(keys: Column, width: int) -> Column:
    return F.transform(keys, lambda x: F.struct(x.alias("k"), check(x).alias("h"), *(place(x, r, width).alias(f"p{r}") for r in range(3))))


def sketch(keys: Column, width: int = WIDTH) -> Column:
    """Three rows of ``width`` cells (n, k, h) of an array of hashes."""
    cell = lambda own: F.struct(F.size(own).cast("long").alias("n"), _xor(own, lambda x: x["k"]).alias("k"), _xor(own, lambda x: x["h"]).alias("h"))
    row = lambda spots, r: F.transform(F.sequence(F.lit(r * width), F.lit(r * width + width - 1)), lambda c: let(F.filter(spots, lambda x: x[f"p{r}"] == c), cell))
    return let(_spots(keys, width), lambda spots: F.concat(*(row(spots, r) for r in range(3))))


def as_text(cells: Column) -> Column:
    """A sketch as a string: per cell its number and, unless all are zero, its two sums in hexadecimal."""
    plain = lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0)
    full = lambda c: F.concat_ws(":", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["h"]))
    return F.array_join(F.transform(cells, lambda c: F.when(plain(c), F.lit("0")).otherwise(full(c))), ",")


def read_text(fingerprint: Column) -> Column:
    """The cells of a fingerprint."""
    number = lambda x: F.conv(x, 16, -10).cast("long")
    zero = F.lit(0).cast("long")
    cell = lambda p: F.struct(number(p[0]).alias("n"), number(p[1]).alias("k"), number(p[2]).alias("h"))
    none = F.struct(zero.alias("n"), zero.alias("k"), zero.alias("h"))
    return F.transform(F.split(fingerprint, ","), lambda c: F.when(c == "0", none).otherwise(let(F.split(c, ":"), cell)))


def subtract(a: Column, b: Column) -> Column:
    """The cells of a less those of b."""
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(cells: Column, width: int = WIDTH) -> Column:
    """(ok, p, q) of a difference of sketches: whether it could be emptied, and how many hashes are in the first only and in the second only."""
    zero = F.lit(0).cast("long")
    state = F.struct(cells.cast(f"array<{CELL}>").alias("c"), zero.alias("p"), zero.alias("q"))

    def take(s: Column, pure: Column) -> Column:
        mine = lambda x, i: (x["p0"] == i) | (x["p1"] == i) | (x["p2"] == i)
        less = lambda c, own: F.struct(
            (c["n"] - F.aggregate(own, zero, lambda t, x: t + x["n"])).alias("n"), c["k"].bitwiseXOR(_xor(own, lambda x: x["k"])).alias("k"), c["h"].bitwiseXOR(_xor(own, lambda x: x["h"])).alias("h")
        )
        cells = F.transform(s["c"], lambda c, i: let(F.filter(pure, lambda x: mine(x, i)), lambda own: F.when(F.size(own) == 0, c).otherwise(less(c, own))))
        more = F.size(F.filter(pure, lambda x: x["n"] > 0)).cast("long")
        return F.struct(cells.alias("c"), (s["p"] + more).alias("p"), (s["q"] + F.size(pure) - more).alias("q"))

    def shown(s: Column) -> Column:
        alone = F.filter(s["c"], lambda c: (F.abs(c["n"]) == 1) & (check(c["k"]) == c["h"]))
        keys = F.array_distinct(F.transform(alone, lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n"), c["h"].alias("h"))))
        return F.transform(keys, lambda x: F.struct(x["k"].alias("k"), x["n"].alias("n"), x["h"].alias("h"), *(place(x["k"], r, width).alias(f"p{r}") for r in range(3))))

    step = lambda s, _: let(shown(s), lambda pure: F.when(F.size(pure) == 0, s).otherwise(take(s, pure)))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, step)
    empty = lambda s: ~F.exists(s["c"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0))
    return let(last, lambda s: F.struct(empty(s).alias("ok"), s["p"].alias("p"), s["q"].alias("q")))


def differences(a: Column, b: Column) -> Column:
    """(ok, p, q) of two fingerprints, from the strings alone."""
    return let(F.struct(read_text(a).alias("a"), read_text(b).alias("b")), lambda x: peel(subtract(x["a"], x["b"])))


def pieces_of(fingerprint: Column) -> Column:
    """How many hashes a fingerprint holds: the sum over its first row."""
    return F.aggregate(F.slice(read_text(fingerprint), 1, WIDTH), F.lit(0).cast("long"), lambda t, c: t + c["n"])


def larger_differences(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, p, q of ``rows(keys, a, b)``, arrays of hashes: by sketches with a group of cells for every GROUP hashes.

    b's cells are subtracted from a's by adding them with the opposite sign.  The
    groups that can't be peeled are built again, four times as wide, until all
    are.  One shuffle, of hashes; the work is proportional to them.
    """
    groups = F.greatest(F.ceil((F.size("a") + F.size("b")) / GROUP), F.lit(1)).cast("long")
    rows = rows.withColumn("groups", groups).repartition(*keys)
    side = lambda c, sign: F.transform(c, lambda x: F.struct(x.alias("k"), F.lit(sign).cast("long").alias("n")))
    items = rows.select(*keys, "groups", F.explode_outer(F.concat(side("a", 1), side("b", -1))).alias("x"))
    items = items.select(*keys, F.coalesce(F.pmod(F.shiftright("x.k", 3), F.col("groups")), F.lit(0)).alias("group"), F.col("x.k").alias("k"), F.col("x.n").alias("n"))
    out, width = None, WIDTH
    while True:
        spots = F.array(*(place(F.col("k"), r, width) for r in range(3)))
        cells = items.select(*keys, "group", "k", "n", check(F.col("k")).alias("h"), F.explode(F.coalesce(spots, F.array(F.lit(0)))).alias("at"))
        cells = cells.groupBy(*keys, "group", "at").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bit_xor("k"), F.lit(0)).alias("k"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("h"))
        met = cells.groupBy(*keys, "group").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("n", "k", "h")))).alias("m"))
        zero = F.lit(0).cast("long")
        none = F.struct(zero.alias("n"), zero.alias("k"), zero.alias("h"))
        whole = F.transform(F.sequence(F.lit(0), F.lit(3 * width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), none))
        got = materialize(met.select(*keys, "group", peel(whole, width).alias("d")).select(*keys, "group", "d.*"), "peeled")
        done = got.where("ok").select(*keys, "p", "q")
        out = done if out is None else out.union(done)
        stuck = got.where("not ok").select(*keys, "group")
        if stuck.isEmpty():
            return out.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        items, width = items.join(stuck, [*keys, "group"], "left_semi"), width * 4


def next_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, following)``: each row with the text of the next in order of (doc_id, text), the first after the last.

    Rows are dealt to ranges of ids (null ids first); the first row of each range
    also goes to the range before it, so no range waits for another and the texts
    are shuffled once.  Only one id per range reaches the driver.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(least))
    n = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 20 * n)).first()[0] or []
    bounds = F.array(*(F.lit(c).cast("long") for c in sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("range", F.size(F.filter(bounds, lambda b: b < key)))
    heads = sorted((r["range"], r["id"]) for r in rows.groupBy("range").agg(F.min(key).alias("id")).collect())
    before = {r: heads[i - 1][0] for i, (r, _) in enumerate(heads)}
    first = rows.where(key.isin([i for _, i in heads])).groupBy("range").agg(F.min(F.struct(key.alias("k"), "doc_id", "text")).alias("x"))
    if before:
        to = F.element_at(F.create_map(*(F.lit(x) for r, b in before.items() for x in (r, b))), F.col("range"))
        first = first.select("x.doc_id", "x.text", to.cast("int").alias("range"), F.lit(True).alias("ghost"))
        rows = rows.withColumn("ghost", F.lit(False)).union(first)
    else:
        rows = rows.withColumn("ghost", F.lit(False))
    w = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    return rows.withColumn("following", F.lead("text").over(w)).where("not ghost").select("doc_id", "text", "following")


def compare_versions(rows: DataFrame, text: str, versions: dict[str, str]) -> DataFrame:
    """``rows`` without the texts, and the fingerprints and likenesses of the text and each version.

    Adds ``fingerprint`` of ``text``, and ``fingerprint_<name>`` and
    ``near_<name>`` of every version: shared pieces over all pieces of the two, 1
    for two texts without pieces.  Null texts are empty; equal texts have equal
    fingerprints and likeness 1.  Every row, repeated or without an id, is compared
    by itself; an empty table gives an empty one.  Columns with the added names are
    replaced.
    """
    cols = {"": text, **{f"_{k}": v for k, v in versions.items()}}
    added = {f"{x}{k}" for k in cols for x in ("fingerprint", "near")}
    keep = [c for c in rows.columns if c not in cols.values() and c not in added]
    own = F.struct(*keep) if keep else F.struct(F.lit(0))
    rows = rows.select(own.alias("row"), *(digests(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"d{k}") for k, c in cols.items()))
    rows = rows.select("*", *(as_text(sketch(F.col(f"d{k}"))).alias(f"fingerprint{k}") for k in cols))
    rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()), "fingerprints")
    both = [F.struct(F.lit(k).alias("version"), F.col("fingerprint").alias("x"), F.col(f"fingerprint{k}").alias("y")) for k in cols if k]
    tried = rows.select("id", F.explode(F.array(*both)).alias("v")).select("id", "v.version", differences(F.col("v.x"), F.col("v.y")).alias("d"))
    tried = materialize(tried.select("id", "version", "d.*"), "differences")
    which = [F.struct(F.lit(k).alias("version"), F.col(f"d{k}").alias("b")) for k in cols if k]
    rest = rows.select("id", F.col("d").alias("a"), F.explode(F.array(*which)).alias("v")).select("id", "v.version", "a", "v.b")
    rest = rest.join(tried.where("not ok").select("id", "version"), ["id", "version"], "left_semi")
    found = tried.where("ok").select("id", "version", "p", "q").union(larger_differences(rest, ["id", "version"]))
    of = lambda k, c: F.max(F.when(F.col("version") == k, F.col(c))).alias(f"{c}{k}")
    found = found.groupBy("id").agg(*(of(k, c) for k in cols if k for c in "pq"))
    rows = rows.drop(*(f"d{k}" for k in cols)).join(found, "id").withColumn("n", pieces_of(F.col("fingerprint")))
    near = [F.when(F.col("n") + F.col(f"q{k}") == 0, 1.0).otherwise((F.col("n") - F.col(f"p{k}")) / (F.col("n") + F.col(f"q{k}"))).alias(f"near{k}") for k in cols if k]
    return rows.select(*(F.col("row")[c].alias(c) for c in keep), *(f"fingerprint{k}" for k in cols), *near)
