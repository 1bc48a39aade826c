"""How five filters interact: what each removes in every order of them.

A to D look at one text.  E, that a smaller doc_id has the identical text, is an
existential self-join: rows whose text's hash occurs more than once are semi-joined
to these texts' smallest ids, on hash, exact text and smaller id.  The ids that fail
E are united with those that fail the others, one bit for each filter, and all that
follows needs only how many documents have each combination of bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

FILTERS = "ABCDE"
E = 16
#: Rows of one text that share a salt: what they meet is that text once for each salt.
COPIES = 256
#: So many hashes of repeated texts are broadcast; beyond them the texts are shuffled.
BROADCAST_HASHES = 1_000_000


def failures(text: Column, words: Column) -> Column:
    """The bits of A to D that a text fails; ``words`` are its words."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [
        n < 50,
        distinct * 100 < n * 65,
        F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 5,
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def described(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, hash, bits)`` of each row: A to D."""
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    rows = docs.withColumn("words", words)
    return rows.select("doc_id", "part", F.xxhash64("text").alias("hash"), failures(F.col("text"), F.col("words")).alias("bits"))


def identical_to_earlier(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(doc_id, part, hash)`` of the rows of ``docs(doc_id, part, text)`` whose text a smaller doc_id has too.

    ``hashes(hash)`` is of all rows.  A row without an id has nothing smaller and is
    smaller than none.  Only texts whose hash repeats are moved.  A text's copies are
    dealt by a salt, and the text with its smallest id goes to each salt.
    """
    repeated = hashes.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1")
    repeated = materialize(repeated, "repeated")
    few = repeated.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    rows = docs.withColumn("hash", F.xxhash64("text")).join(F.broadcast(repeated) if few else repeated, "hash")
    rows = rows.withColumn("salts", F.ceil(F.col("copies") / COPIES).cast("int"))
    texts = rows.groupBy("hash", "text", "salts").agg(F.min("doc_id").alias("least"))
    texts = texts.select("hash", "text", "least", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    a, b = rows.alias("a"), texts.alias("b")
    same = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.text") == F.col("b.text"))
    found = materialize(a.join(b, same & (F.col("b.least") < F.col("a.doc_id")), "left_semi").select("doc_id", "part", "hash"), "identical")
    forget(repeated)
    return found


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, bits, good, toxic, n)``: rows of ``docs(doc_id, text, source)`` by the filters that they fail and their labels.

    A null text is empty, a null source the part ''.  A row without a label, or
    without an id, is neither good nor toxic; an id with several labels is what any
    of them says.
    Rows with one id are judged each; those with one id, part and text are told
    apart by their number alone.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    known = materialize(described(docs), "failures")
    earlier = identical_to_earlier(docs, known.select("hash"))
    key = ["doc_id", "part", "hash"]
    ids = known.select(*key, "bits", F.lit(1).alias("n")).union(earlier.select(*key, F.lit(E), F.lit(0)))
    ids = ids.groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    ids = ids.join(marks, "doc_id", "left")
    counted = ids.groupBy("part", "bits", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))
    counted = materialize(counted, "combinations")
    forget(known, earlier)
    return counted


def _orders() -> list[str]:
    from itertools import permutations

    return ["".join(p) for p in permutations(FILTERS)]


def interactions(counted: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, of ``combinations``.

    Counts of a part's documents: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, and shapley: what the step's filter removes, summed over all orders.
    A part has 32 combinations, so everything is worked out within its row.
    """
    packed = counted.groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )
    packed = packed.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("c"))
    rows = packed.select("part", "c", F.explode(F.array(*map(F.lit, _orders()))).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda i: F.expr(f"shiftleft(1, ascii(substring(filter_order, {i}, 1)) - {ord('A')})")
    own = F.expr(f"shiftleft(1, ascii(substring(filter_order, step, 1)) - {ord('A')})")
    before = sum((F.when(F.col("step") > i, bit(i)).otherwise(0) for i in range(1, len(FILTERS))), F.lit(0))
    rows = rows.withColumns({"own": own.cast("int"), "before": before.cast("int")})

    def total(of: str, which) -> Column:
        return F.aggregate(F.filter("c", which), F.lit(0).cast("long"), lambda s, x: s + x[of])

    fails, earlier = lambda x: x["bits"].bitwiseAND(F.col("own")) != 0, lambda x: x["bits"].bitwiseAND(F.col("before")) != 0
    removed = lambda x: fails(x) & ~earlier(x)
    # a document that fails k filters is removed by each of them in one of k orders
    orders = len(_orders())
    share = F.aggregate(F.filter("c", fails), F.lit(0).cast("long"), lambda s, x: s + x["n"] * F.floor(F.lit(orders) / F.bit_count(x["bits"])))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda x: ~fails(x) & ~earlier(x)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda x: fails(x) & earlier(x)).alias("redundant"),
        total("n", lambda x: x["bits"] == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of all filters over ``docs(doc_id, text, source)`` with ``labels(doc_id, quality, toxic)``.

    An empty table has no part and gives no row; other columns are left out.
    """
    return interactions(combinations(docs, labels))
