"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest rate of one draw, as e**-rate must stay a normal double; a larger one is the sum of several draws.
MAX_RATE = 500.0
#: Copies of a row that are laid out at once.
BLOCK = 65_536
#: A table of this many sources is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """``(source, size, rate, draws, cdf)``: mean repetitions of each source's documents.

    A source's size is its number of code points.  Its target share is its given
    weight, or the power ``alpha`` of its size if no weights are given (sources
    without a weight get none); rate = share * epochs * total size / size.  A null
    source is the source "".  A source of size 0 keeps the rate 0.  A rate is the sum
    of ``draws`` equal ones of MAX_RATE at most; ``cdf`` holds the cumulated Poisson
    probabilities of one of them up to where they reach 1.
    """
    size = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(
        F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size")
    )
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(alpha))
    else:
        table = F.create_map([x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        share = F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0.0))
    size = size.withColumn("w", share)
    total = size.agg(F.sum("size").alias("all_size"), F.sum("w").alias("all_w"))
    rate = F.when(F.col("size") > 0, F.col("w") / F.col("all_w") * epochs * F.col("all_size") / F.col("size")).otherwise(0.0)
    rates = size.join(F.broadcast(total)).select("source", "size", rate.alias("rate"))
    rates = rates.withColumn("draws", F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int"))
    each = F.col("rate") / F.col("draws")
    last = F.ceil(each + 12 * F.sqrt(each) + 40).cast("int")
    start = F.exp(-each)
    steps = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(start.alias("term"), F.array(start).alias("cdf")),
        lambda a, k: F.struct(
            (a["term"] * each / k).alias("term"),
            F.array_append(a["cdf"], F.element_at(a["cdf"], -1) + a["term"] * each / k).alias("cdf"),
        ),
    )
    return rates.withColumn("cdf", steps["cdf"])


def uniform(*parts) -> F.Column:
    """A double in [0, 1) from 52 bits of an md5; the same in any SQL engine."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """Every column of ``docs`` and ``copy``, ``shuffle_key``: each row as often as drawn.

    The number of copies inverts the Poisson distribution of the source's rate at
    a uniform number hashed from seed and doc_id: it is the same at every run, and
    rows with equal ids get equal counts; a row without an id is drawn by its text.
    A rate above MAX_RATE is drawn as a sum of independent Poisson numbers of
    smaller equal rates, which has the same distribution; each has its own uniform
    number.  A row drawn 0 times goes; an empty or null text counts with its
    source's rate.  Rows then go to partitions by a hash of (seed, doc_id, copy) and
    are ordered by it there: a global shuffle in which no source stays together.
    Columns named like the added ones are replaced; any others are kept.
    """
    keep = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    rates = source_rates(docs, weights, alpha, epochs).select("source", "draws", "cdf")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), text))
    own = [f"c{k}" for k in range(len(keep))]  # the columns of docs travel under names that nothing else has
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, own)), name.alias("name"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    drawn = rows.join(rates, "source").withColumn("u", uniform(F.lit(seed), "name"))
    more = F.transform(F.sequence(F.lit(2), F.col("draws")), lambda k: uniform(F.lit(seed), "name", F.lit("draw"), k.cast("string")))
    rest = F.aggregate(more, F.lit(0), lambda n, x: n + F.size(F.filter("cdf", lambda c: x >= c)))
    first = F.size(F.filter("cdf", lambda c: F.col("u") >= c))
    drawn = drawn.withColumn("n", first + F.when(F.col("draws") > 1, rest).otherwise(0)).where("n > 0").select(*own, "name", "n")
    blocks = drawn.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {BLOCK}").cast("int"))))
    within = F.sequence(F.col("block") * BLOCK + 1, F.least(F.col("n"), (F.col("block") + 1) * BLOCK))
    copies = blocks.select(*own, "name", F.explode(within).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), "name", F.col("copy").cast("string")).cast("binary"))
    copies = copies.select(*own, "copy", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return copies.select(*(F.col(k).alias(c) for c, k in zip(keep, own)), "copy", "shuffle_key")
