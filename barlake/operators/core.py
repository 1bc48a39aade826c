"""Filters, lookups, top-k, set operations, sampling and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Device names that no portable file name may have.
RESERVED = "CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]"
#: Limits of age in milliseconds.
FRESH = {"trade": 30_000, "minute": 120_000, "snapshot_1m": 180_000, "snapshot_1d": 4 * 86_400_000}


def between(rows: DataFrame, symbol: str, start: int | Column, end: int | Column) -> DataFrame:
    """A symbol's rows of a closed interval, in order of time."""
    return rows.where((F.col("symbol") == symbol) & F.col("ts").between(start, end)).orderBy("ts")


def as_of(rows: DataFrame, ts: int | Column, instruments: list[str]) -> DataFrame:
    return rows.where((F.col("ts") <= ts) & F.col("symbol").isin(instruments))


def ordered(rows: DataFrame, keys: list[str], schema: list[str]) -> DataFrame:
    """Columns in the order of a schema; a missing one is an error, a row with one not finite too."""
    missing = [c for c in schema if c not in rows.columns]
    if missing:
        raise ValueError(f"features are missing: {missing}")
    odd = reduce(lambda a, b: a | b, (F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in schema))
    guard = lambda c: F.when(odd, F.raise_error(F.lit("a feature is not finite")).cast("double")).otherwise(F.col(c)).alias(c)
    return rows.select(*keys, *map(guard, schema))


def regular_minutes(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Minute bars that end on a minute inside a session: after its open, up to its close.

    ``sessions(date, open_ts, close_ts)``, one row a trading day.
    """
    day = F.to_date(F.timestamp_seconds("ts"))
    s = F.broadcast(sessions.select(F.col("date").alias("_d"), "open_ts", "close_ts"))
    hit = bars.join(s, day == F.col("_d"))
    return hit.where((F.col("ts") % 60 == 0) & (F.col("ts") > F.col("open_ts")) & (F.col("ts") <= F.col("close_ts"))).drop("_d", "open_ts", "close_ts")


def fresh(at: Column, now: Column | int, limit: int) -> Column:
    return (F.lit(now) if isinstance(now, int) else now).__sub__(at).between(0, limit)


def freshness(rows: DataFrame, now: int | DataFrame, limit: int) -> DataFrame:
    """How many of the symbols' latest ages are within the limit, and which ones; ``now`` may be a row (now)."""
    last = rows.groupBy("symbol").agg(F.max("at_ms").alias("at_ms"))
    if isinstance(now, DataFrame):
        last, now = last.join(F.broadcast(now)), F.col("now")
    ok = fresh(F.col("at_ms"), now, limit)
    return last.groupBy(ok.alias("fresh")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("symbol")), ",").alias("symbols"))


def provenance(dataset: Column, model: Column, live: Column) -> Column:
    """synthetic if either source says so, rejected unless both are known, else live or recorded_real."""
    made = lambda c: F.lower(F.coalesce(c, F.lit(""))).rlike("synthetic|fixture|mock")
    known = lambda c: ~F.coalesce(c, F.lit("")).isin("", "unknown")
    return F.when(made(dataset) | made(model), "synthetic").when(~known(dataset) | ~known(model), "rejected").when(live, "live").otherwise("recorded_real")


def portable_id(name: Column) -> Column:
    """Whether a name is a portable identifier of at most 128 characters."""
    shape = name.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.\-]{0,127}$") & ~name.rlike(r"\.$")
    return shape & ~F.upper(F.split_part(name, F.lit("."), F.lit(1))).rlike(f"^({RESERVED})$")


def search(catalog: DataFrame, fields: list[str], text: str, exchange: str | None, offset: int = 0, page: int = 50) -> DataFrame:
    """A page of the instruments whose joined fields hold a text, whatever its case.

    Every row also has how many there are, how many the catalogue has and its
    exchanges; an empty page is one row of these with null fields.
    """
    wanted = F.instr(F.lower(F.concat_ws(" ", *fields)), text.strip().lower()[:100]) > 0
    if exchange:
        wanted = wanted & (F.col("exchange") == exchange)
    marks = catalog.agg(F.count_if(wanted).alias("total"), F.count("*").alias("catalog_total"), F.array_join(F.sort_array(F.collect_set("exchange")), ",").alias("exchanges"))
    return marks.join(catalog.where(wanted).orderBy(*fields).offset(offset).limit(page), F.lit(True), "left")


def tradable(products: DataFrame) -> DataFrame:
    """Products that are online and tradable, with a well-formed id and both currencies; the name is the id where there is none."""
    ok = (F.col("status") == "online") & ~F.coalesce("disabled", F.lit(False)) & F.col("id").rlike("^[A-Z0-9]+-[A-Z0-9]+$")
    return products.where(ok & F.col("base").isNotNull() & F.col("quote").isNotNull()).withColumn("name", F.coalesce("name", "id"))


def incompatible(models: DataFrame, datasets: DataFrame, on: list[str]) -> DataFrame:
    """Kinds of models and of datasets of a symbol that differ in some field, and how many there are of each; null equals null.

    Models and datasets alike in all fields are one kind, so pairs are as few as kinds.
    """
    kinds = lambda df, side: df.groupBy("symbol", *on).agg(F.count("*").alias(f"{side}s")).select("symbol", f"{side}s", *(F.col(c).alias(f"{side}_{c}") for c in on))
    both = kinds(models, "model").join(kinds(datasets, "dataset"), "symbol")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"model_{c}").eqNullSafe(F.col(f"dataset_{c}")), F.lit(c)) for c in on)))
    return both.withColumn("differs", F.array_join(differs, ",")).where("differs <> ''")


def recent(rows: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("ts"))
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's last row by the order's columns, later ones first; partial results are merged before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


def book(levels: DataFrame, depth: int = 10) -> DataFrame:
    """Best prices, spread and depth from ``levels(product, side, price, size)``: the top ``depth`` of each side with a size."""
    sign = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy("product", "side").orderBy(sign, "size")
    top = levels.where("size > 0").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= depth)
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    out = top.groupBy("product").agg(
        F.max(F.when(bid, F.col("price"))).alias("best_bid"),
        F.min(F.when(ask, F.col("price"))).alias("best_ask"),
        F.sum(F.when(bid, F.col("size"))).alias("bid_depth"),
        F.sum(F.when(ask, F.col("size"))).alias("ask_depth"),
        F.count("*").alias("levels"),
    )
    return out.withColumn("spread", F.col("best_ask") - F.col("best_bid"))


def candles(rows: DataFrame, limit: int = 300, key: str = "symbol") -> DataFrame:
    """One candle a time, the last to arrive, and of these the newest ``limit``."""
    w = Window.partitionBy(key, "ts").orderBy(F.desc("arrival"))
    one = rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return recent(one, limit, key)


def distinct_decisions(decisions: DataFrame, window: int) -> DataFrame:
    """The newest decision of each (dataset, as_of), and of these each dataset's newest ``window``."""
    one = Window.partitionBy("dataset", "as_of").orderBy(F.desc("seq"))
    few = Window.partitionBy("dataset").orderBy(F.desc("as_of"))
    rows = decisions.withColumn("_k", F.row_number().over(one)).where("_k = 1")
    return rows.withColumn("_k", F.row_number().over(few)).where(F.col("_k") <= window).drop("_k")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the sorted union of their columns; absent ones are null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*sorted(out.columns))


def common_times(panel: DataFrame, keys: DataFrame) -> DataFrame:
    """Times that every symbol of ``keys`` has."""
    n = keys.select(F.count_distinct("symbol").alias("_all"))
    got = panel.join(keys.select("symbol").distinct(), "symbol").groupBy("ts").agg(F.count_distinct("symbol").alias("n"))
    return got.join(F.broadcast(n), F.col("n") == F.col("_all")).select("ts")


def downsample(series: DataFrame, values: list[str], limit: int, key: str = "symbol") -> DataFrame:
    """At most about ``limit`` points: each bucket's first lowest and last highest of every value column, and the two ends.

    Buckets divide the points between the ends evenly.
    """
    w = Window.partitionBy(key)
    rows = series.withColumn("idx", F.row_number().over(w.orderBy("ts")) - 1).withColumn("_n", F.count("*").over(w))
    buckets = max((limit - 2) // (2 * max(len(values), 1)), 1)
    inner = F.col("_n") - 2
    # the last bucket b with b * inner // buckets < idx
    bucket = F.when(F.col("idx").between(1, inner), F.expr(f"(idx * {buckets} + (_n - 2) - 1) DIV (_n - 2) - 1"))
    found = [f(c) for c in values for f in (lambda c: F.min_by("idx", F.struct(F.col(c), F.col("idx"))), lambda c: F.max_by("idx", F.struct(F.col(c), F.col("idx"))))]
    some = rows.where(F.col("_n") > limit).groupBy(key, bucket.alias("b")).agg(F.array(*found).alias("a"), F.collect_list(F.when(bucket.isNull(), F.col("idx"))).alias("ends"))
    keep = some.select(key, F.explode(F.when(F.col("b").isNull(), F.col("ends")).otherwise(F.col("a"))).alias("idx"))
    keep = keep.union(rows.where(F.col("_n") <= limit).select(key, "idx")).distinct().withColumnRenamed(key, "_key").withColumnRenamed("idx", "_idx")
    return rows.join(keep, (F.col(key) == F.col("_key")) & (F.col("idx") == F.col("_idx")), "left_semi").drop("_n")


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page with the total, how many are returned, and its offset."""
    total = rows.agg(F.count("*").alias("total"))
    got = rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))
    return got.withColumns({"offset": F.lit(offset).cast("long"), "returned": F.least(F.lit(limit).cast("long"), F.greatest(F.col("total") - offset, F.lit(0).cast("long")))})


def even_sample(rows: DataFrame, limit: int, key: str = "symbol") -> DataFrame:
    """At most ``limit`` rows of each key, evenly spaced from first to last."""
    w = Window.partitionBy(key)
    rows = rows.withColumn("_i", F.row_number().over(w.orderBy("ts")) - 1).withColumn("_n", F.count("*").over(w))
    m = F.least(F.col("_n"), F.lit(limit))
    # row i is taken if some j < m has floor(j * (n - 1) / (m - 1)) = i: the least j with j * (n - 1) >= i * (m - 1)
    j = F.expr(f"CAST(ceil(_i * (least(_n, {limit}) - 1) / greatest(_n - 1, 1)) AS BIGINT)")
    hit = F.expr(f"(({limit} >= _n) OR (_j * (_n - 1)) DIV greatest(least(_n, {limit}) - 1, 1) = _i)") & (F.col("_j") < m)
    return rows.withColumn("_j", j).where(hit).drop("_i", "_n", "_j")
