"""Joins in time: labels, corporate actions, as-of, outcomes, splices and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def label(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Features with their targets at the same availability; of several targets the last ends latest."""
    one = Window.partitionBy("symbol", "ts").orderBy(F.desc("target_ts"))
    targets = targets.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k")
    return features.join(targets, ["symbol", "ts"])


def adjust(bars: DataFrame, actions: DataFrame, as_of: int | Column, most: int = ordered.MOST) -> DataFrame:
    """Bars with splits and dividends known at ``as_of`` that came into effect after the bar.

    ``actions(symbol, effective_ts, kind, amount)``; ``as_of`` may be a column of
    theirs.  Prices are divided by the product of split ratios, then dividends are
    taken off; volume is multiplied.  A split ratio that isn't positive raises an
    error.  Bars and actions are sorted together, newest first, and each bar takes
    the running sums of the actions before it in that order; a symbol above ``most``
    rows is scanned in cells, to which the totals of all later cells are added.
    """
    bad = (F.col("kind") == "split") & ~(F.col("amount") > 0)
    amount = F.when(bad, F.raise_error(F.lit("a split ratio must be positive")).cast("double")).otherwise(F.col("amount"))
    kept = [c for c in bars.columns if c != "symbol"]
    row = bars.select("symbol", F.col("ts").alias("_at"), F.struct(*kept).alias("_row"), F.lit(0.0).alias("_log"), F.lit(0.0).alias("_paid"))
    news = actions.where(F.col("effective_ts") <= as_of).select(
        "symbol", F.col("effective_ts").alias("_at"), F.lit(None).cast(row.schema["_row"].dataType).alias("_row"),
        F.when(F.col("kind") == "split", F.log(amount)).otherwise(0.0).alias("_log"), F.when(F.col("kind") == "dividend", F.col("amount")).otherwise(0.0).alias("_paid"),
    )
    both = ordered.cells(row.union(news), "symbol", "_at", most)
    both = ordered.carried(both, "symbol", backwards=True, _log_sum=F.sum("_log"), _paid_sum=F.sum("_paid"))
    # a bar comes before the actions of its own time, which are not after it
    newer = Window.partitionBy("symbol", "_cell").orderBy(F.desc("_at"), F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    log = F.sum("_log").over(newer) + F.coalesce("_log_sum", F.lit(0.0))
    paid = F.sum("_paid").over(newer) + F.coalesce("_paid_sum", F.lit(0.0))
    out = both.withColumns({"factor": F.exp(-log), "dividends": paid}).where("_row is not null").select("symbol", "_row.*", "factor", "dividends")
    price = lambda c: (F.col(c) * F.col("factor") - F.col("dividends")).alias(c)
    rest = [c for c in bars.columns if c not in ("open", "high", "low", "close", "volume")]
    return out.select(*rest, *(price(c) for c in ("open", "high", "low", "close")), F.round(F.col("volume") / F.col("factor")).cast("long").alias("volume"))


def deliver(bars: DataFrame, signals: DataFrame, key: str = "symbol", seq: str | None = None, most: int = ordered.MOST) -> DataFrame:
    """Each signal with the first bar strictly after it, never the first bar; the last one per key and bar wins.

    ``bars(key, ts)``, ``signals(key, as_of, ...)``; of equal ``as_of`` the last
    arrival by ``seq`` wins, without it the greatest row.  Both are sorted together,
    newest first, and each signal takes the least time of a bar before it in that
    order.  A key above ``most`` rows is scanned in cells, to which the first bar of
    the later cells is carried.
    """
    rest = [c for c in signals.columns if c not in (key, "as_of")]
    kept = F.struct("as_of", *rest).alias("s")
    first = bars.groupBy(key).agg(F.min("ts").alias("_first"))
    marks = bars.join(first, key).where("ts > _first").select(key, F.col("ts").alias("t"), F.lit(0).alias("kind"), F.col("ts").alias("bar_ts"), F.lit(None).cast(signals.select(kept).schema["s"].dataType).alias("s"))
    news = signals.select(key, F.col("as_of").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("bar_ts"), kept)
    rows = ordered.carried(ordered.cells(marks.union(news), key, "t", most), key, backwards=True, _later_min=F.min("bar_ts"))
    # a signal comes before the bar of its own time, so that it waits for the next one
    newer = Window.partitionBy(key, "_cell").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("bar_ts", F.coalesce(F.min("bar_ts").over(newer), "_later_min")).where("kind = 1 and bar_ts is not null")
    last = F.max_by("s", F.struct("t", f"s.{seq}")) if seq else F.max("s")
    return rows.groupBy(key, "bar_ts").agg(last.alias("s")).select(key, F.col("bar_ts").alias("ts"), "s.*")


def pull(queries: DataFrame, rows: DataFrame, length: int, value: str, key: str = "symbol") -> DataFrame:
    """The last ``length`` values with ts <= as_of, oldest first, for each query (key, as_of); shorter ones are left out."""
    a = rows.select(key, F.col("ts").alias("t"), F.lit(0).alias("kind"), F.col(value).alias("v"))
    b = queries.select(key, F.col("as_of").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(rows.schema[value].dataType).alias("v"))
    w = Window.partitionBy(key).orderBy("t", "kind")
    both = a.union(b).withColumn("n", F.count("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    recent = F.collect_list("v").over(Window.partitionBy(key).orderBy("n").rangeBetween(-(length - 1), 0))
    out = both.withColumn("window", recent).where("kind = 1 and n >= " + str(length))
    return out.select(key, F.col("t").alias("as_of"), "window")


def outcomes(signals: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Signals with the log return over the next ``horizon`` bars and the residual; those without a future bar go."""
    w = Window.partitionBy("symbol").orderBy("ts")
    ahead = bars.select(
        "symbol",
        F.col("avail_ts").alias("as_of"),
        F.lead("avail_ts", horizon).over(w).alias("observed_ts"),
        F.log(F.lead("close", horizon).over(w) / F.col("close")).alias("realized"),
    ).where("observed_ts is not null")
    return signals.join(ahead, ["symbol", "as_of"]).withColumn("residual", F.col("realized") - F.col("expected_return"))


def match_outcomes(decisions: DataFrame, found: DataFrame) -> DataFrame:
    """Each outcome's verdict: ok, orphan, duplicate, early or not finite; ``decision_id`` joins the two."""
    d = decisions.select("decision_id", "as_of", "predicted")
    n = Window.partitionBy("decision_id")
    rows = found.withColumn("_n", F.count("*").over(n)).join(d, "decision_id", "left")
    odd = F.col("realized").isNull() | F.isnan("realized") | (F.abs("realized") == float("inf"))
    verdict = (
        F.when(F.col("as_of").isNull(), "orphan").when(F.col("_n") > 1, "duplicate").when(F.col("observed_ts") <= F.col("as_of"), "early").when(odd, "not finite").otherwise("ok")
    )
    return rows.withColumn("verdict", verdict).drop("_n")


def next_prices(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Open and close of the bar at each row's target time."""
    at = bars.select("symbol", F.col("avail_ts").alias("target_ts"), F.col("open").alias("next_open"), F.col("close").alias("next_close"))
    return rows.join(at, ["symbol", "target_ts"])


def complete_dates(panel: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of times at which every symbol has a row."""
    n = panel.select(F.count_distinct("symbol").alias("_all"))
    full = panel.groupBy(ts).agg(F.count_distinct("symbol").alias("_n")).join(F.broadcast(n), F.col("_n") == F.col("_all")).select(ts)
    return panel.join(full, ts, "left_semi")


def splice(history: DataFrame, live: DataFrame, step: int = 60, sessions: DataFrame | None = None) -> DataFrame:
    """History strictly before the first live bar on both clocks, and the live bars.

    A symbol's history that doesn't reach its first live bar goes whole: its last bar
    must be ``step`` before, or end the session before that whose first bar the live
    one is, and must have been available before the live bar ended.
    ``sessions(close_ts, next_open_ts)``.
    """
    first = live.groupBy("symbol").agg(F.min_by(F.struct(F.col("ts").alias("_t"), F.col("avail_ts").alias("_a")), "ts").alias("f")).select("symbol", "f.*")
    old = history.join(first, "symbol", "left").where("_t is null or (ts < _t and avail_ts < _a)")
    last = old.where("_t is not null").groupBy("symbol", "_t").agg(F.max_by(F.struct("ts", "avail_ts"), "ts").alias("l")).select("symbol", "_t", "l.*")
    follows = F.col("_t") == F.col("ts") + step
    if sessions is not None:
        s = F.broadcast(sessions.select(F.col("close_ts").alias("_close"), F.col("next_open_ts").alias("_next")))
        last = last.join(s, F.col("ts") == F.col("_close"), "left")
        follows = F.when(F.col("_close").isNull(), follows).otherwise(F.col("_t") == F.col("_next") + step)
    gap = last.where(~F.coalesce(follows & (F.col("avail_ts") < F.col("_t")), F.lit(False))).select("symbol")
    return old.join(gap, "symbol", "left_anti").drop("_t", "_a").unionByName(live)


#: The sectors and their other names.
SECTORS = {
    "technology": "Technology", "tech": "Technology", "financials": "Financials", "fin": "Financials", "healthcare": "Healthcare", "health": "Healthcare",
    "consumerdiscretionary": "ConsumerDiscretionary", "discretionary": "ConsumerDiscretionary", "consumerstaples": "ConsumerStaples", "staples": "ConsumerStaples",
    "energy": "Energy", "industrials": "Industrials", "materials": "Materials", "utilities": "Utilities", "realestate": "RealEstate", "reit": "RealEstate",
    "communicationservices": "CommunicationServices", "communication": "CommunicationServices", "telecom": "CommunicationServices",
}


def sector(name: Column, names: dict[str, str] = SECTORS) -> Column:
    """A sector's usual name; another one stays, in lower case; null is Unassigned."""
    table = F.create_map(*(F.lit(v) for kv in names.items() for v in kv))
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.lower(name), F.lit("Unassigned"))


def with_sector(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """Rows with their symbol's sector, Unassigned where the map ``sectors(symbol, sector)`` has none."""
    return rows.join(sectors, "symbol", "left").withColumn("sector", sector(F.col("sector")))


def latest_price(rows: DataFrame, bars: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Rows with their symbol's last close, 1 where there is none, not below ``floor``."""
    price = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    return rows.join(price, "symbol", "left").withColumn("price", F.greatest(F.coalesce("price", F.lit(1.0)), F.lit(floor)))
