"""Checks that return violations ``(symbol, ts, rule)`` or say what differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def flag(rows: DataFrame, rules: dict[str, Column], keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """One row for each rule (true: broken) of each row."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return rows.withColumn("rule", F.explode(broken)).select(*keys, "rule")


def assert_clean(violations: DataFrame) -> None:
    if (first := violations.head(1)) != []:
        raise ValueError(f"violated: {first[0].asDict()}")


def bars_sound(bars: DataFrame) -> DataFrame:
    """Order of arrival (``row_seq``), positive finite prices, and highs and lows that hold the others."""
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("row_seq"))
    prices = ("open", "high", "low", "close")
    bad_price = ~(F.greatest(*(F.when(finite(c) & (F.col(c) > 0), 0).otherwise(1) for c in prices)) == 0)
    return flag(
        bars.withColumn("_before", before),
        {
            "not increasing": F.col("_before").isNotNull() & (F.col("ts") <= F.col("_before")),
            "bad price": bad_price,
            "high below low": F.col("high") < F.col("low"),
            "high below body": F.col("high") < F.greatest("open", "close"),
            "low above body": F.col("low") > F.least("open", "close"),
        },
    )


def duplicates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol", "ts").agg(F.count("*").alias("n")).where("n > 1")


def availability(bars: DataFrame, now: int | Column) -> DataFrame:
    """Usable before its end, not later than the bar before, or in the future."""
    before = F.lag("avail_ts").over(Window.partitionBy("symbol").orderBy("ts"))
    return flag(
        bars.withColumn("_before", before),
        {
            "before end": F.col("avail_ts") < F.col("ts"),
            "not increasing": F.col("_before").isNotNull() & (F.col("avail_ts") <= F.col("_before")),
            "future": F.col("avail_ts") > now,
        },
    )


def leakage(rows: DataFrame) -> DataFrame:
    """Rows ``(feature_ts, target_start)`` whose feature came after the target's start."""
    return rows.where(F.col("feature_ts") > F.col("target_start"))


def split_overlap(rows: DataFrame) -> DataFrame:
    """Row ids with more than one role."""
    return rows.groupBy("row_id").agg(F.count_distinct("role").alias("roles")).where("roles > 1")


def split_geometry(rows: DataFrame, gap: int, least: int) -> DataFrame:
    """Per symbol and role: rows, bounds, and whether the role is too small, too near the next, or labelled into it.

    ``rows(symbol, role, idx, ts, target_ts)``.
    """
    roles = rows.groupBy("symbol", "role").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.min("ts").alias("from_ts"), F.max("target_ts").alias("label_end"))
    w = Window.partitionBy("symbol").orderBy("first")
    roles = roles.withColumns({"next_first": F.lead("first").over(w), "next_ts": F.lead("from_ts").over(w)})
    return roles.withColumns(
        {
            "small": F.col("n") < least,
            "near": F.coalesce(F.col("next_first") - F.col("last") - 1 < gap, F.lit(False)),
            "leaks": F.coalesce(F.col("label_end") > F.col("next_ts"), F.lit(False)),
        }
    )


def minutes_continue(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bars that aren't the regular minute after the one before; after a close comes the next open's first minute.

    ``sessions(date, open_ts, close_ts, next_open_ts)``.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.withColumns({"_before": F.lag("ts").over(w), "_avail": F.lag("avail_ts").over(w)})
    s = F.broadcast(sessions.select(F.col("date").alias("_d"), F.col("close_ts").alias("_close"), F.col("next_open_ts").alias("_next")))
    rows = rows.join(s, F.to_date(F.timestamp_seconds("_before")) == F.col("_d"), "left")
    expected = F.when(F.col("_before") < F.col("_close"), F.col("_before") + 60).otherwise(F.col("_next") + 60)
    return flag(
        rows.where("_before is not null"),
        {
            "gap": F.coalesce(F.col("ts") != expected, F.lit(True)),
            "not increasing": F.col("avail_ts") <= F.col("_avail"),
            "late": F.col("_avail") >= F.col("ts"),
        },
    )


def candle_rules(rows: DataFrame) -> DataFrame:
    """Faults of ``(symbol, candle)``, a candle being [time, low, high, open, close, volume]."""
    t, low, high, open_, close = (F.get("candle", F.lit(i)) for i in range(5))
    rows = rows.withColumn("ts", t.cast("long"))
    odd = F.exists("candle", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0))
    return flag(
        rows,
        {
            "length": F.size("candle") != 6,
            "not finite": odd,
            "no time": t == 0,
            "no price": low == 0,
            "bounds": (low > F.least(open_, close)) | (high < F.greatest(open_, close)),
        },
    )


def rate_rules(rows: DataFrame, base: str, quote: str, start: str, end: str) -> DataFrame:
    """Faults of reference rates ``(day, base, quote, rate)``: date, range, pair, value, repeats."""
    day = F.try_to_date("day", "yyyy-MM-dd")
    n = F.count("*").over(Window.partitionBy("day"))
    return flag(
        rows.withColumn("_n", n),
        {
            "bad date": day.isNull(),
            "out of range": F.coalesce(~day.between(start, end), F.lit(False)),
            "other pair": (F.col("base") != base) | (F.col("quote") != quote),
            "bad rate": ~(finite("rate") & (F.col("rate") > 0)),
            "repeated": F.col("_n") > 1,
        },
        ("day",),
    )


def report_sane(returns: DataFrame, periods: float) -> DataFrame:
    """Returns that aren't finite or below -1, and a number of periods that isn't positive."""
    return flag(returns, {"not finite": ~finite("ret"), "below -1": F.col("ret") < -1, "periods": F.lit(not periods > 0)})


def training_contract(rows: DataFrame, features: list[str]) -> DataFrame:
    """Faults of a training table ``(symbol, ts, target_ts, target, feature_set_version, target_horizon, features)``."""
    missing = [c for c in ("symbol", "ts", "target_ts", "target", *features) if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    every = Window.partitionBy("symbol")
    many = lambda c: F.min(c).over(every) != F.max(c).over(every)
    rows = rows.withColumns({"_before": before, "_many": many("feature_set_version") | many("target_horizon")})
    values = [*features, "target"]
    return flag(
        rows,
        {
            "null": F.greatest(*(F.col(c).isNull().cast("int") for c in (*values, "ts", "target_ts"))) == 1,
            "not finite": F.greatest(*((F.isnan(c) | (F.abs(c) == float("inf"))).cast("int") for c in values)) == 1,
            "not increasing": F.coalesce(F.col("ts") <= F.col("_before"), F.lit(False)),
            "target before": F.col("target_ts") <= F.col("ts"),
            "several versions": F.col("_many"),
        },
    )


# The event kinds and what each must carry.
KINDS = {"t": ("p", "size"), "q": ("bp", "ap", "bs", "as_size"), "b": ("o", "h", "l", "c", "v"), "u": ("o", "h", "l", "c", "v"), "c": ("op", "cp"), "x": ("action",)}


def event_rules(records: DataFrame) -> DataFrame:
    """Journal records with the faults of their ``event``: fields of its kind, bounds, alignment, clock."""
    e = lambda c: F.col(f"event.{c}")
    kind, at = e("kind"), F.unix_millis(F.try_to_timestamp(e("time")))
    bar = kind.isin("b", "u")
    positive = lambda *cs: F.greatest(*((F.coalesce(e(c), F.lit(-1.0)) <= 0).cast("int") for c in cs)) == 1
    rules = {
        "unknown kind": ~kind.isin(*KINDS) | kind.isNull(),
        "bad time": at.isNull(),
        "future": at > F.col("received_at_ms") + 5000,
        "bad trade": (kind == "t") & positive("p", "size"),
        "bad quote": (kind == "q") & (positive("bp", "ap") | (F.least(F.coalesce(e("bs"), F.lit(-1.0)), F.coalesce(e("as_size"), F.lit(-1.0))) < 0)),
        "bad bar": bar & (positive("o", "h", "l", "c") | (F.coalesce(e("v"), F.lit(-1.0)) < 0) | (e("h") < F.greatest(e("o"), e("c"))) | (e("l") > F.least(e("o"), e("c")))),
        "unaligned bar": bar & (at % 60_000 != 0),
        "early bar": bar & (F.col("received_at_ms") < at + 60_000),
        "bad correction": (kind == "c") & positive("op", "cp"),
        "bad cancel": (kind == "x") & ~F.coalesce(e("action").isin("C", "E"), F.lit(False)),
    }
    return records.withColumn("faults", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items()))))


def own_checksum() -> Column:
    """The SHA-256 of a record's ``line`` without its checksum."""
    return F.sha2(F.regexp_replace("line", r'"checksum":"[0-9a-f]*",|,"checksum":"[0-9a-f]*"(?=\}$)', ""), 256)


def audit(log: DataFrame) -> DataFrame:
    """One row a session of a hash-chained journal.

    ``log(session_id, seq, previous_checksum, checksum, line, received_at_ms, type,
    feed, symbols, symbol, reason)``, ``line`` being the record's text.  A checksum is
    the SHA-256 of the line without its checksum.  The first record is the session's
    header; market records must have its feed and one of its symbols.  Each record
    meets its predecessor by an equi-join on (session, seq - 1).
    """
    before = log.select("session_id", (F.col("seq") + 1).alias("seq"), F.col("checksum").alias("_sum"), F.col("received_at_ms").alias("_at"), F.col("type").alias("_type"))
    header = log.where("seq = 1").groupBy("session_id").agg(F.first("feed").alias("_feed"), F.first("symbols").alias("_symbols"), F.first("type").alias("_first"))
    rows = log.join(before, ["session_id", "seq"], "left").join(header, "session_id", "left")
    own = own_checksum()
    no = lambda c: ~F.coalesce(c, F.lit(False))
    market = F.col("type") == "market"
    faults = {
        "chain": F.when(F.col("seq") == 1, F.coalesce("previous_checksum", F.lit("")) != "").otherwise(~F.col("previous_checksum").eqNullSafe(F.col("_sum"))),
        "checksum": no(own == F.col("checksum")),
        "clock": no(F.col("received_at_ms") > 0) | F.coalesce(F.col("received_at_ms") < F.col("_at"), F.lit(False)),
        "after stop": F.coalesce(F.col("_type") == "stop", F.lit(False)),
        "header": (F.col("seq") == 1) & no((F.col("type") == "session") & (F.size("symbols") > 0)),
        "type": (F.col("seq") > 1) & no(F.col("type").isin("market", "gap", "stop")),
        "feed": market & no(F.col("feed") == F.col("_feed")),
        "symbol": market & no(F.array_contains("_symbols", F.col("symbol"))),
    }
    rows = rows.withColumn("faults", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in faults.items()))))
    return rows.groupBy("session_id").agg(
        F.count("*").alias("records"),
        F.first("_feed").alias("feed"),
        F.count_if(F.col("type") == "gap").alias("gaps"),
        F.coalesce((F.max_by("type", "seq") == "stop") & (F.max_by("reason", "seq") == "shutdown"), F.lit(False)).alias("clean_shutdown"),
        F.max_by("checksum", "seq").alias("head"),
        F.count_if(F.size("faults") > 0).alias("faults"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("faults")))), ",").alias("kinds"),
        (F.max("seq") != F.count("*")).alias("missing"),
    )


def import_gate(summary: DataFrame, bars: DataFrame) -> DataFrame:
    """Why a session may not be imported: no clean stop, gaps, faults, a test or delayed feed, repeated minutes, no bars.

    ``summary`` as of :func:`audit`, ``bars`` with every publication of a minute.
    """
    n = bars.agg(F.count("*").alias("n"), F.count_distinct("symbol", "ts").alias("d"))
    rows = summary.join(F.broadcast(n))
    return flag(
        rows,
        {
            "no clean stop": ~F.col("clean_shutdown"),
            "gaps": F.col("gaps") > 0,
            "faults": (F.col("faults") > 0) | F.col("missing"),
            "delayed": ~F.coalesce(F.col("feed").isin("iex", "sip"), F.lit(False)),
            "repeated minutes": F.col("n") > F.col("d"),
            "empty": F.col("n") == 0,
        },
        ("session_id",),
    )
