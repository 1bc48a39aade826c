"""Streams over landed journal files: parsing, minute bars, buffers, prices, accounting."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import core, dq, joins
from ..sources.io import JOURNAL, minute_bars, parse_event

BUFFER = "symbol string, ts bigint, close double, size int"


def records(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    return parse_event(spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files_a_batch).json(path))


def good_and_bad(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Market records without and with faults."""
    checked = dq.event_rules(rows.where("type = 'market'"))
    return checked.where(F.size("faults") == 0), checked.where(F.size("faults") > 0)


def bars(rows: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Minute bars, the first publication of each; later ones of a minute are dropped, those after the watermark too."""
    out = minute_bars(rows).withColumn("at", F.timestamp_seconds("ts"))
    if out.isStreaming:
        return out.withWatermark("at", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])
    return out.dropDuplicates(["symbol", "ts"])


def regular(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Minute bars of regular sessions with ``next_ts``, the minute that must follow: after a close, the first of the next session.

    ``sessions`` as of :func:`calendar.sessions`, a static table.
    """
    hit = core.regular_minutes(rows, sessions)
    s = F.broadcast(sessions.select(F.col("date").alias("_d"), F.col("close_ts").alias("_close"), F.col("next_open_ts").alias("_next")))
    hit = hit.join(s, F.to_date(F.timestamp_seconds("ts")) == F.col("_d"))
    return hit.withColumn("next_ts", F.when(F.col("ts") < F.col("_close"), F.col("ts") + 60).otherwise(F.col("_next") + 60)).drop("_d", "_close", "_next")


def advance(kept: list, new: Iterable, limit: int) -> list:
    """A buffer of bars (ts, ..., avail_ms, next_ts) after ``new`` ones, in order of arrival.

    A bar not later than the last is ignored.  One that isn't the minute due next,
    that ended before the last was available, or that isn't available later than it
    clears the buffer first.
    """
    kept = list(kept)
    for bar in new:
        if kept:
            ts, avail, due = kept[-1][0], kept[-1][-2], kept[-1][-1]
            if bar[0] <= ts:
                continue
            if bar[0] != due or avail >= bar[0] * 1000 or bar[-2] <= avail:
                kept = []
        kept.append(bar)
    return kept[-limit:]


class BarBuffer(StatefulProcessor):
    """The newest bars since a symbol's last gap, as :func:`advance` has them."""

    LIMIT = 300

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "ts bigint, close double, avail bigint, next bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["avail_ms", "ts"])
        new = ((int(r.ts), float(r.close), int(r.avail_ms), int(r.next_ts) if pd.notna(r.next_ts) else -1) for r in rows.itertuples())
        kept = advance([tuple(r) for r in self.rows.get()], new, self.LIMIT)
        self.rows.put(kept)
        if kept:
            yield pd.DataFrame({"symbol": [key[0]], "ts": [kept[-1][0]], "close": [kept[-1][1]], "size": [len(kept)]})

    def close(self) -> None:
        pass


def buffered(stream: DataFrame) -> DataFrame:
    """The state of each symbol's buffer after a batch of ``regular`` bars; needs the RocksDB state store."""
    rows = stream.select("symbol", "ts", "close", "avail_ms", "next_ts")
    return rows.groupBy("symbol").transformWithStateInPandas(statefulProcessor=BarBuffer(), outputStructType=BUFFER, outputMode="Update", timeMode="None")


def buffer_rows(rows: DataFrame, limit: int = 300) -> DataFrame:
    """The buffers' bars from all ``regular`` bars at once, by windows alone."""
    arrival = Window.partitionBy("symbol").orderBy("avail_ms", "ts")
    best = F.max("ts").over(arrival.rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumn("_best", best).where("_best is null or ts > _best").drop("_best")
    w = Window.partitionBy("symbol").orderBy("ts")
    before = {c: F.lag(c).over(w) for c in ("ts", "avail_ms", "next_ts")}
    gap = ~F.coalesce(before["next_ts"] == F.col("ts"), F.lit(False)) | (before["avail_ms"] >= F.col("ts") * 1000) | (F.col("avail_ms") <= before["avail_ms"])
    cut = F.when(before["ts"].isNotNull() & gap, F.col("ts"))
    out = kept.withColumn("_c", cut).withColumn("_c", F.max("_c").over(Window.partitionBy("symbol"))).where("_c is null or ts >= _c").drop("_c")
    return core.recent(out, limit)


def batch_buffer(rows: DataFrame, limit: int = 300) -> DataFrame:
    """The state of each symbol's buffer from all bars at once."""
    return buffer_rows(rows, limit).groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"), F.count("*").cast("int").alias("size"))


def latest_bars(rows: DataFrame) -> DataFrame:
    """The last regular bar of each symbol."""
    return core.latest(rows, "symbol", ["ts", "avail_ms"])


#: Feeds without delay.
FEEDS = ("iex", "sip")


def live_inputs(live: DataFrame, history: DataFrame, symbols: DataFrame, status: str, feed: str, now_ms: int, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(bars, refused)``: the bars from which each of ``symbols`` may be forecast, and (symbol, reason) of those that may not.

    ``live(symbol, ts, ..., avail_ms, next_ts)`` are the buffers' bars,
    ``history`` the stored ones.  The feed must be connected and undelayed, a buffer
    filled and its last bar at most two minutes old on both clocks; history that
    doesn't reach the buffer goes; what is left must be sound, regular, available in
    time and without a gap.
    """
    step = Window.partitionBy("symbol").orderBy("ts")
    as_of = lambda df: df.withColumn("avail_ts", F.col("avail_ms") / 1000.0)
    both = joins.splice(as_of(history.drop("next_ts")), as_of(live.drop("next_ts")), 60, sessions).drop("avail_ts")
    both = regular(both.join(symbols.select("symbol"), "symbol"), sessions) if status == "connected" and feed in FEEDS else both.limit(0).withColumn("next_ts", F.lit(None).cast("long"))
    lag = lambda c: F.lag(c).over(step)
    odd = dq.bars_sound(both.withColumn("row_seq", F.col("ts"))).select("symbol").distinct().withColumn("unsound", F.lit(True))
    early = F.col("avail_ms") < F.col("ts") * 1000
    gap = lag("ts").isNotNull() & (~F.coalesce(lag("next_ts") == F.col("ts"), F.lit(False)) | (lag("avail_ms") >= F.col("ts") * 1000))
    rows = both.withColumns({"_odd": early | (F.col("avail_ms") > now_ms), "_gap": gap})
    fresh = lambda c: core.fresh(c, now_ms, core.FRESH["minute"])
    of = rows.groupBy("symbol").agg(F.max("_odd").alias("odd"), F.max("_gap").alias("gap"))
    last = live.groupBy("symbol").agg((fresh(F.max("ts") * 1000) & fresh(F.max("avail_ms"))).alias("fresh"))
    seen = symbols.select("symbol").distinct().join(last, "symbol", "left").join(of, "symbol", "left").join(odd, "symbol", "left")
    reason = (
        F.when(F.lit(status != "connected"), "not connected")
        .when(F.lit(feed not in FEEDS), "delayed feed")
        .when(F.col("fresh").isNull(), "no bar yet")
        .when(~F.col("fresh"), "stale")
        .when(F.col("unsound"), "unsound")
        .when(F.coalesce("odd", F.lit(True)), "availability")
        .when(F.col("gap"), "gap")
    )
    refused = seen.select("symbol", reason.alias("reason")).where("reason is not null")
    return both.join(refused.select("symbol"), "symbol", "left_anti"), refused


def latest_prices(rows: DataFrame) -> DataFrame:
    """Last trade of each symbol; of equal times the later arrival."""
    t = rows.where("event.kind = 't'")
    return t.groupBy(F.col("event.symbol").alias("symbol")).agg(F.max_by("event.p", F.struct(F.try_to_timestamp("event.time"), "received_at_ms", "seq")).alias("price"))


def accounting(rows: DataFrame) -> DataFrame:
    """Records, gaps and stops of each session."""
    return rows.groupBy("session_id").agg(F.count("*").alias("records"), F.count_if(F.col("type") == "gap").alias("gaps"), F.count_if(F.col("type") == "stop").alias("stops"))


def monitored(decisions: DataFrame, outcomes: Callable[[], DataFrame], reference: DataFrame, path: str, history: str, checkpoint: str, window: int = 100, identity: dict[str, str] | None = None):
    """The drift status after each batch of decisions, in ``path`` by batch.

    ``history`` keeps, by batch, each dataset's newest ``window`` distinct decisions
    that count; a batch joins those of the one before, so what is read stays small.
    Both are written by batch number, so a batch that is tried again replaces its own.
    """
    from ..operators.metrics import counted, monitor

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = counted(batch, identity)
        if number:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{history}/{number - 1}"))
        core.distinct_decisions(rows, window).select(*batch.columns).write.mode("overwrite").parquet(f"{history}/{number}")
        now = spark.read.schema(batch.schema).parquet(f"{history}/{number}")
        monitor(now, outcomes(), reference, window, identity).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return decisions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
