"""Stateful stream operators: forecasts with their gates, readiness by the clock, journal chains.

Each keeps what it needs by key in the state store, so a query that is started again
goes on where it was, and what it says equals the batch operator over all that landed.
All need the RocksDB state store.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import core, dq
from . import live

BAR = "ts bigint, open double, high double, low double, close double, volume bigint, avail_ms bigint, next_ts bigint"
FORECAST = "symbol string, ts bigint, avail_ms bigint, n int, closes array<double>, reason string"
READY = "symbol string, kind string, at_ms bigint, received_at_ms bigint, fresh boolean, told_at_ms bigint"
CHAIN = "session_id string, records bigint, feed string, gaps bigint, clean_shutdown boolean, head string, faults bigint, kinds string, missing boolean"


class Bar(NamedTuple):
    ts: int
    open: float
    high: float
    low: float
    close: float
    volume: int
    avail_ms: int
    next_ts: int

    def sound(self) -> bool:
        prices = (self.open, self.high, self.low, self.close)
        return all(0 < p < float("inf") for p in prices) and self.high >= max(self.open, self.close) and self.low <= min(self.open, self.close)


def window(stored: list[Bar], buffer: list[Bar]) -> list[Bar]:
    """The stored bars before the buffer on both clocks, if they reach it, and the buffer."""
    first = buffer[0]
    old = [b for b in stored if b.ts < first.ts and b.avail_ms < first.avail_ms]
    if old and not (old[-1].next_ts == first.ts and old[-1].avail_ms < first.ts * 1000):
        old = []
    return old + buffer


def refusal(bars: list[Bar], buffer: list[Bar], now_ms: int) -> str | None:
    """Why no forecast may be made of the bars, as :func:`live.live_inputs` has it."""
    fresh = lambda at: 0 <= now_ms - at <= core.FRESH["minute"]
    if not (fresh(max(b.ts for b in buffer) * 1000) and fresh(max(b.avail_ms for b in buffer))):
        return "stale"
    if not all(b.sound() for b in bars):
        return "unsound"
    if any(b.avail_ms < b.ts * 1000 or b.avail_ms > now_ms for b in bars):
        return "availability"
    if any(b.ts != a.next_ts or a.avail_ms >= b.ts * 1000 for a, b in zip(bars, bars[1:])):
        return "gap"
    return None


class ForecastInputs(StatefulProcessor):
    """A symbol's buffer behind its stored history, and whether it may be forecast.

    The history is the operator's initial state.  ``now_ms`` stands for the clock in
    tests and replays.
    """

    def __init__(self, refused: str | None, now_ms: int | None, limit: int) -> None:
        self.refused, self.now_ms, self.limit = refused, now_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored, self.buffer = handle.getListState("stored", BAR), handle.getListState("buffer", BAR)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        # a key's rows may come in several calls
        self.stored.put(sorted([tuple(b) for b in self.stored.get()] + [tuple(b) for b in bars_of(initialState)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = bars_of(pd.concat(list(rows)).sort_values(["avail_ms", "ts"]))
        buffer = live.advance([Bar(*b) for b in self.buffer.get()], new, self.limit)
        self.buffer.put([tuple(b) for b in buffer])
        if buffer:
            bars = window([Bar(*b) for b in self.stored.get()], buffer)
            now = self.now_ms if self.now_ms is not None else int(time.time() * 1000)
            reason = self.refused or refusal(bars, buffer, now)
            yield pd.DataFrame({"symbol": [key[0]], "ts": [buffer[-1].ts], "avail_ms": [buffer[-1].avail_ms], "n": [len(bars)], "closes": [[b.close for b in bars]], "reason": [reason]})

    def close(self) -> None:
        pass


def bars_of(rows: pd.DataFrame) -> list[Bar]:
    return [Bar(int(r.ts), float(r.open), float(r.high), float(r.low), float(r.close), int(r.volume), int(r.avail_ms), -1 if pd.isna(r.next_ts) else int(r.next_ts)) for r in rows.itertuples()]


def gate(status: str, feed: str) -> str | None:
    """What the connection itself says."""
    return "not connected" if status != "connected" else "delayed feed" if feed not in live.FEEDS else None


def forecast_inputs(stream: DataFrame, history: DataFrame, status: str, feed: str, now_ms: int | None = None, limit: int = live.BarBuffer.LIMIT) -> DataFrame:
    """``FORECAST`` rows, one a symbol and batch: its closes from stored history to the last bar, and why it may not be forecast.

    ``stream`` are ``live.regular`` bars, ``history`` the stored ones, a static table
    of the newest bars of each symbol; it is read once, when the query first starts.
    """
    columns = ["symbol", "ts", "open", "high", "low", "close", "volume", "avail_ms", "next_ts"]
    newest = core.recent(history.select(*columns), limit)
    return stream.select(*columns).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=ForecastInputs(gate(status, feed), now_ms, limit), outputStructType=FORECAST, outputMode="Update", timeMode="None", initialState=newest.groupBy("symbol")
    )


def forecasts(inputs: DataFrame, score, least: int = 35) -> DataFrame:
    """``inputs`` with ``forecast``: ``score`` of the last ``least`` closes, a column of theirs, where nothing forbids it.

    A symbol with fewer closes is refused as ``short``; so each row has a forecast or a reason.
    """
    reason = F.coalesce("reason", F.when(F.col("n") < least, "short"))
    rows = inputs.withColumn("reason", reason).withColumn("closes", F.slice("closes", -F.least(F.col("n"), F.lit(least)), least))
    return rows.withColumn("forecast", F.when(F.col("reason").isNull(), score(F.col("closes"))))


def batch_forecast_inputs(rows: DataFrame, history: DataFrame, status: str, feed: str, now_ms: int, sessions: DataFrame, limit: int = live.BarBuffer.LIMIT) -> DataFrame:
    """What :func:`forecast_inputs` says last of each symbol, from all bars at once."""
    buffers = live.buffer_rows(rows, limit)
    symbols = rows.select("symbol").distinct()
    newest = core.recent(history, limit)
    bars, refused = live.live_inputs(buffers, newest, symbols, status, feed, now_ms, sessions)
    lists = bars.groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "close"))), lambda x: x["close"]).alias("closes"))
    last = buffers.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max("avail_ms").alias("avail_ms"))
    return last.join(lists, "symbol", "left").join(refused, "symbol", "left").select("symbol", "ts", "avail_ms", F.size("closes").alias("n"), "closes", "reason")


class Freshness(StatefulProcessor):
    """Tells when a symbol becomes fresh and, by a timer, when it has become stale without a new record."""

    def __init__(self, limits: dict[str, int]) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms bigint, received_at_ms bigint, fresh boolean")

    def told(self, key, at: int, received: int, fresh: bool, now: int) -> pd.DataFrame:
        self.last.update((at, received, fresh))
        return pd.DataFrame({"symbol": [key[0]], "kind": [key[1]], "at_ms": [at], "received_at_ms": [received], "fresh": [fresh], "told_at_ms": [now]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, limit = timerValues.getCurrentProcessingTimeInMs(), self.limits[key[1]]
        new = pd.concat(list(rows)).sort_values(["at_ms", "received_at_ms"]).iloc[-1]
        at, received, was = int(new.at_ms), int(new.received_at_ms), None
        if self.last.exists():
            before = self.last.get()
            was = before[2]
            if (before[0], before[1]) > (at, received):
                at, received = before[0], before[1]
        fresh = all(0 <= now - t <= limit for t in (at, received))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if fresh:
            self.handle.registerTimer(min(at, received) + limit + 1)
        out = self.told(key, at, received, fresh, now)
        if fresh != was:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, received, _ = self.last.get()
        yield self.told(key, at, received, False, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def sightings(records: DataFrame) -> DataFrame:
    """``(symbol, kind, at_ms, received_at_ms)`` of trades and minute bars; a bar's time is its end."""
    at = F.unix_millis(F.try_to_timestamp("event.time"))
    kind = F.when(F.col("event.kind") == "t", "trade").when(F.col("event.kind") == "b", "minute")
    rows = records.select(F.col("event.symbol").alias("symbol"), kind.alias("kind"), F.when(kind == "minute", at + 60_000).otherwise(at).alias("at_ms"), "received_at_ms")
    return rows.where("symbol is not null and kind is not null and at_ms is not null and received_at_ms is not null")


def readiness(records: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``READY`` rows whenever a symbol's trades or bars turn fresh or stale; both its clocks must be within the limit."""
    limits = limits or {k: core.FRESH[k] for k in ("trade", "minute")}
    rows = sightings(records).where(F.col("kind").isin(*limits))
    return rows.groupBy("symbol", "kind").transformWithStateInPandas(statefulProcessor=Freshness(limits), outputStructType=READY, outputMode="Update", timeMode="ProcessingTime")


def batch_readiness(records: DataFrame, now_ms: int, limits: dict[str, int] | None = None) -> DataFrame:
    """``(symbol, kind, at_ms, received_at_ms, fresh)`` at a given time, from all records at once."""
    limits = limits or {k: core.FRESH[k] for k in ("trade", "minute")}
    limit = F.create_map(*(F.lit(v) for kv in limits.items() for v in kv))
    last = sightings(records).where(F.col("kind").isin(*limits)).groupBy("symbol", "kind").agg(F.max(F.struct("at_ms", "received_at_ms")).alias("l")).select("symbol", "kind", "l.*")
    within = lambda c: (F.lit(now_ms) - F.col(c)).between(F.lit(0), limit[F.col("kind")])
    return last.withColumn("fresh", within("at_ms") & within("received_at_ms"))


class Chain(StatefulProcessor):
    """A session's chain of checksums, checked record by record as it lands.

    Records wait in state until the one before them is there; what waits is judged,
    until then, as a record whose predecessor is missing.
    """

    WAITING = "seq bigint, previous_checksum string, checksum string, received_at_ms bigint, type string, feed string, symbol string, reason string, own boolean, size int, symbols array<string>"
    SEEN = "seq bigint, checksum string, received_at_ms bigint, type string, reason string, records bigint, gaps bigint, faults bigint, kinds string, feed string, symbols array<string>, header boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.seen = handle.getValueState("seen", self.SEEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in self.WAITING.split(", ")]
        record = lambda values: dict(zip(names, values))
        plain = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v
        rest = [record(w) for w in self.waiting.get()]
        for r in pd.concat(list(rows)).itertuples():
            rest.append({n: (list(v) if n == "symbols" and v is not None else plain(v)) for n, v in ((n, getattr(r, n)) for n in names)})
        rest.sort(key=lambda r: (r["seq"] is None, r["seq"] or 0))
        seen = dict(zip([c.strip().split(" ")[0] for c in self.SEEN.split(", ")], self.seen.get())) if self.seen.exists() else None
        while rest and rest[0]["seq"] == (seen["seq"] + 1 if seen else 1):
            seen = self.step(seen, rest.pop(0))
        self.waiting.put([tuple(int(v) if n in ("seq", "received_at_ms", "size") and v is not None else v for n, v in r.items()) for r in rest]) if rest else self.waiting.clear()
        if seen:
            self.seen.update(tuple(seen.values()))
        yield self.summary(key[0], seen, rest)

    def step(self, seen: dict | None, r: dict, known: bool = True) -> dict:
        """The state after a record; ``known``: what is seen is the record before it."""
        before = seen if known else None
        seen = dict(seen) if seen else {"seq": 0, "checksum": None, "received_at_ms": None, "type": None, "reason": None, "records": 0, "gaps": 0, "faults": 0, "kinds": "", "feed": None, "symbols": None, "header": False}
        first, market = r["seq"] == 1, r["type"] == "market"
        if first:
            seen |= {"feed": r["feed"], "symbols": r["symbols"], "header": True}
        faults = {
            "chain": (r["previous_checksum"] or "") != "" if first else r["previous_checksum"] != (before["checksum"] if before else None),
            "checksum": not r["own"],
            "clock": not (r["received_at_ms"] or 0) > 0 or bool(before and before["received_at_ms"] is not None and r["received_at_ms"] < before["received_at_ms"]),
            "after stop": bool(before and before["type"] == "stop"),
            "header": first and not (r["type"] == "session" and (r["size"] or 0) > 0),
            "type": not first and r["type"] not in ("market", "gap", "stop"),
            "feed": market and (r["feed"] is None or r["feed"] != seen["feed"]),
            "symbol": market and not (seen["symbols"] is not None and r["symbol"] in seen["symbols"]),
        }
        kinds = {k for k, v in faults.items() if v}
        seen |= {"seq": int(r["seq"]), "checksum": r["checksum"], "received_at_ms": None if r["received_at_ms"] is None else int(r["received_at_ms"]), "type": r["type"], "reason": r["reason"]}
        seen["records"] += 1
        seen["gaps"] += r["type"] == "gap"
        seen["faults"] += bool(kinds)
        seen["kinds"] = ",".join(sorted(kinds | set(filter(None, seen["kinds"].split(",")))))
        return seen

    def summary(self, session: str, seen: dict | None, rest: list[dict]) -> pd.DataFrame:
        """As :func:`dq.audit` has it, of what has landed."""
        for r in rest:
            known = seen is not None and r["seq"] is not None and seen["seq"] + 1 == r["seq"]
            seen = self.step(seen, r, known)
        return pd.DataFrame(
            {
                "session_id": [session], "records": [seen["records"]], "feed": [seen["feed"]], "gaps": [seen["gaps"]], "clean_shutdown": [seen["type"] == "stop" and seen["reason"] == "shutdown"],
                "head": [seen["checksum"]], "faults": [seen["faults"]], "kinds": [seen["kinds"]], "missing": [seen["seq"] != seen["records"]],
            }
        )

    def close(self) -> None:
        pass


def chain(log: DataFrame) -> DataFrame:
    """``CHAIN`` rows, one a session and batch: the audit of all its records so far; ``log`` as :func:`dq.audit` takes it."""
    rows = log.select("session_id", "seq", "previous_checksum", "checksum", "received_at_ms", "type", "feed", "symbol", "reason", F.coalesce(dq.own_checksum() == F.col("checksum"), F.lit(False)).alias("own"), F.size("symbols").alias("size"), "symbols")
    return rows.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Chain(), outputStructType=CHAIN, outputMode="Update", timeMode="None")


def landed(lines: DataFrame, good: str, bad: str, checkpoint: str):
    """Journal lines to two sinks, both by batch: market records without fault, and all that is faulty with what is wrong.

    ``lines(line)`` is a stream of text.  Both parts of a batch are written under its
    number and replace what an earlier try of it has left, so a batch tried twice
    gives each record once.  A line that is no record goes to quarantine as its text.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = sorted_out(batch).persist()
        try:
            for path, faulty in ((good, False), (bad, True)):
                part = rows.where((F.size("faults") > 0) == faulty)
                part = part.drop("faults") if not faulty else part.select("line", "faults")
                part.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            rows.unpersist()

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sorted_out(lines: DataFrame) -> DataFrame:
    """Market records and unreadable lines with ``faults``; other records of a journal are left out."""
    from ..sources.io import JOURNAL, parse_event

    r = lines.where("trim(line) <> ''").select("line", F.from_json("line", JOURNAL).alias("r"))
    torn = F.coalesce(F.col("type").isNull() | F.col("session_id").isNull() | F.col("seq").isNull(), F.lit(True))
    rows = dq.event_rules(parse_event(r.select("line", "r.*")))
    rows = rows.withColumn("faults", F.when(torn, F.array(F.lit("not a record"))).otherwise(F.col("faults")))
    return rows.where(torn | (F.col("type") == "market"))


def rolled(ticks: DataFrame, width: int, delay: str) -> DataFrame:
    """OHLCV bars of ``width`` seconds by event time, each once it can't change any more.

    ``ticks(symbol, at, seq, price)``, ``at`` in epoch seconds.  A tick that comes
    after the watermark, the latest time seen less ``delay``, has passed its bar's end
    is dropped.  Over a static table it gives the same bars as ``fixtures.rollup``.
    """
    rows = ticks.withColumn("event_time", F.timestamp_seconds("at"))
    if rows.isStreaming:
        rows = rows.withWatermark("event_time", delay)
    bars = rows.groupBy("symbol", F.window("event_time", f"{width} seconds").alias("w")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.count("*").alias("volume")
    )
    end = F.unix_seconds("w.end")
    return bars.select("symbol", end.alias("ts"), "open", "high", "low", "close", "volume", end.alias("avail_ts"))
