"""Stateful streams: each equals the batch operator over all that landed."""

import hashlib
import json
import time

import pytest
from barlake.operators import dq
from barlake.sources import calendar, fixtures, io
from barlake.streaming import live, state
from pyspark.sql import functions as F

BARS = "symbol string, ts long, open double, high double, low double, close double, volume long, avail_ms long"
CLOSE, FIRST = 1704229200, 1704292260  # 2 January closes at 21:00 UTC, 3 January opens at 14:30


def ok(t):
    return (t + 1) * 1000


def bar(s, t, avail=None, high=2.0):
    return (s, t, 1.0, high, 0.5, 1.0 + t % 7 / 10, 5, avail or ok(t))


def stream_of(spark, folder, name, batches, schema):
    """Each batch lands as a file of its own and is one micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        time.sleep(0.01)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")


def run(df, name, mode="update", **trigger):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def forecast_case():
    """Batches of live bars, and stored history, around the turn of a session."""
    history = [bar("roll", t) for t in (CLOSE - 240, CLOSE - 180, CLOSE - 120)] + [bar("far", CLOSE - 600)] + [bar("over", t) for t in range(CLOSE - 300, CLOSE + 1, 60)] + [bar("odd", CLOSE - 60, high=0.6), bar("hole", CLOSE - 300), bar("hole", CLOSE - 60)]
    live_bars = [(s, t) for s in ("roll", "far", "over") for t in (CLOSE - 60, CLOSE, FIRST, FIRST + 60)]
    batches = [
        [bar(s, t) for s, t in live_bars if t < CLOSE],
        [bar(s, t) for s, t in live_bars if t == CLOSE] + [bar("gap", CLOSE - 60), bar("odd", CLOSE), bar("hole", CLOSE), bar("old", CLOSE)],
        [bar(s, t) for s, t in live_bars if t > CLOSE] + [bar(s, FIRST) for s in ("gap", "odd", "hole")] + [bar("gap", FIRST + 60), bar("odd", FIRST + 60), bar("hole", FIRST + 60), bar("gap", FIRST)],
    ]
    return history, batches


def test_forecasts_equal_the_batch_over_a_session_change(spark, tmp_path):
    days = calendar.sessions(spark, "2024-01-02", "2024-01-05")
    history, batches = forecast_case()
    stored = live.regular(spark.createDataFrame(history, BARS), days)
    now = ok(FIRST + 60) + 500
    stream = live.regular(stream_of(spark, tmp_path, "bars", batches, BARS), days)
    inputs = state.forecast_inputs(stream, stored, "connected", "iex", now)
    score = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    last = {r["symbol"]: r.asDict() for r in run(state.forecasts(inputs, score, 3), "forecasts")}
    everything = live.regular(spark.createDataFrame([r for b in batches for r in b], BARS), days)
    want = {r["symbol"]: r for r in state.batch_forecast_inputs(everything, stored, "connected", "iex", now, days).collect()}
    assert set(last) == set(want) == {"roll", "far", "over", "gap", "odd", "hole", "old"}
    for s, w in want.items():
        g = last[s]
        assert (g["ts"], g["avail_ms"]) == (w["ts"], w["avail_ms"])
        if w["reason"]:
            assert (g["reason"], g["forecast"]) == (w["reason"], None)
        elif w["n"] >= 3:
            assert g["n"] == w["n"] and g["closes"] == w["closes"][-3:] and g["forecast"] == pytest.approx(sum(w["closes"][-3:])) and g["reason"] is None
    assert {s: (w["reason"], w["n"]) for s, w in want.items() if not w["reason"]} == {"roll": (None, 7), "over": (None, 8), "far": (None, 4), "gap": (None, 2)}
    assert {s: w["reason"] for s, w in want.items() if w["reason"]} == {"odd": "unsound", "hole": "gap", "old": "stale"}


def test_forecasts_go_on_where_they_were_and_obey_the_connection(spark, tmp_path):
    days = calendar.sessions(spark, "2024-01-02", "2024-01-05")
    history, batches = forecast_case()
    stored = live.regular(spark.createDataFrame(history, BARS), days)

    def part(rows, status="connected", checkpoint="cp"):
        spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = live.regular(spark.readStream.schema(BARS).parquet(f"{tmp_path}/in"), days)
        out = state.forecast_inputs(stream, stored, status, "iex", ok(FIRST + 60))
        q = out.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/{checkpoint}-out/batch={n}")).outputMode("update").option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{checkpoint}-out")

    for rows in batches:  # three queries, one after the other, on one checkpoint
        got = part(rows)
    last = {r["symbol"]: r for r in got.orderBy("batch").collect()}
    assert (last["roll"]["n"], last["over"]["n"], last["far"]["n"]) == (7, 8, 4)
    assert {r["reason"] for r in part([], "reconnecting", "other").collect()} == {"not connected"}
    assert state.gate("connected", "test") == "delayed feed" and state.gate("connected", "sip") is None


RECORD = "received_at_ms long, event struct<kind:string,symbol:string,time:string>"


def seen(symbol, kind, at_ms, received=None):
    text = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime((at_ms - 60_000 * (kind == "b")) / 1000)) + f".{at_ms % 1000:03d}Z"
    return (received or at_ms, (kind, symbol, text))


def test_a_symbol_turns_stale_without_a_new_record(spark, tmp_path):
    """By the clock alone: limits of some seconds, then no more records."""
    now = int(time.time() * 1000)
    rows = [seen("A", "t", now), seen("B", "t", now - 600_000), seen("A", "b", now), seen("C", "q", now), seen("D", "t", now, now - 600_000)]
    stream = stream_of(spark, tmp_path, "records", [rows], RECORD)
    told = state.readiness(stream, {"trade": 25_000, "minute": 300_000})
    q = told.writeStream.format("memory").queryName("ready").outputMode("update").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 120
        while time.time() < until and not spark.table("ready").where("symbol = 'A' and kind = 'trade' and not fresh").count():
            time.sleep(1)
    finally:
        q.stop()
    got = [(r["symbol"], r["kind"], r["fresh"]) for r in spark.table("ready").orderBy("told_at_ms").collect()]
    assert sorted(got) == [("A", "minute", True), ("A", "trade", False), ("A", "trade", True), ("B", "trade", False), ("D", "trade", False)]
    assert [x for x in got if x[:2] == ("A", "trade")] == [("A", "trade", True), ("A", "trade", False)]
    stale = spark.table("ready").where("symbol = 'A' and kind = 'trade' and not fresh").first()
    assert stale["told_at_ms"] > stale["at_ms"] + 25_000


def test_readiness_of_a_batch(spark):
    now = 1_704_300_000_000
    rows = [seen("A", "t", now - 29_000), seen("B", "t", now - 31_000), seen("B", "b", now - 100_000), seen("E", "t", now + 1000), seen("A", "t", now - 90_000, now), seen("F", "t", now - 10, now - 40_000)]
    got = {(r["symbol"], r["kind"]): r["fresh"] for r in state.batch_readiness(spark.createDataFrame(rows, RECORD), now).collect()}
    assert got == {("A", "trade"): True, ("B", "trade"): False, ("B", "minute"): True, ("E", "trade"): False, ("F", "trade"): False}


def test_latest_prices_and_bars(spark):
    rows = [(1, 1, ("t", "A", "2024-01-02T15:00:00Z", 1.0)), (2, 2, ("t", "A", "2024-01-02T15:00:01Z", 2.0)), (4, 3, ("t", "A", "2024-01-02T15:00:01Z", 3.0)), (5, 4, ("t", "A", "2024-01-02T14:00:00Z", 9.0)), (6, 5, ("q", "B", "2024-01-02T15:00:00Z", 1.0))]
    records = spark.createDataFrame(rows, "received_at_ms long, seq long, event struct<kind:string,symbol:string,time:string,p:double>")
    assert [tuple(r) for r in live.latest_prices(records).collect()] == [("A", 3.0)]
    bars = spark.createDataFrame([bar("A", 60), bar("A", 120, 121_000), bar("A", 120, 125_000), bar("B", 60)], BARS)
    assert {(r["symbol"], r["ts"], r["avail_ms"]) for r in live.latest_bars(bars).collect()} == {("A", 120, 125_000), ("B", 60, 61_000)}


def journal_lines(session, records):
    out, before = [], ""
    text = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    for i, r in enumerate(records, 1):
        r = {"schema_version": 1, "seq": i, "session_id": session, "received_at_ms": i, "previous_checksum": before, **r}
        before = hashlib.sha256(text(r).encode()).hexdigest()
        out.append(text({**r, "checksum": before}))
    return out


def sessions():
    head = {"type": "session", "feed": "iex", "symbols": ["A"]}
    market = {"type": "market", "feed": "iex", "event": {"S": "A", "T": "t", "p": 1.5}}
    stop = {"type": "stop", "reason": "shutdown"}
    good = journal_lines("good", [head, market, market, {"type": "gap"}, market, stop])
    edited = journal_lines("edited", [head, market, market, stop])
    edited[1] = edited[1].replace("1.5", "1.6")
    other = journal_lines("other", [head, {**market, "event": {"S": "B"}}, {**market, "feed": "sip"}, stop, market])
    back = journal_lines("back", [head, {**market, "received_at_ms": 9}, {**market, "received_at_ms": 3}])
    cut = journal_lines("cut", [head, market, market, market])
    return {"good": good, "edited": edited, "other": other, "back": back, "cut": [cut[0], cut[3]], "headless": journal_lines("headless", [market, market])}


@pytest.mark.parametrize("deal", ["in order", "out of order"])
def test_chain_is_audited_while_it_lands(spark, tmp_path, deal):
    """After each batch the state says what the audit of all lines so far says."""
    flat = [(s, i, x) for s, lines in sessions().items() for i, x in enumerate(lines)]
    part = (lambda i: i // 2) if deal == "in order" else (lambda i: (i * 7 + 2) % 3)
    (tmp_path / "in").mkdir()
    log = lambda reader: reader
    for number in range(3):
        now = [x for _, i, x in flat if part(i) == number]
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(now) + "\n")
        rows = spark.readStream.text(f"{tmp_path}/in").withColumnRenamed("value", "line")
        r = rows.select("line", F.from_json("line", io.JOURNAL + ", reason string").alias("r")).select("line", "r.*").withColumn("symbol", F.get_json_object("event", "$.S"))
        q = state.chain(log(r)).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        last = {}
        for x in spark.read.parquet(f"{tmp_path}/out").orderBy("batch").collect():
            last[x["session_id"]] = {k: v for k, v in x.asDict().items() if k != "batch"}
        want = {x["session_id"]: x.asDict() for x in dq.audit(io.read_log(spark, f"{tmp_path}/in")).collect()}
        assert last == want
    assert last["good"]["clean_shutdown"] and last["good"]["faults"] == 0 and last["edited"]["kinds"] == "checksum" and last["cut"]["missing"]


def test_both_sinks_of_a_batch_are_replaced_by_a_retry(spark, tmp_path):
    good = {"type": "market", "event": {"S": "A", "T": "t", "t": "2024-01-02T15:00:00Z", "p": 1.5, "s": 1}, "received_at_ms": 1704207661000}
    bad = {**good, "event": {**good["event"], "p": -1.0}}
    lines = [*journal_lines("s", [{"type": "session", "feed": "iex", "symbols": ["A"]}, good, bad, good]), "{torn", ""]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(lines) + "\n")
    good_path, bad_path = f"{tmp_path}/good", f"{tmp_path}/bad"

    def run_all():
        state.landed(spark.readStream.text(f"{tmp_path}/in").withColumnRenamed("value", "line"), good_path, bad_path, f"{tmp_path}/cp").awaitTermination()

    run_all()
    # the batch was written but not committed: it is tried again
    for commit in (tmp_path / "cp" / "commits").iterdir():
        commit.unlink()
    run_all()
    assert spark.read.parquet(good_path).count() == 2
    assert sorted(r["faults"][0] for r in spark.read.parquet(bad_path).collect()) == ["bad trade", "not a record"]
    (tmp_path / "in" / "1.json").write_text(lines[1] + "\n")
    run_all()
    assert spark.read.parquet(good_path).count() == 3 and spark.read.parquet(bad_path).count() == 2


def test_rolled_bars_equal_the_batch_and_late_ticks_are_dropped(spark, tmp_path):
    schema = "symbol string, at long, seq long, price double"
    t0 = 1_704_207_600
    batches = [
        [("A", t0 + 10, 1, 5.0), ("A", t0 + 3000, 2, 7.0), ("B", t0 + 20, 3, 1.0)],
        [("A", t0 + 1800, 4, 4.0), ("A", t0 + 7300, 5, 6.0)],  # late, but its bar is still open
        [("A", t0 + 30_000, 6, 9.0)],
        [("A", t0 + 40, 7, 99.0), ("A", t0 + 30_010, 8, 8.0)],  # its bar is closed: dropped
        [("A", t0 + 90_000, 9, 1.0)],
        [("A", t0 + 90_001, 10, 1.0)],
    ]
    got = run(state.rolled(stream_of(spark, tmp_path, "ticks", batches, schema), 3600, "1 hour"), "rolled", "append")
    kept = [r for b in batches for r in b if r[2] != 7]
    rows = lambda df: sorted(tuple(r) for r in df)
    static = spark.createDataFrame(kept, schema)
    want = fixtures.rollup(static, 3600).select("symbol", "ts", "open", "high", "low", "close", "volume", "avail_ts").collect()
    assert rows(state.rolled(static, 3600, "1 hour").collect()) == rows(want)
    closed = [r for r in want if r["ts"] <= t0 + 86_400]  # the last bar is still open
    assert rows(got) == rows(closed)
