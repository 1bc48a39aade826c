import pytest
from barlake.operators import core, dq, joins, metrics
from barlake.operators import portfolio as p
from barlake.sources import calendar, io
from barlake.streaming import live
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 20), min_size=1, max_size=12))
def test_every_step_back_is_found(spark, times):
    rows = [("a", t, 1.0, 2.0, 0.5, 1.5, i) for i, t in enumerate(times)]
    bars = spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, row_seq int")
    found = dq.bars_sound(bars).where("rule = 'not increasing'").count()
    assert found == sum(b <= a for a, b in zip(times, times[1:]))


def test_assert_clean(spark):
    dq.assert_clean(spark.createDataFrame([], "symbol string, ts long, rule string"))
    with pytest.raises(ValueError):
        dq.assert_clean(spark.createDataFrame([("a", 1, "x")], "symbol string, ts long, rule string"))


def test_signals_wait_for_a_later_bar(spark):
    bars = spark.createDataFrame([("a", t) for t in (10, 20, 30)], "symbol string, ts long")
    signals = spark.createDataFrame([("a", 5, 1.0), ("a", 10, 2.0), ("a", 20, 3.0), ("a", 30, 4.0)], "symbol string, as_of long, v double")
    got = {(r["ts"], r["v"]) for r in joins.deliver(bars, signals).collect()}
    assert got == {(20, 2.0), (30, 3.0)}


def test_after_cost_return(spark):
    # worked by hand: cost of 10 basis points on both sides
    rows = spark.createDataFrame([(1.0, 100.0, 110.0), (-1.0, 100.0, 90.0)], "pred double, next_open double, next_close double")
    a, b = metrics.after_cost(rows, 10.0).orderBy(F.desc("pred")).collect()
    assert (a["ret"], a["turnover"]) == pytest.approx((1.1 * 0.999 / 1.001 - 1, 2.1)) and (b["ret"], b["turnover"]) == (0, 0)


def ledger(spark, fills):
    rows = [("r", 1, i, q, px, c) for i, (q, px, c) in enumerate(fills)]
    return p.fold_fills(spark.createDataFrame(rows, "run_id string, instrument int, fill_seq long, quantity double, price double, commission double")).orderBy("seq").collect()


def test_round_trip_with_fees(spark):
    out = ledger(spark, [(10.0, 100.0, 1.0), (-5.0, 110.0, 0.5), (-10.0, 90.0, 1.0)])
    assert out[1]["pnl"] == pytest.approx(5 * 10 - 0.5 - 0.5) and out[1]["qty"] == 5
    assert out[2]["pnl"] == pytest.approx(5 * -10 - 0.5 - 0.5) and (out[2]["qty"], out[2]["price"]) == (-5, 90)


def test_regime_labels(spark):
    # Runs of returns at the edges of the regime rules
    rows = [("bull", i, r) for i, r in enumerate([0.005, 0.004, 0.006, 0.003, 0.005])] + [("crisis", i, r) for i, r in enumerate([0.01, -0.07, 0.0, 0.01, 0.0])]
    got = {r["symbol"]: r["regime"] for r in metrics.regimes(spark.createDataFrame(rows, "symbol string, ts int, ret double"), 252.0).collect()}
    assert got == {"bull": "Bull", "crisis": "Crisis"}


def test_downsample_keeps_extremes(spark):
    rows = [("a", i, float((i * 37) % 101)) for i in range(1000)]
    out = core.downsample(spark.createDataFrame(rows, "symbol string, ts long, v double"), ["v"], 50).collect()
    assert len(out) <= 52 and {r["v"] for r in out} >= {0.0, 100.0} and {r["ts"] for r in out} >= {0, 999}


def test_sessions(spark):
    rows = {str(r["date"]): r for r in calendar.sessions(spark, "2024-03-25", "2024-07-08").collect()}
    assert "2024-03-29" not in rows and "2024-06-19" not in rows and "2024-07-04" not in rows
    assert rows["2024-07-03"]["is_early_close"] and rows["2024-07-03"]["close_ts"] - rows["2024-07-03"]["open_ts"] == 3.5 * 3600


def test_csv_sources(spark, tmp_path):
    head = "timestamp,open,high,low,close,volume\n"
    (tmp_path / "ABC.csv").write_text(head + "2024-01-02T21:00:00Z,1,2,0.5,1.5,10\n2024-01-03T21:00:00Z,1,2,0.5,1.5,10\n")
    assert [(r["symbol"], r["ts"]) for r in io.read_ohlcv(spark, str(tmp_path / "ABC.csv"), end=1704300000).collect()] == [("ABC", 1704229200)]
    (tmp_path / "BAD.csv").write_text(head + "2024-01-02 21:00,1,2,0.5,1.5,10\n")
    with pytest.raises(Exception):
        io.read_ohlcv(spark, str(tmp_path / "BAD.csv")).collect()
    (tmp_path / "D.csv").write_text(head + "2024-01-02,1,2,0.5,1.5,10\n")
    assert io.read_daily(spark, str(tmp_path / "D.csv")).first()["ts"] == 1704229200
    (tmp_path / "A.csv").write_text("date,action_type,value\n2024-01-02,split,2\nnope,split,2\n2024-01-03,dividend,x\n2024-01-04,merger,1\n")
    got = sorted((r["kind"], r["amount"]) for r in io.read_actions(spark, str(tmp_path / "A.csv")).collect())
    assert got == [("dividend", 0.0), ("split", 2.0)]


def test_versions_are_written_once_and_verified(spark, tmp_path):
    schema = "symbol string, ts long, open double, high double, low double, close double, volume long"
    bars = spark.createDataFrame([("a", i, 1.0, 2.0, 0.5, 1.5, 10) for i in range(5)], schema)
    io.write_version(bars, str(tmp_path), "v1")
    with pytest.raises(Exception):
        io.write_version(bars, str(tmp_path), "v1")
    assert io.read_version(spark, str(tmp_path), "v1", schema).count() == 5
    bars.limit(1).write.mode("append").partitionBy("symbol").parquet(f"{tmp_path}/v1/bars")
    with pytest.raises(ValueError):
        io.read_version(spark, str(tmp_path), "v1", schema)


def journal(tmp_path):
    import json

    rows, seq = [], 0
    for symbol, minutes in (("A", [0, 1, 2, 2, 5, 6]), ("B", [0, 1])):
        for m in minutes:
            seq += 1
            at = 1_704_205_800 + 60 * m
            event = {"T": "b", "S": symbol, "t": f"2024-01-02T14:{30 + m}:00Z", "o": 1.0, "h": 10.0, "l": 0.5, "c": 1.0 + m, "v": 5.0}
            rows.append({"session_id": "s", "seq": seq, "received_at_ms": (at + 60) * 1000 + 500, "type": "market", "event": event})
    rows.append({"session_id": "s", "seq": seq + 1, "received_at_ms": rows[-1]["received_at_ms"], "type": "stop"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "j.json").write_text("\n".join(map(json.dumps, rows)))
    return str(tmp_path / "in")


def test_stream_equals_batch(spark, tmp_path):
    path = journal(tmp_path)
    days = calendar.sessions(spark, "2024-01-02", "2024-01-04")
    batch = live.regular(live.bars(io.read_journal(spark, path)), days)
    q = live.bars(live.records(spark, path)).writeStream.format("memory").queryName("bars_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r["symbol"], r["ts"], r["close"]) for r in df.collect())
    assert key(spark.table("bars_out")) == key(batch)
    want = {(r["symbol"], r["ts"], r["size"]) for r in live.batch_buffer(batch).collect()}
    q = live.buffered(live.regular(live.bars(live.records(spark, path)), days)).writeStream.format("memory").queryName("buf_out").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.table("buf_out").collect():
        got[r["symbol"]] = (r["symbol"], r["ts"], r["size"])
    assert set(got.values()) == want
    good, bad = live.good_and_bad(io.read_journal(spark, path))
    assert good.count() == 8 and bad.count() == 0
    assert live.accounting(io.read_journal(spark, path)).first()["stops"] == 1


def bars_at(spark, rows):
    """(symbol, ts, avail_ms) as minute bars."""
    return spark.createDataFrame([(s, t, 1.0, 2.0, 0.5, 1.0 + t % 7 / 10, 5, a) for s, t, a in rows], "symbol string, ts long, open double, high double, low double, close double, volume long, avail_ms long")


def test_buffer_rolls_over_a_session_and_clears_at_gaps(spark):
    """Worked by hand: 2 January closes at 21:00 UTC, 3 January opens at 14:30."""
    days = calendar.sessions(spark, "2024-01-02", "2024-01-05")
    close, first = 1704229200, 1704292260
    ok = lambda t: (t + 1) * 1000
    rows = [("roll", t, ok(t)) for t in (close - 60, close, first, first + 60)]
    rows += [("gap", t, ok(t)) for t in (close - 180, close - 60, close)]
    rows += [("after", t, ok(t)) for t in (close, close + 60)]  # 21:01 isn't regular
    rows += [("late", close - 60, close * 1000), ("late", close, ok(close))]  # known only when the next ends
    rows += [("old", close - 60, ok(close)), ("old", close - 120, ok(close) + 500), ("old", close, ok(close) + 900)]  # the older one came last: ignored
    rows += [("same", close - 60, ok(close)), ("same", close, ok(close))]  # available no later than the one before
    got = {r["symbol"]: (r["ts"], r["size"]) for r in live.batch_buffer(live.regular(bars_at(spark, rows), days)).collect()}
    assert got == {"roll": (first + 60, 4), "gap": (close, 2), "after": (close, 1), "late": (close, 1), "old": (close, 1), "same": (close, 1)}


def test_buffer_processor_follows_the_same_rules(spark):
    import pandas as pd

    class Kept:
        rows: list = []

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

    def after(*batches):
        b = live.BarBuffer()
        b.rows = Kept()
        for rows in batches:
            out = list(b.handleInputRows(("x",), iter([pd.DataFrame(rows, columns=["ts", "close", "avail_ms", "next_ts"])]), None))
        return out[0].iloc[0]["size"]

    assert after([(60, 1.0, 61_000, 120), (120, 1.0, 121_000, 900)], [(900, 1.0, 901_000, 960)]) == 3
    assert after([(60, 1.0, 61_000, 120), (180, 1.0, 181_000, 240)]) == 1
    assert after([(120, 1.0, 121_000, 180), (60, 1.0, 122_000, 120), (180, 1.0, 181_000, 240)]) == 2
    assert after([(60, 1.0, 120_000, 120), (120, 1.0, 121_000, 180)]) == 1


def test_live_inputs_are_gated(spark):
    days = calendar.sessions(spark, "2024-01-02", "2024-01-05")
    t0 = 1704206400  # 14:40 UTC
    ok = lambda t: (t + 1) * 1000
    live_rows = [(s, t, ok(t)) for s in ("good", "far", "gap") for t in (t0 + 60, t0 + 120)] + [("stale", t0 - 540, ok(t0 - 540))]
    history = [("good", t, ok(t)) for t in (t0 - 60, t0)] + [("far", t0 - 120, ok(t0 - 120))] + [("gap", t, ok(t)) for t in (t0 - 120, t0)]
    symbols = spark.createDataFrame([(s,) for s in ("good", "far", "gap", "stale", "none")], "symbol string")
    mark = lambda rows: live.regular(bars_at(spark, rows), days)
    take = lambda status, feed: live.live_inputs(mark(live_rows), mark(history), symbols, status, feed, (t0 + 150) * 1000, days)
    bars, refused = take("connected", "iex")
    assert {r["symbol"]: r["reason"] for r in refused.collect()} == {"stale": "stale", "none": "no bar yet", "gap": "gap"}
    assert {r["symbol"]: r["count"] for r in bars.groupBy("symbol").count().collect()} == {"good": 4, "far": 2}  # history that doesn't reach goes
    for status, feed, reason in (("connecting", "iex", "not connected"), ("connected", "test", "delayed feed")):
        bars, refused = take(status, feed)
        assert bars.count() == 0 and {r["reason"] for r in refused.collect()} == {reason}


def lines(spark, records):
    """Journal lines with their chain of checksums, keys sorted and without blanks."""
    import hashlib
    import json

    out, before = [], ""
    for i, r in enumerate(records, 1):
        r = {"schema_version": 1, "seq": i, "session_id": "s", "received_at_ms": i, "previous_checksum": before, **r}
        text = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
        before = hashlib.sha256(text(r).encode()).hexdigest()
        out.append(text({**r, "checksum": before}))
    return out, before


def test_log_audit(spark, tmp_path):
    head = {"type": "session", "feed": "iex", "symbols": ["A"]}
    market = {"type": "market", "feed": "iex", "event": {"S": "A", "T": "t", "p": 1.5}}
    stop = {"type": "stop", "reason": "shutdown"}

    def audit(name, change=lambda x: x, *records):
        text, last = lines(spark, records or (head, market, stop))
        (tmp_path / name).write_text("\n".join(change(text)) + "\n")
        return dq.audit(io.read_log(spark, str(tmp_path / name))).first(), last

    got, last = audit("good")
    assert got["clean_shutdown"] and got["faults"] == 0 and not got["missing"] and got["head"] == last and got["feed"] == "iex"
    assert audit("edited", lambda t: [t[0], t[1].replace("1.5", "1.6"), t[2]])[0]["kinds"] == "checksum"
    assert audit("cut", lambda t: [t[0], t[2]])[0]["missing"]
    assert audit("mixed", lambda t: t, head, {**market, "feed": "sip"}, stop)[0]["kinds"] == "feed"
    assert audit("other", lambda t: t, head, {**market, "event": {"S": "B"}}, stop)[0]["kinds"] == "symbol"
    assert audit("more", lambda t: t, head, stop, market)[0]["kinds"] == "after stop"
    assert not audit("broken", lambda t: t, head, market, {"type": "stop", "reason": "error"})[0]["clean_shutdown"]
    bars = bars_at(spark, [("A", 60, 1)] * 2)
    rules = {r["rule"] for r in dq.import_gate(dq.audit(io.read_log(spark, str(tmp_path / "broken"))), bars).collect()}
    assert rules == {"no clean stop", "repeated minutes"}


def test_bad_events_are_told(spark):
    ok = {"kind": "b", "symbol": "A", "time": "2024-01-02T15:00:00Z", "o": 1.0, "h": 2.0, "l": 0.5, "c": 1.0, "v": 0.0}
    bad = [({}, []), ({"h": 0.9}, ["bad bar"]), ({"time": "2024-01-02T14:59:07Z"}, ["unaligned bar"]), ({"v": -1.0}, ["bad bar"]), ({"kind": "?"}, ["unknown kind"]), ({"time": "2024-01-02T15:01:00Z"}, ["early bar"])]
    names = "kind symbol time action o h l c v p size bp ap bs as_size op cp".split()
    schema = "id int, received_at_ms long, event struct<" + ",".join(f"{n}:{'string' if n in ('kind', 'symbol', 'time', 'action') else 'double'}" for n in names) + ">"
    rows = [(i, 1704207661000, tuple({**ok, **change}.get(n) for n in names)) for i, (change, _) in enumerate(bad)]
    got = {r["id"]: r["faults"] for r in dq.event_rules(spark.createDataFrame(rows, schema)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(bad)}


def test_minutes_of_a_session_are_imported(spark, tmp_path):
    days = calendar.sessions(spark, "2024-01-02", "2024-01-04")
    records = io.read_journal(spark, journal(tmp_path))
    got = io.import_minutes(records, days, "A", "2024-01-02", "2024-01-02")
    assert sorted(r["ts"] - 1704205800 for r in got.collect()) == [60, 120, 180, 180, 360, 420]
    assert io.import_minutes(records, days, "A", "2024-01-03", "2024-01-03").count() == 0
    rules = {(r["ts"] - 1704205800, r["rule"]) for r in dq.minutes_continue(got.dropDuplicates(["ts"]), days).collect()}
    assert rules == {(360, "gap")}


def test_drift_stream_keeps_its_state_by_batch(spark, tmp_path):
    schema = "dataset string, as_of long, seq long, decision_id long, provenance string, model string, predicted double, features map<string,double>"
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    reference = spark.createDataFrame([("d", "f", i / 10) for i in range(10)], "dataset string, feature string, value double")
    outcomes = lambda: spark.createDataFrame([(i, 0.1) for i in range(30)], "decision_id long, realized double")
    for part in range(2):
        rows = [("d", i, i, i, "live" if i % 5 else "synthetic", "m" if i % 7 else "other", 0.2, {"f": i / 30}) for i in range(part * 12, part * 12 + 12)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        live.monitored(stream, outcomes, reference, out, state, str(tmp_path / "cp"), 10, {"model": "m"}).awaitTermination()
    want = metrics.monitor(spark.read.parquet(src), outcomes(), reference, 10, {"model": "m"}).drop("batch").first()
    got = spark.read.parquet(out).where("batch = 1").drop("batch").first()
    assert got == want and spark.read.parquet(f"{state}/1").count() == 10


def test_trials_are_retried_up_to_a_cap(spark, tmp_path):
    from barlake.operators import models

    grid = models.trial_grid(spark, ["ridge", "zero"], spark.createDataFrame([("a",), ("b",)], "symbol string"), 2, [1])
    assert grid.count() == 8
    one = grid.where("candidate = 'ridge' and symbol = 'a'")
    for state in ("started", "failed", "started"):
        models.record(one, state, str(tmp_path / "ledger"))
    models.record(grid.where("candidate = 'zero'"), "completed", str(tmp_path / "ledger"))
    left = models.open_trials(grid, spark.read.parquet(str(tmp_path / "ledger")), 2).collect()
    assert {(r["candidate"], r["symbol"]) for r in left} == {("ridge", "b")}


def test_cash_curve_is_summed_by_ranges(spark):
    rows = [(run, "ab"[k % 2], k * 7, 1.0 if k % 3 else -1.0, 10.0 + k, 0.5) for run in ("x", "y") for k in range(60)]
    fills = spark.createDataFrame(rows, "run_id string, instrument string, fill_seq long, quantity double, price double, commission double")
    got = {(r["run_id"], r["fill_seq"]): (r["cash"], r["commissions"], r["position"]) for r in p.cash_curve(fills, 1000.0, 50).collect()}
    assert len(got) == len(rows)
    for run in ("x", "y"):
        cash, fees, held = 1000.0, 0.0, {"a": 0.0, "b": 0.0}
        for _, i, seq, q, price, c in (r for r in rows if r[0] == run):
            cash, fees, held[i] = cash - q * price - c, fees + c, held[i] + q
            assert got[run, seq] == (pytest.approx(cash), pytest.approx(fees), held[i])
    wide = [line for line in p.cash_curve(fills, 1000.0)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line and "fill_seq" in line]
    assert wide and all("_range" in line or "instrument" in line.split("], [")[1] for line in wide)


def one(spark, rows, schema, use):
    return use(spark.createDataFrame(rows, schema)).first()


def test_intervals_by_hand(spark):
    rows = spark.createDataFrame([("a", 0.10, 0.02), ("a", 0.01, 0.02), ("a", 0.0, 0.0)], "symbol string, pred double, sigma double")
    q = spark.createDataFrame([("a", 2.0)], "symbol string, q double")
    got = {r["pred"]: (r["lower"], r["upper"], r["confidence"]) for r in metrics.intervals(rows, q, normalised=True).collect()}
    assert got[0.1] == pytest.approx((0.06, 0.14, 0.1 / 0.14)) and got[0.01] == pytest.approx((-0.03, 0.05, 0.2 * 0.5)) and got[0.0] == (0, 0, 0)
    plain = {r["pred"]: r["confidence"] for r in metrics.intervals(rows, q).collect()}
    assert plain[0.1] == pytest.approx(0.1 / 2.1 * 0.5)
    done = spark.createDataFrame([("a", 0.0, -1.0, 1.0), ("a", 3.0, -1.0, 1.0), ("a", 0.5, 0.0, 6.0)], "symbol string, target double, lower double, upper double")
    assert tuple(metrics.coverage(done).first())[1:] == pytest.approx((2 / 3, 2 / 3 - 0.9, 10 / 3, 2.0))


def test_adaptive_scores_use_sigma_and_report_residuals(spark):
    rows = [("a", t, 0.0, float(t), 2.0) for t in range(1, 11)]
    got = one(spark, rows, "symbol string, ts int, pred double, target double, sigma double", lambda r: metrics.conformal(r, 0.1, normalised=True))
    assert (got["q"], got["mean_residual"], got["median_residual"]) == (5.0, 5.5, 5.5)


def test_losses_by_hand(spark):
    import math

    rows = [("a", 0.5, 0.1), ("a", -0.5, 2.0)]
    got = one(spark, rows, "symbol string, pred double, target double", metrics.losses)
    r = [math.tanh(0.5) * 0.1, math.tanh(-0.5) * 2.0]
    mean, std = sum(r) / 2, abs(r[0] - r[1]) / math.sqrt(2)
    assert got["directional"] == pytest.approx((0.5 * 0.4**2 + 2 * (2.5 - 0.5)) / 2)
    assert got["neg_sharpe"] == pytest.approx(-mean / (std + 1e-6)) and got["neg_sortino"] == pytest.approx(-mean / math.sqrt(r[1] ** 2 / 2 + 1e-6))
    many = one(spark, [("a", [0.5, -0.5], [0.1, 2.0])], "symbol string, preds array<double>, targets array<double>", lambda x: metrics.multi_horizon_loss(x, [3.0, 1.0]))
    assert many["loss"] == pytest.approx(0.75 * 0.08 + 0.25 * 4.0)


def test_forecast_report_by_hand(spark):
    import math

    rows = [("a", 1, 1.0, 0.1), ("a", 2, 2.0, -0.2), ("a", 3, 3.0, 0.3)]
    got = one(spark, rows, "symbol string, ts int, pred double, target double", lambda r: metrics.forecast(r, 252.0))
    r = [math.tanh(p) * t for _, _, p, t in rows]
    mean = sum(r) / 3
    std = math.sqrt(sum((x - mean) ** 2 for x in r) / 3)
    assert got["sharpe"] == pytest.approx((mean - 0.04 / 252) / std * math.sqrt(252)) and got["volatility"] == pytest.approx(std * math.sqrt(252))
    assert got["rank_ic"] == pytest.approx(0.5) and got["max_drawdown"] == pytest.approx(r[1]) and got["accuracy"] == pytest.approx(2 / 3)


def test_deflated_probability(spark):
    import math
    from statistics import NormalDist, mean, stdev

    x = [0.01, -0.02, 0.03, 0.015, -0.005, 0.02, 0.0, 0.01]
    rows = spark.createDataFrame([("a", v) for v in x], "symbol string, ret double")
    n, m, s = len(x), mean(x), stdev(x)
    z = [v - m for v in x]
    m2, m3, m4 = (sum(v**k for v in z) / n for k in (2, 3, 4))
    skew = math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / m2**2 - 3 * (n - 1)) + 3
    N, e = NormalDist(), 0.5772156649015329
    best = 0.02 * ((1 - e) * N.inv_cdf(1 - 1 / 10) + e * N.inv_cdf(1 - 1 / (10 * math.e)))
    sr = m / s
    want = N.cdf((sr - best) * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurt - 1) * sr * sr / 4))
    assert metrics.deflated_probability(rows, 10, 0.0004).first()["probability"] == pytest.approx(want, abs=1e-6)
    for trials, variance in ((1, 0.01), (10, 0.0)):
        assert metrics.deflated_probability(rows, trials, variance).first()["probability"] is None


def test_calendar_folds_by_hand(spark):
    from barlake.operators import splits

    rows = spark.createDataFrame([("a", t, t + 1) for t in range(30)], "symbol string, ts long, target_ts long")
    got = splits.calendar_folds(rows, (10, 20, 28), 2, 3)
    roles = {}
    for r in got.collect():
        roles.setdefault(r["role"], []).append(r["ts"])
    assert {k: sorted(v) for k, v in roles.items()} == {"train": list(range(8)), "val": list(range(13, 18)), "test": list(range(23, 27))}
    assert {r["rule"] for r in splits.calendar_faults(got, rows, 5).collect()} == {"coverage"} and splits.calendar_faults(got, rows, 4).count() == 0
    longer = rows.withColumn("target_ts", F.col("ts") + 6)
    assert {r["rule"] for r in splits.calendar_faults(splits.calendar_folds(longer, (10, 20, 30), 2, 3), rows, 1).collect()} == {"overlap"}


def test_fees_and_impact_by_hand(spark):
    one_order = lambda q, limit, cap: spark.createDataFrame([(q, limit, 90.0 if limit else None, 110.0, 90.0, 100.0, 1000, cap)], "quantity double, is_limit boolean, limit_price double, high double, low double, close double, volume long, participation_cap double")
    got = p.impact_costs(one_order(500.0, False, 0.1)).first()
    slip = 100 * 2e-4 + 0.2 * 100 * (0.314 * 100 / 1e6 + 0.142 * 0.1**0.5)
    assert (got["fill_quantity"], got["slippage"], got["fill_price"], got["commission"]) == pytest.approx((100, slip, 100 + slip, 0.5))
    assert p.impact_costs(one_order(-500.0, False, None)).first()["fill_quantity"] == -50
    flat = p.impact_costs(one_order(100.0, False, 0.1), schedule=p.Schedule.flat(10.0, 1.0)).first()
    assert flat["commission"] == pytest.approx(100 * flat["fill_price"] * 1e-3)
    rebate = p.impact_costs(one_order(100.0, True, 0.1), traded=150_000.0).first()
    assert rebate["commission"] == pytest.approx(-0.2)


def test_run_without_a_closed_trade(spark):
    fills = spark.createDataFrame([("r", 1, 0, 10.0, 5.0, 1.0)], "run_id string, instrument int, fill_seq long, quantity double, price double, commission double")
    got = p.trade_statistics(p.fold_fills(fills), fills, 100.0).first()
    assert (got["total_trades"], got["closed_trades"], got["turnover"], got["hit_rate"], got["profit_factor"]) == (1, 0, 0.5, 0.0, 1.0)


def test_ledger_of_many_partial_closes(spark):
    """Against the rules applied fill by fill."""
    import random

    rng = random.Random(4)
    fills = [(rng.choice([-3.0, -1.0, 1.0, 2.0, 5.0, -4.0]), rng.uniform(5, 50), rng.uniform(0, 1)) for _ in range(300)]
    qty = price = fees = real = 0.0
    for r, (q, px, c) in zip(ledger(spark, fills), fills):
        pnl = None
        if qty == 0 or qty * q > 0:
            price, fees, qty = (abs(qty) * price + abs(q) * px) / abs(qty + q), fees + c, qty + q
        else:
            shut = min(abs(qty), abs(q))
            gross, paid, out = shut * (1 if qty > 0 else -1) * (px - price), fees * shut / abs(qty), c * shut / abs(q)
            pnl, real, after = gross - paid - out, real + gross, qty + q
            price, fees = (0.0, 0.0) if after == 0 else (price, fees - paid) if after * qty > 0 else (px, c - out)
            qty = after
        assert (r["qty"], r["price"], r["fees"], r["realized"]) == pytest.approx((qty, price, fees, real), abs=1e-8)
        assert (r["pnl"] is None) == (pnl is None) and (pnl is None or r["pnl"] == pytest.approx(pnl, abs=1e-8))


def test_closed_days_at_the_turn_of_the_year(spark):
    open_days = {str(r["date"]) for r in calendar.sessions(spark, "2021-12-29", "2023-01-04").collect()}
    assert "2021-12-31" not in open_days and "2022-12-30" in open_days and "2023-01-02" not in open_days and "2023-01-03" in open_days


def test_downsample_of_two_columns(spark):
    rows = [("a", i, float((i * 37) % 101), float((i * 53) % 103)) for i in range(1000)]
    got = {r["ts"] for r in core.downsample(spark.createDataFrame(rows, "symbol string, ts long, v double, w double"), ["v", "w"], 50).collect()}
    want, buckets = {0, 999}, 12
    for b in range(buckets):
        span = range(1 + b * 998 // buckets, 1 + (b + 1) * 998 // buckets)
        for c in (2, 3):
            want |= {min(span, key=lambda i: (rows[i][c], i)), max(span, key=lambda i: (rows[i][c], i))}
    assert got == want


def test_whole_series_ema(spark):
    from barlake.operators import features

    closes = [10 + (i * 7919 % 1000) / 100 for i in range(700)]
    bars = spark.createDataFrame([("a", i, c) for i, c in enumerate(closes)], "symbol string, ts long, close double")
    for period in (3, 12):
        got = {r["ts"]: r["ema"] for r in features.full_ema(bars, period).collect()}
        e = sum(closes[:period]) / period
        for i in range(period - 1, len(closes)):
            if i >= period:
                e += 2 / (period + 1) * (closes[i] - e)
            assert got[i] == pytest.approx(e, rel=1e-12)
        assert len(got) == len(closes) - period + 1


def test_ridge_equals_the_normal_equations(spark):
    import numpy as np
    from barlake.operators import models

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2)) * [3.0, 0.2] + 1
    y = x @ [0.5, -2.0] + rng.normal(size=60) / 10
    rows = [("a", i, float(a), float(b), float(t), 0, "train" if i < 40 else "test") for i, ((a, b), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "symbol string, ts long, u double, v double, target double, fold int, role string")
    out = models.walk(df, lambda t: models.ridge(t, ["u", "v"], 2.0), ["u", "v"], "ridge", [0]).orderBy("ts").collect()
    z = (x - x[:40].mean(0)) / x[:40].std(0)
    w = np.linalg.solve(z[:40].T @ z[:40] + 2.0 * np.eye(2), z[:40].T @ (y[:40] - y[:40].mean()))
    assert [r["pred"] for r in out] == pytest.approx(list(z[40:] @ w + y[:40].mean()))
    wide, names = models.flattened(df, ["u"], 3)
    got = wide.orderBy("ts").first()
    assert names == ["u_0", "u_1", "u_2"] and [got[c] for c in names] == pytest.approx(list(x[[2, 1, 0], 0])) and wide.count() == 58


def test_boosted_trees_predict_every_fold(spark):
    from barlake.operators import models

    rows = [("a", i, float(i % 7), float((i % 7) ** 2), k, "train" if i < 40 else "test") for k in (0, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, ts long, u double, target double, fold int, role string")
    out = models.walk(df, lambda t: models.boosted(t, ["u"], 10), ["u"], "boosted", [0, 1]).collect()
    assert {(r["fold"], r["ts"]) for r in out} == {(k, i) for k in (0, 1) for i in range(40, 60)}
    assert max(abs(r["pred"] - r["target"]) for r in out) < 3
