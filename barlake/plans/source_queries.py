"""Manifests, training tables, the calendar and models over the derived bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dq, joins, models, splits
from ..operators import features as f
from ..sources import calendar, io
from ..sources import fixtures as x
from .base import BARS, register, rnd, rounded
from .feature_queries import _BASE, _TARGET


@register("io7_fingerprint", f"""WITH {BARS}, h AS (SELECT symbol, ts, ts // 86400 AS day, sha256(concat_ws('|', ts, open, high, low, close, volume)) AS h FROM bars),
d AS (SELECT symbol, day, count(*) AS n, min(ts) AS a, max(ts) AS z, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1, 2)
SELECT symbol, CAST(sum(n) AS BIGINT) AS rows, min(a) AS first_ts, max(z) AS last_ts, sha256(string_agg(h, '' ORDER BY day)) AS sha256 FROM d GROUP BY 1""")
def io7(spark, d):
    return io.fingerprint(x.hourly_bars(spark, d))


FEATURES = ["sma_20", "rsi_14", "log_return_1"]


def labelled(spark, d):
    bars = x.hourly_bars(spark, d)
    return joins.label(f.baseline(bars), f.targets(bars))


@register("io10_training_table", f"""WITH {_BASE}, {_TARGET} SELECT symbol, f.ts AS timestamp, target_ts AS target_timestamp, 1 AS feature_set_version, 1 AS target_horizon, round(CAST(CAST(target AS FLOAT) AS DOUBLE), 4) + 0.0 AS target, {', '.join(f'round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 3) + 0.0 AS {c}' for c in ('sma_20', 'rsi_14', 'log_return_1'))}
FROM features f JOIN targets t USING (symbol, ts) WHERE target_ts IS NOT NULL""")
def io10(spark, d):
    out = io.training_table(labelled(spark, d), FEATURES, 1, 1).drop("asset_id")
    return out.withColumns({"target": F.round(F.col("target").cast("double"), 4) + 0.0, **{c: F.round(F.col(c).cast("double"), 3) + 0.0 for c in FEATURES}})


@register("io11_training_contract", f"""WITH {_BASE}, {_TARGET}, t AS (SELECT symbol, f.ts, CASE WHEN f.ts % 86400 = 0 THEN f.ts ELSE target_ts END AS target_ts, CASE WHEN f.ts % 86400 = 3600 THEN NULL ELSE target END AS target FROM features f JOIN targets t USING (symbol, ts) WHERE target_ts IS NOT NULL)
SELECT symbol, ts, unnest(list_filter([CASE WHEN target IS NULL THEN 'null' END, CASE WHEN target_ts <= ts THEN 'target before' END], lambda v: v IS NOT NULL)) AS rule FROM t""")
def io11(spark, d):
    rows = labelled(spark, d).withColumns(
        {"target_ts": F.when(F.col("ts") % 86400 == 0, F.col("ts")).otherwise(F.col("target_ts")), "target": F.when(F.col("ts") % 86400 != 3600, F.col("target")), "feature_set_version": F.lit(1), "target_horizon": F.lit(1)}
    )
    return dq.training_contract(rows, FEATURES)


def _holidays() -> str:
    """Rules of the closed days as conditions on a date ``d``: (month, day, weekday with 1 Monday)."""
    on = lambda *c: "(" + " AND ".join(c) + ")"
    m, day, wd = "month(d) = {}", "day(d) = {}", "isodow(d) = {}"
    rules = [on(m.format(1), day.format(1)), on(m.format(1), day.format(2), wd.format(1)), on(m.format(12), day.format(31), wd.format(5))]
    rules += [on(m.format(k), wd.format(1), "day(d) BETWEEN 15 AND 21") for k in (1, 2)]
    rules += [on(m.format(5), wd.format(1), "day(d) >= 25"), on(m.format(9), wd.format(1), "day(d) <= 7"), on(m.format(11), wd.format(4), "day(d) BETWEEN 22 AND 28")]
    for month, dom, more in ((6, 19, "year(d) >= 2021"), (7, 4, "true"), (12, 25, "true")):
        rules += [on(m.format(month), more, f"(day(d) = {dom} OR (day(d) = {dom + 1} AND isodow(d) = 1) OR (day(d) = {dom - 1} AND isodow(d) = 5))")]
    # Good Fridays
    good = "2019-04-19 2020-04-10 2021-04-02 2022-04-15 2023-04-07 2024-03-29 2025-04-18 2026-04-03 2027-03-26 2028-04-14".split()
    rules.append("d IN (" + ", ".join(f"DATE '{g}'" for g in good) + ")")
    return " OR ".join(rules)


@register("io14_sessions", f"""WITH b AS (SELECT min(ts)::DATE AS a FROM events), s AS (SELECT unnest(generate_series(make_date(year(a) - 5, 1, 1), make_date(year(a) + 4, 12, 31), INTERVAL 1 DAY))::DATE AS d FROM b),
o AS (SELECT d, month(d) = 7 AND day(d) = 3 OR month(d) = 12 AND day(d) = 24 OR month(d) = 11 AND isodow(d) = 5 AND day(d) BETWEEN 23 AND 29 AS early,
  d >= (make_date(year(d), 3, 8) + CAST((7 - isodow(make_date(year(d), 3, 8))) % 7 AS INT)) AND d < (make_date(year(d), 11, 1) + CAST((7 - isodow(make_date(year(d), 11, 1))) % 7 AS INT)) AS summer FROM s WHERE isodow(d) <= 5 AND NOT ({_holidays()})),
t AS (SELECT d, early, epoch(d)::BIGINT + 52200 - CASE WHEN summer THEN 3600 ELSE 0 END AS open_ts, CASE WHEN early THEN 12600 ELSE 23400 END AS length FROM o)
SELECT CAST(d AS VARCHAR) AS date, open_ts, open_ts + length AS close_ts, early AS is_early_close, lead(open_ts) OVER (ORDER BY d) AS next_open_ts, CAST(lag(d) OVER (ORDER BY d) AS VARCHAR) AS prev_date, CAST(lead(d) OVER (ORDER BY d) AS VARCHAR) AS next_date FROM t""")
def io14(spark, d):
    year = x.table(spark, d, "events").agg(F.year(F.min("ts")).alias("year"))
    day = lambda k, m, n: F.make_date(F.col("year") + k, F.lit(m), F.lit(n))
    text = lambda c: F.col(c).cast("string").alias(c)
    return calendar.sessions(spark, day(-5, 1, 1), day(4, 12, 31), of=year).select(text("date"), "open_ts", "close_ts", "is_early_close", "next_open_ts", text("prev_date"), text("next_date"))


LOOKBACK = 5


def folds(spark, d):
    """Walk-forward folds of flattened windows of all baseline features, and the names of their columns."""
    rows, names = models.flattened(labelled(spark, d), list(f.BASELINE), LOOKBACK)
    return splits.walk_forward(rows, 3, 1, 2), names


@register("ml1_zero", f"WITH {BARS} SELECT symbol, ts, 0.0::DOUBLE AS pred FROM bars")
def ml1(spark, d):
    return models.zero(x.hourly_bars(spark, d)).select("symbol", "ts", "pred")


@register("ml2_ridge")
def ml2(spark, d):
    rows, names = folds(spark, d)
    out = models.walk(rows, lambda t: models.ridge(t, names, 1.0), names, "ridge", [0, 1, 2])
    return rounded(out.select("symbol", "ts", "fold", "model_id", "pred", "target"))


@register("ml3_boosted")
def ml3(spark, d):
    rows, names = folds(spark, d)
    out = models.walk(rows, lambda t: models.boosted(t, names, 20), names, "boosted", [0, 1, 2])
    return rounded(out.select("symbol", "ts", "fold", "model_id", "pred", "target"))
