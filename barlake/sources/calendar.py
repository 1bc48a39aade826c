"""Trading sessions of US equities as a generated dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar by integer arithmetic."""
    div = lambda a, b: F.floor(a / b)
    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(b - div(b + 8, 25) + 1, 3)
    h = (19 * a + b - d - g + 15) % 30
    k = (32 + 2 * e + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * k, 451)
    n = h + k - 7 * m + 114
    return F.make_date(year, div(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def _nth(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (0 Monday) of a month; n = -1 the last."""
    if n > 0:
        first = F.make_date(year, F.lit(month), F.lit(1))
        return F.date_add(first, ((weekday - F.weekday(first) + 7) % 7 + 7 * (n - 1)).cast("int"))
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(end, ((F.weekday(end) - weekday + 7) % 7).cast("int"))


def _observed(day: Column) -> Column:
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def holidays(year: Column) -> Column:
    """Full-day holidays of a year; New Year's Day on a Saturday closes the Friday before, of this year; Juneteenth counts from 2021."""
    fixed = lambda m, d: F.make_date(year, F.lit(m), F.lit(d))
    new_year = F.when(F.weekday(fixed(1, 1)) == 6, F.date_add(fixed(1, 1), 1)).when(F.weekday(fixed(1, 1)) < 5, fixed(1, 1))
    days = [
        new_year,
        F.when(F.weekday(fixed(12, 31)) == 4, fixed(12, 31)),
        _nth(year, 1, 0, 3),
        _nth(year, 2, 0, 3),
        F.date_sub(easter(year), 2),
        _nth(year, 5, 0, -1),
        F.when(year > 2020, _observed(fixed(6, 19))),
        _observed(fixed(7, 4)),
        _nth(year, 9, 0, 1),
        _nth(year, 11, 3, 4),
        _observed(fixed(12, 25)),
    ]
    return F.array_compact(F.array(*days))


def early_closes(year: Column) -> Column:
    """Days that close at 13:00: before Independence Day, after Thanksgiving, Christmas Eve."""
    day = lambda m, d: F.make_date(year, F.lit(m), F.lit(d))
    return F.array(day(7, 3), F.date_add(_nth(year, 11, 3, 4), 1), day(12, 24))


def sessions(spark: SparkSession, start: str | Column, end: str | Column, extra: tuple[str, ...] = (), zone: str = "America/New_York", of: DataFrame | None = None) -> DataFrame:
    """``(date, open_ts, close_ts, is_early_close, next_open_ts, prev_date, next_date)`` of a closed range of dates.

    Times are epoch seconds; 09:30 to 16:00 in the zone, daylight saving included.
    ``extra`` names further closed days.  The range's ends may be columns of ``of``, a table of one row.
    """
    one = spark.range(1) if of is None else of
    days = one.select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    closed = F.array_contains(holidays(F.year("date")), F.col("date"))
    if extra:
        closed = closed | F.col("date").isin([*extra])
    days = days.where((F.weekday("date") < 5) & ~closed)
    early = F.array_contains(early_closes(F.year("date")), F.col("date"))
    at = lambda t: F.unix_seconds(F.to_utc_timestamp(F.concat_ws(" ", F.col("date").cast("string"), t), zone))
    days = days.select("date", at(F.lit("09:30:00")).alias("open_ts"), at(F.when(early, "13:00:00").otherwise("16:00:00")).alias("close_ts"), early.alias("is_early_close"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # some 250 rows a year
    return days.withColumns({"next_open_ts": F.lead("open_ts").over(w), "prev_date": F.lag("date").over(w), "next_date": F.lead("date").over(w)})
