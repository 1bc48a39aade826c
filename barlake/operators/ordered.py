"""Scans along one long key, in stretches of time.

A window over a key is one task.  Up to ``MOST`` rows that is no burden; a longer
key is cut in time into cells of about so many rows.  A cell is scanned on its own
and what it takes from the cells before or after it is a small table, one row a cell.
Cells come from each long key's count and bounds alone, so they are the same whenever
they are worked out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 1 << 20


def cells(rows: DataFrame, key: str, at: str, most: int = MOST) -> DataFrame:
    """``rows`` with ``_cell``: 0 for a key of at most ``most`` rows, else its stretch of time, numbered in order.

    The long keys are broadcast: there is at most one for ``most`` rows.
    """
    n = F.count("*")
    long = rows.groupBy(key).agg(n.alias("_c"), F.min(at).alias("_a"), F.max(at).alias("_z")).where(F.col("_c") > most)
    cut = F.floor((F.col(at) - F.col("_a")) / (F.col("_z") - F.col("_a") + 1) * F.ceil(F.col("_c") / most))
    return rows.join(F.broadcast(long), key, "left").withColumn("_cell", F.coalesce(cut, F.lit(0)).cast("long")).drop("_c", "_a", "_z")


def carried(rows: DataFrame, key: str, backwards: bool = False, **totals: Column) -> DataFrame:
    """``rows`` with, by name, the aggregate of each total over all cells before (after) their own; null where there is none.

    Each total is an aggregate of the rows that may be aggregated again under its
    name: a sum, minimum or maximum, told by its function's name.
    """
    again = {"sum": F.sum, "min": F.min, "max": F.max}
    kinds = {name: name.split("_")[-1] for name in totals}
    ends = rows.groupBy(key, "_cell").agg(*(c.alias(name) for name, c in totals.items()))
    order = F.desc("_cell") if backwards else F.asc("_cell")
    others = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(key, "_cell", *(again[kinds[name]](name).over(others).alias(name) for name in totals))
    some = F.greatest(*(F.col(name).isNotNull().cast("int") for name in totals), F.lit(0)) == 1
    return rows.join(ends.where(some), [key, "_cell"], "left")


def numbered(rows: DataFrame, key: str, at: str, most: int = MOST, name: str = "_n") -> DataFrame:
    """``rows`` with their place, from 0, in the order of ``at`` within their key."""
    rows = carried(cells(rows, key, at, most), key, _before_sum=F.count("*"))
    place = F.row_number().over(Window.partitionBy(key, "_cell").orderBy(at)) - 1
    return rows.withColumn(name, place + F.coalesce("_before_sum", F.lit(0))).drop("_before_sum", "_cell")
