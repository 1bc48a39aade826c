"""Features as specifications, compiled to one pass over sorted partitions.

A :class:`FeatureSpec` says what a feature looks at: columns of the bars or other
features, a number of rows back.  :func:`compile_features` orders the specifications
by dependency and makes one window step and one projection of each level.  All share
partitioning and order, so there is one shuffle and one sort whatever their number.

Values of earlier rows are offset columns that can't be null (NaN where there is
none), so that the dot products over them compile to plain arithmetic in methods
small enough for the JVM to optimise.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAN = float("nan")
META = "feature"


class Past:
    """Hands a specification the columns for what it looks at, and keeps them for the window step."""

    def __init__(self, key: str) -> None:
        self.order = Window.partitionBy(key).orderBy("ts")
        self.asked: dict[str, Column] = {}

    def __call__(self, c: str, k: int = 0) -> Column:
        """The value of ``c`` k rows before, NaN where there is none."""
        if not k:
            return F.col(c)
        return self._ask(f"_{c}_{k}", F.lag(c, k, NAN).over(self.order))

    def values(self, c: str, n: int) -> list[Column]:
        """The last n values of ``c``, oldest first."""
        return [self(c, k) for k in range(n - 1, -1, -1)]

    def frame(self, how: str, c: str, n: int) -> Column:
        """An aggregate of the last n values, by its name in ``functions``."""
        return self._ask(f"_{how}_{c}_{n}", getattr(F, how)(c).over(self.order.rowsBetween(1 - n, 0)))

    def _ask(self, name: str, c: Column) -> Column:
        self.asked.setdefault(name, c)
        return F.col(name)


@dataclass(frozen=True)
class FeatureSpec:
    """A named, versioned feature: ``expr`` of the :class:`Past` of its ``inputs``.

    ``lookback`` counts rows, its own included; ``offset`` seconds pass between a
    bar's availability and the feature's.  A ``helper`` is for others to look at.
    """

    name: str
    version: int
    lookback: int
    inputs: tuple[str, ...]
    expr: Callable[[Past], Column]
    offset: int = 0
    helper: bool = False

    @property
    def id(self) -> str:
        return f"{self.name}@v{self.version}"


class FeatureRegistry(dict):
    """Features by name; another version of a known name is an error."""

    def add(self, spec: FeatureSpec) -> FeatureSpec:
        if spec.name in self and self[spec.name].version != spec.version:
            raise ValueError(f"{spec.name} is registered as {self[spec.name].id}")
        self[spec.name] = spec
        return spec

    def needed(self, names: Iterable[str]) -> list[FeatureSpec]:
        """The named features and all that they look at, inputs first."""
        out: dict[str, FeatureSpec] = {}

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError(f"features look at each other: {' -> '.join([*above, name])}")
            if name in self and name not in out:
                for i in self[name].inputs:
                    visit(i, (*above, name))
                out[name] = self[name]

        for name in names:
            if name not in self:
                raise ValueError(f"{name} isn't registered")
            visit(name, ())
        return list(out.values())


def depth(specs: list[FeatureSpec]) -> dict[str, tuple[int, int, int]]:
    """(level, lookback in bars, offset) of each, its inputs' included; ``specs`` with inputs first."""
    out: dict[str, tuple[int, int, int]] = {}
    for s in specs:
        below = [out[i] for i in s.inputs if i in out]
        level = 1 + max((b[0] for b in below), default=-1)
        out[s.name] = (level, s.lookback + max((b[1] - 1 for b in below), default=0), max([s.offset, *(b[2] for b in below)]))
    return out


def compile_features(bars: DataFrame, names: Iterable[str], registry: FeatureRegistry, key: str = "symbol", keep: tuple[str, ...] = ("close",)) -> DataFrame:
    """``(key, ts, keep, names)`` of the bars at which every feature is defined.

    ``bars(key, ts, avail_ts, ...)``.  ``ts`` becomes the time from which the row may
    be used: the bar's availability and the largest offset.  A row on which a feature
    is null or NaN goes.  Each feature's column carries its id, lookback and offset
    as metadata, which Parquet keeps.
    """
    names = list(names)
    specs = registry.needed(names)
    known = depth(specs)
    rows, have = bars, set(bars.columns)
    missing = {i for s in specs for i in s.inputs} - have - set(known)
    if missing or have & set(known):
        raise ValueError(f"no such columns: {sorted(missing)}" if missing else f"bars have columns named as features: {sorted(have & set(known))}")
    for level in range(1 + max((v[0] for v in known.values()), default=-1)):
        here = [s for s in specs if known[s.name][0] == level]
        doubles = {c for c, t in rows.dtypes if t == "double" and any(c in s.inputs for s in here)}
        past = Past(key)
        made = {s.name: s.expr(past) for s in here}
        rows = rows.withColumns({c: F.coalesce(c, F.lit(NAN)) for c in doubles})
        base = rows.columns
        if level == 0:
            past.asked["_row"] = F.row_number().over(past.order)
            base = [*base, "_row"]
        rows = rows.select("*", *(c.alias(n) for n, c in past.asked.items()))
        rows = rows.select(*base, *(c.alias(n) for n, c in made.items()))
    least, offset = (max((known[n][k] for n in names), default=0) for k in (1, 2))
    # past a number made in the projection no predicate moves down, where it would work out every feature again
    rows = rows.withColumn("_number", F.monotonically_increasing_id())
    defined = (F.col("_row") >= least) & (F.col("_number") >= 0)
    for n in names:
        defined = defined & F.col(n).isNotNull() & ~F.isnan(n)
    meta = lambda n: {META: registry[n].id, "lookback": known[n][1], "offset": known[n][2]}
    at = (F.col("avail_ts") + offset).alias("ts")
    return rows.where(defined).select(key, at, *keep, *(F.col(n).alias(n, metadata=meta(n)) for n in names))


def stored_ids(rows: DataFrame) -> dict[str, str]:
    """The feature ids that the columns carry, by column."""
    return {f.name: f.metadata[META] for f in rows.schema.fields if META in f.metadata}


def check_versions(rows: DataFrame, registry: FeatureRegistry) -> DataFrame:
    """``rows``, if no column was made by another version of a registered feature."""
    wrong = {c: i for c, i in stored_ids(rows).items() if c in registry and registry[c].id != i}
    if wrong:
        raise ValueError("stored features of another version: " + json.dumps({c: [i, registry[c].id] for c, i in wrong.items()}))
    return rows


def read_features(spark: SparkSession, path: str, registry: FeatureRegistry) -> DataFrame:
    """Stored features, refused if one of them is of another version than the registered one."""
    return check_versions(spark.read.parquet(path), registry)
