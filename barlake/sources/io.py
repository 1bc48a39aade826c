"""Readers of landed files and write-once sinks with manifests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import core, dq

# Fixed value: the header of an OHLCV file.
OHLCV = "timestamp string, open double, high double, low double, close double, volume bigint"
#: An RFC 3339 time with its zone.
RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
#: A journal record; its event stays text until parse_event, as its names differ in case only.
JOURNAL = (
    "schema_version int, seq bigint, session_id string, received_at_ms bigint, previous_checksum string, checksum string, type string, feed string, symbols array<string>, event string"
)
# The short names of an event's fields.
TEXT_FIELDS = {"kind": "T", "symbol": "S", "time": "t", "action": "a"}
NUMBER_FIELDS = {"o": "o", "h": "h", "l": "l", "c": "c", "v": "v", "p": "p", "size": "s", "bp": "bp", "ap": "ap", "bs": "bs", "as_size": "as", "op": "op", "cp": "cp", "os": "os", "cs": "cs"}
# Fixed value: a vendor's envelope.
ENVELOPE = "status string, meta struct<symbol:string,exchange:string,currency:string,exchange_timezone:string,interval:string,type:string>, `values` array<struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>>"


def _symbol():
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)\.csv[^/]*$", 1)


def read_ohlcv(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Strict OHLCV files, one symbol each by file name, within [start, end) epoch seconds.

    All rows are checked before the range is taken, so a bad one isn't hidden: a
    field that doesn't parse, a time without zone or out of order, a price that
    isn't sound fails.
    """
    rows = spark.read.schema(OHLCV).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    at = F.when(F.col("timestamp").rlike(RFC3339), F.unix_seconds(F.to_timestamp("timestamp"))).otherwise(F.raise_error(F.lit("a time needs its zone")).cast("long"))
    rows = rows.select(_symbol().alias("symbol"), at.alias("ts"), "open", "high", "low", "close", "volume").withColumn("avail_ts", F.col("ts"))
    dq.assert_clean(dq.bars_sound(rows.withColumn("row_seq", F.monotonically_increasing_id())))
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    return rows if end is None else rows.where(F.col("ts") < end)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """OHLCV files whose times may be plain dates, which become 21:00 UTC."""
    rows = spark.read.schema(OHLCV).option("header", True).csv(path)
    plain = F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\d$")
    at = F.when(plain, F.unix_seconds(F.to_timestamp(F.concat("timestamp", F.lit("T21:00:00Z"))))).otherwise(F.unix_seconds(F.try_to_timestamp("timestamp")))
    return rows.select(_symbol().alias("symbol"), at.alias("ts"), "open", "high", "low", "close", "volume").where("ts is not null").withColumn("avail_ts", F.col("ts"))


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """Corporate actions: rows with too few fields, a bad date or an unknown kind go; a bad value is 0."""
    rows = spark.read.schema("date string, action_type string, value string").option("header", True).csv(path)
    day = F.try_to_date("date", "yyyy-MM-dd")
    kind = F.lower(F.trim("action_type"))
    out = rows.where("value is not null and action_type is not null").select(
        _symbol().alias("symbol"), F.unix_seconds(day.cast("timestamp")).alias("effective_ts"), kind.alias("kind"), F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)).alias("amount")
    )
    return out.where("effective_ts is not null and kind in ('split', 'dividend')")


def read_envelopes(spark: SparkSession, path: str, market: dict[str, str], now: int, start: int, end: int) -> DataFrame:
    """Vendor envelopes as bars: identity as in ``market``, text prices cast, bars of the future dropped.

    A minute's bar closes a minute after its start, a day's at the next local midnight.
    """
    rows = spark.read.schema(ENVELOPE).option("multiLine", True).json(path).where("status = 'ok'")
    for k, v in market.items():
        rows = rows.where(F.col(f"meta.{k}") == v)
    rows = rows.select("meta", F.explode("values").alias("v"))
    zone = F.col("meta.exchange_timezone")
    minute = F.unix_seconds(F.to_utc_timestamp("v.datetime", zone)) + 60
    day = F.unix_seconds(F.to_utc_timestamp(F.date_add(F.to_date(F.substring("v.datetime", 1, 10)), 1).cast("timestamp"), zone))
    at = F.when(F.col("meta.interval") == "1min", minute).otherwise(day)
    out = rows.select(F.col("meta.symbol").alias("symbol"), at.alias("ts"), *(F.col(f"v.{c}").cast("double").alias(c) for c in ("open", "high", "low", "close")), F.col("v.volume").cast("double").cast("long").alias("volume"))
    out = out.withColumn("avail_ts", F.col("ts")).where((F.col("ts") >= start) & (F.col("ts") < end) & (F.col("ts") <= now))
    dq.assert_clean(dq.bars_sound(out.withColumn("row_seq", F.col("ts"))))
    return out.orderBy("symbol", "ts")


def parse_event(records: DataFrame) -> DataFrame:
    """``event`` as a struct; fields that a kind doesn't have, or that don't parse, are null."""
    get = lambda k: F.get_json_object("event", f"$.{k}")
    texts = [get(k).alias(c) for c, k in TEXT_FIELDS.items()]
    return records.withColumn("event", F.struct(*texts, *(get(k).try_cast("double").alias(c) for c, k in NUMBER_FIELDS.items())))


def minute_bars(records: DataFrame) -> DataFrame:
    """First-publication minute bars of journal records; a bar that came before its close is left out."""
    start = F.unix_millis(F.try_to_timestamp("event.time"))
    rows = records.where("type = 'market' and event.kind = 'b'")
    rows = rows.select(F.col("event.symbol").alias("symbol"), F.floor(start / 1000 + 60).alias("ts"), *(F.col(f"event.{a}").alias(b) for a, b in zip("ohlc", ("open", "high", "low", "close"))), F.col("event.v").cast("long").alias("volume"), F.col("received_at_ms").alias("avail_ms"))
    return rows.where(F.col("avail_ms") >= F.col("ts") * 1000).withColumn("avail_ts", F.ceil(F.col("avail_ms") / 1000))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A journal's records as :func:`dq.audit` takes them, with their text."""
    rows = spark.read.text(path).withColumnRenamed("value", "line").where("trim(line) <> ''")
    r = rows.select("line", F.from_json("line", JOURNAL + ", reason string").alias("r")).select("line", "r.*")
    return r.withColumn("symbol", F.get_json_object("event", "$.S"))


def import_minutes(records: DataFrame, sessions: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    """A symbol's regular-session minute bars of a closed range of dates, every publication of each.

    ``sessions`` as of :func:`calendar.sessions`.  Check them with
    :func:`dq.import_gate` and :func:`dq.minutes_continue` before use.
    """
    rows = minute_bars(records).where((F.col("symbol") == symbol) & F.to_date(F.timestamp_seconds(F.col("ts") - 60)).between(start, end))
    return core.regular_minutes(rows, sessions)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return parse_event(spark.read.schema(JOURNAL).json(path))


def fingerprint(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Count, bounds and a content hash per symbol: rows hashed, then hours of rows, then hours, so that no list is long."""
    row = F.sha2(F.concat_ws("|", "ts", "open", "high", "low", "close", "volume"), 256)
    parts = bars.withColumn("_h", row).groupBy(key, F.floor(F.col("ts") / 86400).alias("day")).agg(
        F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"), F.sha2(F.concat_ws("", F.sort_array(F.collect_list("_h"))), 256).alias("h")
    )
    return parts.groupBy(key).agg(
        F.sum("n").alias("rows"), F.min("a").alias("first_ts"), F.max("z").alias("last_ts"), F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("day", "h"))), lambda x: x["h"])), 256).alias("sha256")
    )


def write_version(bars: DataFrame, root: str, version: str) -> DataFrame:
    """Write a version once, its manifest last; the rows written must be those counted."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.\-]*", version):
        raise ValueError("not a portable version name")
    dq.assert_clean(dq.duplicates(bars))
    bars.write.mode("errorifexists").partitionBy("symbol").parquet(f"{root}/{version}/bars")
    written = bars.sparkSession.read.schema(bars.schema).parquet(f"{root}/{version}/bars")
    manifest = fingerprint(written).withColumn("version", F.lit(version))
    manifest.write.mode("errorifexists").parquet(f"{root}/{version}/manifest")
    return bars.sparkSession.read.parquet(f"{root}/{version}/manifest")


def read_version(spark: SparkSession, root: str, version: str, schema) -> DataFrame:
    """A version's bars, once their count and hash equal the manifest's."""
    bars = spark.read.schema(schema).parquet(f"{root}/{version}/bars")
    there = spark.read.parquet(f"{root}/{version}/manifest").select(F.col("symbol").alias("s"), F.col("rows").alias("n"), F.col("sha256").alias("h"))
    now = fingerprint(bars)
    differs = now.join(there, now["symbol"] == there["s"], "full").where("s is null or symbol is null or rows <> n or sha256 <> h")
    if (bad := differs.head(1)) != []:
        raise ValueError(f"the version differs from its manifest: {bad[0].asDict()}")
    dq.assert_clean(dq.bars_sound(bars.withColumn("row_seq", F.col("ts"))))
    return bars


def write_features(features: DataFrame, root: str, feature_set: str, version: int) -> None:
    """A version of a feature set, written once, partitioned by symbol; ``ts`` must not be null, its columns keep their ids."""
    guard = F.when(F.col("ts").isNull(), F.raise_error(F.lit("a feature row has no time")).cast("long")).otherwise(F.col("ts"))
    out = features.withColumn("ts", guard)
    out.write.mode("errorifexists").partitionBy("symbol").parquet(f"{root}/feature_set={feature_set}/version={version}")


def training_table(labelled: DataFrame, features: list[str], version: int, horizon: int) -> DataFrame:
    """Labelled rows as float32 with asset id, version and horizon; an absent feature is 0."""
    asset = F.pmod(F.xxhash64("symbol"), F.lit(1 << 31))
    return labelled.select(
        "symbol", F.col("ts").alias("timestamp"), F.col("target_ts").alias("target_timestamp"), F.col("target").cast("float"), asset.alias("asset_id"), F.lit(version).alias("feature_set_version"), F.lit(horizon).alias("target_horizon"), *(F.coalesce(c, F.lit(0.0)).cast("float").alias(c) for c in features)
    )


def training_manifest(rows: DataFrame, features: list[str]) -> DataFrame:
    """``(row_count, feature_columns, content_hash)`` of a training table, whatever the order of its rows."""
    cells = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("symbol", "timestamp", "target_timestamp", "target", *sorted(features))))
    digest = F.sum(F.conv(F.substring(F.sha2(cells, 256), 1, 15), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.count("*").alias("row_count"), F.array(*map(F.lit, sorted(features))).alias("feature_columns"), F.coalesce(digest.cast("string"), F.lit("0")).alias("content_hash"))


def training_differs(rows: DataFrame, features: list[str], manifest: DataFrame) -> DataFrame:
    """``(rule)``: in what a training table differs from its manifest, a row of :func:`training_manifest`, and whether it is empty."""
    now = training_manifest(rows, features).select(F.struct("*").alias("n"))
    both = now.join(F.broadcast(manifest.select(F.struct("row_count", "feature_columns", "content_hash").alias("m"))))
    rules = {
        "empty": F.col("n.row_count") == 0,
        "row count": F.col("n.row_count") != F.col("m.row_count"),
        "feature columns": F.col("n.feature_columns") != F.sort_array("m.feature_columns"),
        "content": F.col("n.content_hash") != F.col("m.content_hash"),
    }
    return both.select(F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))


def write_run(tables: dict[str, DataFrame], root: str) -> None:
    """A run's series (equity, trades, positions, ...), each partitioned by run, and last its manifest.

    A run that is written again replaces what there was of it in each table that has
    rows of it; other runs stay.
    """
    counts = None
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{name}")
        n = rows.groupBy("run_id").agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        counts = n if counts is None else counts.union(n)
    counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/manifest")


def completed_runs(spark: SparkSession, root: str) -> DataFrame:
    """``(completed_runs)``: how many runs have a manifest."""
    return spark.read.parquet(f"{root}/manifest").agg(F.count_distinct("run_id").alias("completed_runs"))


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """All manifests under a root, newest versions last."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{root}/*/manifest").orderBy("version", "symbol")
