"""Candles from ticks, files and JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "symbol string, bar bigint, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def numbered(df: DataFrame) -> DataFrame:
    """df (symbol, ts, ...) with bar: its place from 0 in its symbol."""
    return df.withColumn("bar", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).cast("bigint"))


def resample(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Candles (SCHEMA) from ticks (symbol, ts, tick, price, volume); `tick` breaks ties of ts. Empty intervals have no candle.

    One aggregation with partial sums; first and last prices are minima and maxima by (ts, tick).
    """
    order = F.struct("ts", "tick")
    bars = ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    return numbered(bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")).select("symbol", "bar", "ts", "open", "high", "low", "close", "volume")


def walk(spark: SparkSession, sf_dir: str, single: bool = False) -> DataFrame:
    """Ticks from events: a price walk in whole cents, one for each event type (or one for all)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    symbol = F.lit("ALL") if single else F.col("event_type")
    cents = F.round(F.col("value") * 100).cast("bigint")
    w = Window.partitionBy("symbol").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select(symbol.alias("symbol"), "ts", "event_id", cents.alias("cents")).withColumn("price", (F.lit(10_000_000) + F.sum(F.col("cents") - 5000).over(w)) / 100.0).select(
        "symbol", "ts", F.col("event_id").alias("tick"), "price", "cents", (F.col("cents") / 100.0).alias("volume"))


def candles(spark: SparkSession, sf_dir: str, single: bool = False, width: str = "1 hour") -> DataFrame:
    bars = resample(walk(spark, sf_dir, single).withColumn("volume", F.col("cents")), width)
    return bars.withColumn("volume", F.col("volume") / 100.0)


def oracle(single: bool = False) -> list[str]:
    """CTEs that end in `candles`."""
    symbol = "'ALL'" if single else "event_type"
    return [
        f"ticks AS (SELECT {symbol} AS symbol, ts, event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events)",
        "walked AS (SELECT *, (10000000 + sum(cents - 5000) OVER (PARTITION BY symbol ORDER BY ts, event_id)) / 100.0 AS price FROM ticks)",
        "hourly AS (SELECT symbol, time_bucket(INTERVAL 1 hour, ts) AS ts, arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close, sum(cents) / 100.0 AS volume FROM walked GROUP BY ALL)",
        "candles AS (SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS BIGINT) AS bar, ts, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume FROM hourly)",
    ]


def chunk_ranges(spark: SparkSession, start: str, end: str, days: int = 30) -> DataFrame:
    """chunk_start, chunk_end: the range in steps of `days`, the last one cut at the end."""
    df = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("a"), F.lit(end).cast("timestamp_ntz").alias("b"))
    steps = df.select("b", F.explode(F.sequence("a", F.col("b") - F.expr("interval 1 microsecond"), F.expr(f"interval {days} days"))).alias("chunk_start"))
    return steps.select("chunk_start", F.least(F.col("chunk_start") + F.expr(f"interval {days} days"), "b").alias("chunk_end"))


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first in the order given (which rows dropDuplicates keeps isn't fixed)."""
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    names = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(row).alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in names]).select(*df.columns)


def united(chunks: list[DataFrame]) -> DataFrame:
    """Chunks one after another, the first of equal times kept, numbered by time."""
    all_ = None
    for k, chunk in enumerate(chunks):
        chunk = chunk.withColumn("__chunk", F.lit(k))
        all_ = chunk if all_ is None else all_.unionByName(chunk)
    return numbered(first_of_each(all_, ["symbol", "ts"], ["__chunk"]).drop("__chunk"))


RECORD = "struct<time: string, open: string, high: string, low: string, close: string, volume: string>"


def from_json(payloads: DataFrame, column: str = "payload", zone: str = "Asia/Kolkata") -> DataFrame:
    """symbol, ts, open .. volume (and chunk, if there) from answers {"success": ..., "result": [{time, open, ...}]}; unsuccessful ones give no rows.

    Numbers may be quoted; an absent or empty volume is 0; epoch seconds become local time.
    """
    more = [c for c in ("chunk",) if c in payloads.columns]
    answer = F.from_json(column, f"struct<success: boolean, result: array<{RECORD}>>")
    rows = payloads.select("symbol", *more, answer.alias("a")).filter("a.success").select("symbol", *more, F.explode("a.result").alias("r"))
    number = lambda c: F.col(f"r.{c}").cast("double").alias(c)
    local = F.from_utc_timestamp(F.timestamp_seconds(F.col("r.time").cast("bigint")), zone).cast("timestamp_ntz")
    return rows.select("symbol", *more, local.alias("ts"), *map(number, ("open", "high", "low", "close")), F.coalesce(F.expr("try_cast(r.volume as double)"), F.lit(0.0)).alias("volume"))


def read_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """A cached candle file: DateTime,Open,High,Low,Close,Volume."""
    raw = spark.read.schema("DateTime timestamp_ntz, Open double, High double, Low double, Close double, Volume double").csv(path, header=True)
    return numbered(raw.select(F.lit(symbol).alias("symbol"), F.col("DateTime").alias("ts"), *[F.col(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")]))


def write_csv(df: DataFrame, path: str) -> None:
    df.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("DateTime"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")]).write.mode("overwrite").csv(path, header=True)


def cache_name(symbol: str, interval: str, days: int) -> str:
    return f"{symbol}_{interval}_{days}d.csv"


def cached(spark: SparkSession, path: str, symbol: str, fetch, refresh: bool = False) -> DataFrame:
    """The cache at path, or what fetch() gives, which is then cached."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if refresh or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        write_csv(fetch(), path)
    return read_csv(spark, path, symbol)


def write_partitioned(df: DataFrame, path: str) -> None:
    df.repartition("symbol").sortWithinPartitions("bar").write.mode("overwrite").partitionBy("symbol").parquet(path)


def checked(df: DataFrame, least: int = 150) -> DataFrame:
    """Symbols with at least `least` bars; raises if no rows are left."""
    n = Window.partitionBy("symbol")
    out = df.withColumn("__n", F.count("*").over(n)).filter(F.col("__n") >= least).drop("__n")
    if out.isEmpty():
        raise ValueError(f"no symbol has {least} bars")
    return out
