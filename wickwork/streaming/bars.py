"""Candles from a stream of ticks; beyond what a batch run needs, so that bars can be kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Candles of a streaming (or batch) table symbol, ts, tick, price, volume; in append mode a candle comes once the watermark has passed it."""
    order = F.struct("ts", "tick")
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"),
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
