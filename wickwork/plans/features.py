"""From candles to enriched bars: indicators, structure and signals, for Spark and as the oracle's CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wickwork.functions.dialect import DUCK, SPARK, apply, rendered
from wickwork.operators import indicators, recursive, signals, zones
from wickwork.sources import candles

BARS = ["symbol", "bar", "ts", *indicators.BASE]


def enriched(df: DataFrame, causal: bool = False) -> DataFrame:
    """Candles with the ninety indicators and RSI_14; causal leaves warm-up rows null instead of back-filling them."""
    df = apply(recursive.recursive(df.select(*BARS)), [*indicators.native(SPARK), *indicators.with_recursive(SPARK)])
    if causal:
        return df.selectExpr(*BARS, *indicators.INDICATORS, "raw_rsi_14 AS RSI_14")
    df = apply(df, [*indicators.filled(SPARK), {"RSI_14": SPARK.back_fill("raw_rsi_14")}])
    return df.selectExpr(*BARS, *(f"f_{c} AS {c}" for c in indicators.INDICATORS), "RSI_14")


def signalled(df: DataFrame, zoned: bool = True, swing_left: int = 3, swing_right: int = 3, max_zone_age: int = 50, max_active_zones: int = 3) -> DataFrame:
    """Enriched bars with structure columns and all signals."""
    df = apply(df, signals.stages(SPARK, swing_left, swing_right))
    if zoned:
        df = zones.zone_signals(df, max_zone_age, max_active_zones)
    names = [c for c in signals.SIGNALS if zoned or c not in signals.ZONE_SIGNALS]
    return df.select(*BARS, *indicators.INDICATORS, "RSI_14", *signals.STRUCTURE, *names)


def ready(df: DataFrame) -> DataFrame:
    """df with what a backtest needs: candles get indicators first, and enriched bars structure and signals; bars with signals stay."""
    if all(c in df.columns for c in signals.SIGNALS):
        return df
    return signalled(df if all(c in df.columns for c in [*indicators.INDICATORS, "RSI_14"]) else enriched(df))


def table(spark, sf_dir, single: bool = False, zoned: bool = True) -> DataFrame:
    return signalled(enriched(candles.candles(spark, sf_dir, single)), zoned)


def oracle(single: bool = False) -> list[str]:
    """CTEs: candles, ..., enriched, signalled (without the zone signals)."""
    out = [*candles.oracle(single), *recursive.oracle("candles")]
    out += rendered("recursed", [*indicators.native(DUCK), *indicators.with_recursive(DUCK), *indicators.filled(DUCK), {"RSI_14": DUCK.back_fill("raw_rsi_14")}], "features")
    out.append(f"enriched AS (SELECT {', '.join(BARS)}, {', '.join(f'f_{c} AS {c}' for c in indicators.INDICATORS)}, RSI_14 FROM features)")
    out += rendered("enriched", signals.stages(DUCK), "marked")
    names = [c for c in signals.SIGNALS if c not in signals.ZONE_SIGNALS]
    out.append(f"signalled AS (SELECT {', '.join(BARS)}, {', '.join(indicators.INDICATORS)}, RSI_14, {', '.join(signals.STRUCTURE)}, {', '.join(names)} FROM marked)")
    return out


def query(ctes: list[str], select: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {select}"
