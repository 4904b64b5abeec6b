"""The ninety indicator columns as staged window expressions.

`raw` columns of recursive filters (moving averages, Wilder sums, trend bands) come from operators.recursive. What the usual
indicator library defines and this engine can't look up is fixed here: Bollinger bands use the population deviation; Aroon
looks at 26 bars and takes the latest extreme; VWAP starts anew each calendar day.
Warm-up rows are back-filled as the original does (`fill`), or left null.
"""

from __future__ import annotations

from wickwork.functions.dialect import Dialect, Stage

BASE = ("open", "high", "low", "close", "volume")
#: Indicators by group, in the order in which they are appended.
GROUPS = {
    "basic": "close_return return_1 return_5 return_10 return_20 open_close_return low_open_return log_volume volume_ratio",
    "moving_average": "EMA_10 EMA_20 EMA_50 EMA_100 SMA_20 SMA_50 SMA_100 price_to_ema_20 price_to_sma_50 ema_10_20_cross VWAP price_to_vwap",
    "momentum": "RSI_7 RSI_21 MACD MACD_signal MACD_hist Stoch_K WilliamsR_14",
    "volatility": "ATR_14 ATR_21 ATR_pct BB_lower BB_middle BB_upper KC_lower KC_upper volatility_10",
    "trend": "ADX_14 DMP_14 DMN_14 ADX_20 DMP_20 DMN_20 directional_bias supertrend supertrend_direction st_flip bars_since_flip aroon_up aroon_down aroon_oscillator",
    "volume": "CMF MFI VPT",
    "candle": "upper_wick lower_wick total_wick wick_imbalance wick_to_body close_position is_bullish candle_strength gap_up gap_down gap_size",
    "statistical": "zscore_10 zscore_50 skew_20 kurt_20",
    "advanced_volatility": "realized_var_20 bipower_var jump_strength vol_regime range_velocity fractal_proxy",
    "advanced_trend": "efficiency_ratio trend_persistence trend_smoothness path_curvature trend_strength trend_acceleration dir_entropy",
    "information": "price_entropy surprise shock_elasticity",
    "microstructure": "slippage_proxy stop_hunt_proxy",
    "interaction": "trend_volume adx_volume vol_atr_ratio",
}
INDICATORS = [c for g in GROUPS.values() for c in g.split()]


def native(d: Dialect) -> list[Stage]:
    """Columns that need no recursion, not yet filled (their own inner back-fills excepted)."""
    roll, lag, ratio = d.roll, d.lag, d.ratio
    day = f"(PARTITION BY symbol, {d.day('ts')} ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    aroon = lambda x, m: "CASE " + " ".join(f"WHEN {x if k == 0 else lag(x, k)} = {m} THEN 100.0 * (1 - {k} / 25.0)" for k in range(26)) + " END"
    first = {
        "close_return": f"ln({ratio('close', lag('close'))})",
        **{f"return_{k}": f"{ratio('close', lag('close', k))} - 1" for k in (1, 5, 10, 20)},
        "open_close_return": f"ln({ratio('close', 'open')})",
        "low_open_return": f"ln({ratio('low', 'open')})",
        "log_volume": "ln(volume + 1)",
        "volume_ratio": ratio("volume", roll("avg", "volume", 20)),
        **{f"sma_raw_{n}": roll("avg", "close", n) for n in (20, 50, 100)},
        "typical": "(high + low + close) / 3.0",
        "low_14": roll("min", "low", 14), "high_14": roll("max", "high", 14),
        "std_20": roll("stddev_pop", "close", 20), "high_26": roll("max", "high", 26), "low_26": roll("min", "low", 26),
        "upper_wick": "high - greatest(open, close)", "lower_wick": "least(open, close) - low",
        "close_position": "(close - low) / (high - low + 1e-4)", "is_bullish": "CASE WHEN close > open THEN 1 ELSE 0 END",
        "candle_strength": "abs(close - open) / (high - low + 1e-4)",
        "gap_up": f"CASE WHEN open > {lag('close')} THEN 1 ELSE 0 END", "gap_down": f"CASE WHEN open < {lag('close')} THEN 1 ELSE 0 END",
        "gap_size": ratio(f"open - {lag('close')}", lag("close")),
        **{f"zscore_{n}": f"(close - {roll('avg', 'close', n)}) / ({roll('stddev_samp', 'close', n)} + 1e-4)" for n in (10, 50)},
        "efficiency_ratio": f"abs(close - {lag('close', 10)}) / ({roll('max', 'high', 10)} - {roll('min', 'low', 10)} + 1e-4)",
        "close_lag_20": lag("close", 20),
        "slippage_proxy": f"(high - low) / {roll('avg', 'close', 10)}",
        "bar_range": "high - low",
        "true_range": f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))",
        "clv_volume": f"coalesce({ratio('2 * close - high - low', 'high - low')}, 0) * volume",
        "typical_before": f"({lag('high')} + {lag('low')} + {lag('close')}) / 3.0",
    }
    second = {
        "total_wick": "upper_wick + lower_wick",
        "wick_imbalance": ratio("upper_wick - lower_wick", "close"),
        "wick_to_body": "(upper_wick + lower_wick) / (abs(close - open) + 1e-4)",
        **{f"SMA_{n}": d.back_fill(f"sma_raw_{n}") for n in (20, 50, 100)},
        "VWAP": ratio(f"sum(typical * volume) OVER {day}", f"sum(volume) OVER {day}"),
        "k_raw": f"100 * {ratio('close - low_14', 'high_14 - low_14')}",
        "WilliamsR_14": f"100 * ({ratio('close - low_14', 'high_14 - low_14')} - 1)",
        "BB_lower": "sma_raw_20 - 2 * std_20", "BB_middle": "sma_raw_20", "BB_upper": "sma_raw_20 + 2 * std_20",
        "volatility_10": roll("stddev_samp", "return_1", 10),
        "aroon_up": aroon("high", "high_26"), "aroon_down": aroon("low", "low_26"),
        "CMF": ratio(roll("sum", "clv_volume", 20), roll("sum", "volume", 20)),
        "flow_up": "CASE WHEN typical > typical_before THEN typical * volume WHEN typical_before IS NOT NULL THEN 0 END",
        "flow_down": "CASE WHEN typical < typical_before THEN typical * volume WHEN typical_before IS NOT NULL THEN 0 END",
        "vpt_step": "coalesce(100 * return_1 * volume, 0)",
        **{f"m{k}": roll("avg", " * ".join(["return_1"] * k), 20) for k in (1, 2, 3, 4)},
        "r_squared": "return_1 * return_1", "r_pair": f"abs(return_1) * abs({lag('return_1')})", "r_sign": "sign(return_1)",
        "r_change": f"abs(return_1 - {lag('return_1')})", "std_r_20": roll("stddev_samp", "return_1", 20),
        "range_velocity": f"(bar_range - {lag('bar_range')}) / ({lag('bar_range')} + 1e-4)",
        "r_low": roll("min", "return_1", 20), "r_high": roll("max", "return_1", 20),
    }
    third = {
        "price_to_sma_50": ratio("close - SMA_50", "SMA_50"), "price_to_vwap": ratio("close - VWAP", "VWAP"),
        "Stoch_K": roll("avg", "k_raw", 3),
        "aroon_oscillator": "aroon_up - aroon_down",
        "MFI": f"100 * {ratio(roll('sum', 'flow_up', 14), roll('sum', 'flow_up', 14) + ' + ' + roll('sum', 'flow_down', 14))}",
        "VPT": d.running("sum", "vpt_step"),
        "variance_20": "m2 - m1 * m1",
        "realized_var_20": roll("sum", "r_squared", 20), "bipower_var": roll("sum", "r_pair", 20),
        "vol_mean_50": roll("avg", "volatility_10", 50),
        "trend_persistence": roll("sum", "r_sign", 10), "trend_smoothness": "abs(close - close_lag_20) / (std_r_20 + 1e-4)",
        "path_curvature": roll("avg", "r_change", 10),
        "entropy_step": "r_sign * ln(abs(r_sign) + 1e-6)",
        "surprise": "(return_1 - m1) / (std_r_20 + 1e-6)", "shock_elasticity": "abs(return_1) / (volatility_10 + 1e-6)",
        # Counts of 20 returns in five equal bins between their extremes; a constant window is all in the middle one.
        **{f"bin_{b}": " + ".join(_in_bin("return_1" if k == 0 else lag("return_1", k), b) for k in range(20)) for b in range(5)},
    }
    fourth = {
        "skew_20": f"{ratio('m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1', 'variance_20 * sqrt(variance_20)')} * sqrt(380e0) / 18e0",
        "kurt_20": f"19e0 / 306e0 * (21e0 * ({ratio('m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1', 'variance_20 * variance_20')} - 3) + 6)",
        "jump_strength": "realized_var_20 - bipower_var", "vol_regime": "CASE WHEN volatility_10 > vol_mean_50 THEN 1 ELSE 0 END",
        "dir_entropy": f"-({roll('avg', 'entropy_step', 20)})",
        "price_entropy": "CASE WHEN r_low IS NOT NULL THEN -(" + " + ".join(f"((bin_{b} + 1) / 25.0) * ln((bin_{b} + 1) / 25.0)" for b in range(5)) + ") END",
    }
    return [first, second, third, fourth]


def _in_bin(x: str, b: int) -> str:
    place = f"least(floor(({x} - r_low) / nullif(r_high - r_low, 0) * 5), 4)"
    return f"CASE WHEN coalesce({place}, 2) = {b} THEN 1 ELSE 0 END"


def with_recursive(d: Dialect) -> list[Stage]:
    """Columns that build on the recursive ones (e10 .. e100, macd, ..., named below with `raw_`)."""
    lag, ratio, bf = d.lag, d.ratio, d.back_fill
    return [
        {**{f"EMA_{n}": bf(f"raw_ema_{n}") for n in (10, 20, 50, 100)}, "ATR_pct": f"{ratio('raw_atr_14', 'close')} * 100",
         "directional_bias": "raw_dmp_14 - raw_dmn_14", "st_flip": f"abs(raw_direction - {lag('raw_direction')})",
         "trend_strength": f"abs(close - raw_supertrend) / close", "KC_lower": "raw_kc_mid - 2 * raw_kc_width", "KC_upper": "raw_kc_mid + 2 * raw_kc_width",
         "MACD": "raw_macd", "MACD_signal": "raw_macd_signal", "MACD_hist": "raw_macd - raw_macd_signal",
         "RSI_7": "raw_rsi_7", "RSI_21": "raw_rsi_21", "ATR_14": "raw_atr_14", "ATR_21": "raw_atr_21",
         **{f"{a}_{n}": f"raw_{a.lower()}_{n}" for a in ("ADX", "DMP", "DMN") for n in (14, 20)},
         "supertrend": "raw_supertrend", "supertrend_direction": "raw_direction", "stop_hunt_proxy": "(high - low) / (raw_atr_14 + 1e-4)"},
        {"price_to_ema_20": ratio("close - EMA_20", "EMA_20"), "ema_10_20_cross": "EMA_10 - EMA_20", "flip_group": d.running("sum", "CASE WHEN st_flip = 2 THEN 1 ELSE 0 END"),
         "fractal_proxy": "ATR_pct / (volatility_10 + 1e-4)", "trend_acceleration": f"trend_strength - {lag('trend_strength')}",
         "trend_volume": "trend_strength * volume_ratio", "adx_volume": "ADX_14 * volume_ratio", "vol_atr_ratio": f"{ratio('volume_ratio', 'ATR_pct')}"},
        {"bars_since_flip": "row_number() OVER (PARTITION BY symbol, flip_group ORDER BY bar) - 1"},
    ]


def filled(d: Dialect) -> list[Stage]:
    """Every indicator back-filled and then forward-filled, as f_<name> and then under its own name by a projection."""
    return [{f"b_{c}": d.back_fill(c) for c in INDICATORS}, {f"f_{c}": d.forward_fill(f"b_{c}") for c in INDICATORS}]
