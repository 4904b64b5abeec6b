"""Market structure and the 24 signals as staged window expressions; the two zone signals are folds (operators.zones).

State machines become windows: a structure break is the first close beyond a swing level in the run of bars that
have this level, unless the level is that of the break before; a retest looks for the first bar of each break's island that
hits or fails; pivots further back are carried on pivot rows and filled forward.
"""

from __future__ import annotations

from wickwork.functions.dialect import KEY, Dialect, Stage

STRUCTURE = "swing_high_at_pivot swing_low_at_pivot last_swing_high last_swing_low bars_since_swing_high bars_since_swing_low structure_trend swing_high_label swing_low_label swing_label resistance_level support_level squeeze_on trend_score".split()
ZONE_SIGNALS = ["sig_ob_retest", "sig_fvg_fill"]
SIGNALS = ("sig_swing_break sig_bos sig_choch sig_engulfing sig_pinbar sig_donchian sig_sr_breakout sig_squeeze_breakout sig_ob_retest sig_fvg_fill sig_sweep sig_ema_pullback "
           "sig_golden_pullback sig_vwap_reclaim sig_fib_retracement sig_fib_extension sig_trendline_break sig_inside_bar_breakout sig_nr7_breakout sig_rsi_divergence "
           "sig_trend_confluence sig_bos_retest sig_sweep_reversal sig_super_confluence").split()


def _between(x: str, a: str, b: str) -> str:
    return f"({x} >= {a} AND {x} <= {b})"


def stages(d: Dialect, left: int = 3, right: int = 3, max_wait: int = 30) -> list[Stage]:
    """From enriched bars; sides are written as (suffix, price, ...) pairs: high and low mirror each other."""
    lag, ff, sign, roll = d.lag, d.forward_fill, d.sign, d.roll
    before = lambda x: ff(x, "1 PRECEDING")
    sides = ("high", "low")
    s1 = {f"swing_{s}_at_pivot": f"CASE WHEN {s} = {d.centred('max' if s == 'high' else 'min', s, left, right)} THEN {s} END" for s in sides}
    s1 |= {"dc_high": roll("max", "high", 20), "dc_low": roll("min", "low", 20), "narrow": roll("min", "high - low", 7),
           "squeeze_on": "CASE WHEN BB_upper < KC_upper AND BB_lower > KC_lower THEN 1 ELSE 0 END",
           "inside": f"CASE WHEN high < {lag('high')} AND low > {lag('low')} THEN 1 ELSE 0 END",
           "engulf_up": f"close > open AND {lag('close')} < {lag('open')} AND close >= {lag('open')} AND open <= {lag('close')}",
           "engulf_down": f"close < open AND {lag('close')} > {lag('open')} AND close <= {lag('open')} AND open >= {lag('close')}",
           "wick_up": "high - greatest(open, close)", "wick_down": "least(open, close) - low", "place": "(close - low) / (high - low + 1e-9)",
           "trend_score": "sign(EMA_20 - EMA_50) + supertrend_direction + sign(MACD_hist) + sign(DMP_14 - DMN_14) * CASE WHEN ADX_14 > 20 THEN 1 ELSE 0 END + sign(close - VWAP)"}
    s2 = {f"confirmed_{s}": lag(f"swing_{s}_at_pivot", right) for s in sides} | {"pivot_rsi": lag("RSI_14", right), "dc_high_1": lag("dc_high"), "dc_low_1": lag("dc_low")}
    s3 = {}
    for s in sides:
        c = f"confirmed_{s}"
        s3 |= {f"last_swing_{s}": ff(c), f"run_{s}": d.running("count", c), f"before_{s}": before(c), f"rsi_before_{s}": before(f"CASE WHEN {c} IS NOT NULL THEN pivot_rsi END"),
               f"at_{s}": ff(f"CASE WHEN {c} IS NOT NULL THEN bar END"), f"at_before_{s}": before(f"CASE WHEN {c} IS NOT NULL THEN bar END")}
    s3 |= {"sig_donchian": sign(f"close > dc_high_1 AND {lag('close')} <= {lag('dc_high_1')}", f"close < dc_low_1 AND {lag('close')} >= {lag('dc_low_1')}")}
    s4 = {}
    for s, op, hh, lh in (("high", ">", 2, -1), ("low", "<", 1, -2)):
        c = f"confirmed_{s}"
        s4 |= {f"bars_since_swing_{s}": f"row_number() OVER (PARTITION BY symbol, run_{s} ORDER BY bar) - 1",
               f"beyond_{s}": f"CASE WHEN close {op} last_swing_{s} THEN 1 ELSE 0 END",
               f"second_{s}": f"CASE WHEN {c} IS NOT NULL THEN before_{s} END", f"second_at_{s}": f"CASE WHEN {c} IS NOT NULL THEN at_before_{s} END",
               f"swing_{s}_label": f"CASE WHEN {c} IS NULL OR before_{s} IS NULL THEN 0 WHEN {c} > before_{s} THEN {hh} ELSE {lh} END",
               f"level_1_{s}": lag(f"last_swing_{s}")}
    s5 = {"swing_label": "CASE WHEN swing_low_label <> 0 THEN swing_low_label ELSE swing_high_label END",
          "sig_swing_break": sign(f"close > last_swing_high AND {lag('close')} <= level_1_high", f"close < last_swing_low AND {lag('close')} >= level_1_low"),
          "sig_rsi_divergence": "CASE WHEN confirmed_high > before_high AND pivot_rsi < rsi_before_high THEN -1 WHEN confirmed_low < before_low AND pivot_rsi > rsi_before_low THEN 1 ELSE 0 END"}
    for s in sides:
        s5 |= {f"first_{s}": f"CASE WHEN beyond_{s} = 1 AND sum(beyond_{s}) OVER (PARTITION BY symbol, run_{s} ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 THEN last_swing_{s} END",
               f"p2_{s}": ff(f"second_{s}"), f"b2_{s}": ff(f"second_at_{s}"),
               f"third_{s}": f"CASE WHEN confirmed_{s} IS NOT NULL THEN {before(f'second_{s}')} END", f"third_at_{s}": f"CASE WHEN confirmed_{s} IS NOT NULL THEN {before(f'second_at_{s}')} END"}
    s6 = {}
    for s in sides:
        s6 |= {f"first_before_{s}": before(f"first_{s}"), f"p3_{s}": ff(f"third_{s}"), f"b3_{s}": ff(f"third_at_{s}")}
    s7 = {f"broke_{s}": f"CASE WHEN first_{s} IS NOT NULL AND (first_before_{s} IS NULL OR first_before_{s} <> first_{s}) THEN 1 ELSE 0 END" for s in sides}
    s7 |= {"resistance_level": "CASE WHEN p3_high IS NOT NULL THEN greatest(last_swing_high, p2_high, p3_high) END", "support_level": "CASE WHEN p3_low IS NOT NULL THEN least(last_swing_low, p2_low, p3_low) END"}
    for s in sides:  # pivots known one bar ago, places relative to this bar
        s7 |= {f"y1_{s}": lag(f"last_swing_{s}"), f"y2_{s}": lag(f"p2_{s}"), f"y3_{s}": lag(f"p3_{s}"), f"x1_{s}": f"{lag(f'at_{s}')} - bar", f"x2_{s}": f"{lag(f'b2_{s}')} - bar", f"x3_{s}": f"{lag(f'b3_{s}')} - bar"}
    s8 = {"structure_trend": f"coalesce({ff('CASE WHEN broke_low = 1 THEN -1 WHEN broke_high = 1 THEN 1 END')}, 0)",
          "sig_sr_breakout": sign(f"close > resistance_level AND {lag('close')} <= {lag('resistance_level')}", f"close < support_level AND {lag('close')} >= {lag('support_level')}")}
    for s in sides:
        has3 = f"y3_{s} IS NOT NULL"
        s8 |= {f"xm_{s}": f"CASE WHEN {has3} THEN (x1_{s} + x2_{s} + x3_{s}) / 3.0 ELSE (x1_{s} + x2_{s}) / 2.0 END", f"ym_{s}": f"CASE WHEN {has3} THEN (y1_{s} + y2_{s} + y3_{s}) / 3.0 ELSE (y1_{s} + y2_{s}) / 2.0 END"}
    s9 = {"trend_before": f"coalesce({lag('structure_trend')}, 0)"}
    for s in sides:
        each = lambda f, s=s: " + ".join([f(1), f(2), f"coalesce({f(3)}, 0)"])
        top, low_ = each(lambda k, s=s: f"(x{k}_{s} - xm_{s}) * (y{k}_{s} - ym_{s})"), each(lambda k, s=s: f"(x{k}_{s} - xm_{s}) * (x{k}_{s} - xm_{s})")
        s9 |= {f"slope_{s}": f"({top}) / nullif({low_}, 0)"}
    s10 = {"sig_bos": "CASE WHEN broke_low = 1 AND (CASE WHEN broke_high = 1 THEN 1 ELSE trend_before END) <> 1 THEN -1 WHEN broke_high = 1 AND trend_before <> -1 THEN 1 ELSE 0 END",
           "sig_choch": "CASE WHEN broke_low = 1 AND (CASE WHEN broke_high = 1 THEN 1 ELSE trend_before END) = 1 THEN -1 WHEN broke_high = 1 AND trend_before = -1 THEN 1 ELSE 0 END",
           **{f"line_{s}": f"ym_{s} - slope_{s} * xm_{s}" for s in sides}}
    impulse, wide = "(last_swing_high - last_swing_low)", "abs(last_swing_high - last_swing_low)"
    up, down = "close > open", "close < open"
    zone = lambda a, b, m: (_between("low", f"last_swing_high - {b} * {m}", f"last_swing_high - {a} * {m}"), _between("high", f"last_swing_low + {a} * {m}", f"last_swing_low + {b} * {m}"))
    golden, fib = zone(0.5, 0.618, impulse), zone(0.382, 0.786, wide)
    released = f"{lag('squeeze_on')} = 1 AND squeeze_on = 0 AND volume_ratio > 1.2"
    narrow = f"{lag('CASE WHEN high - low = narrow THEN 1 ELSE 0 END')} = 1"
    s11 = {
        "event": "sig_bos + sig_choch",
        "sig_engulfing": sign("engulf_up", "engulf_down"),
        "sig_pinbar": sign("wick_down >= 2 * abs(close - open) AND place > 0.6", "wick_up >= 2 * abs(close - open) AND place < 0.4"),
        "sig_squeeze_breakout": sign(f"{released} AND close > BB_middle", released),
        "sig_sweep": sign(f"low < last_swing_low AND close > last_swing_low AND {up}", f"high > last_swing_high AND close < last_swing_high AND {down}"),
        "sig_ema_pullback": sign(f"EMA_20 > EMA_50 AND low <= EMA_20 AND close > EMA_20 AND {up} AND RSI_14 > 45", f"EMA_20 < EMA_50 AND high >= EMA_20 AND close < EMA_20 AND {down} AND RSI_14 < 55"),
        "sig_golden_pullback": sign(f"structure_trend = 1 AND {golden[0]} AND {up}", f"structure_trend = -1 AND {golden[1]} AND {down}"),
        "sig_vwap_reclaim": sign(f"close > VWAP AND {lag('close')} <= {lag('VWAP')} AND volume_ratio > 1.5 AND structure_trend >= 0", f"close < VWAP AND {lag('close')} >= {lag('VWAP')} AND volume_ratio > 1.5 AND structure_trend <= 0"),
        "sig_fib_retracement": sign(f"structure_trend = 1 AND {fib[0]} AND {up}", f"structure_trend = -1 AND {fib[1]} AND {down}"),
        "sig_fib_extension": f"CASE WHEN structure_trend = 1 AND {_between('high', f'last_swing_high + 0.272 * {wide}', f'last_swing_high + 0.618 * {wide}')} AND {down} THEN -1 "
                             f"WHEN structure_trend = -1 AND {_between('low', f'last_swing_low - 0.618 * {wide}', f'last_swing_low - 0.272 * {wide}')} AND {up} THEN 1 ELSE 0 END",
        "sig_trendline_break": sign(f"slope_high < 0 AND close > line_high AND {lag('close')} <= line_high - slope_high", f"slope_low > 0 AND close < line_low AND {lag('close')} >= line_low - slope_low"),
        "sig_inside_bar_breakout": sign(f"{lag('inside')} = 1 AND close > {lag('high')}", f"{lag('inside')} = 1 AND close < {lag('low')}"),
        "sig_nr7_breakout": sign(f"{narrow} AND close > {lag('high')}", f"{narrow} AND close < {lag('low')}"),
        "sig_trend_confluence": sign(f"trend_score >= 4 AND {lag('trend_score')} < 4", f"trend_score <= -4 AND {lag('trend_score')} > -4"),
    }
    s12 = {"island": d.running("sum", "CASE WHEN event <> 0 THEN 1 ELSE 0 END"), "sweep_1": lag("sig_sweep"),
           "sig_super_confluence": sign("event = 1 AND trend_score >= 3 AND volume_ratio > 1.2", "event = -1 AND trend_score <= -3 AND volume_ratio > 1.2")}
    first = "(PARTITION BY symbol, island ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    s13 = {"way": f"first_value(event) OVER {first}", "level": f"first_value(CASE WHEN event > 0 THEN last_swing_high WHEN event < 0 THEN last_swing_low END) OVER {first}", "age": f"row_number() OVER (PARTITION BY symbol, island ORDER BY bar)",
           "sig_sweep_reversal": sign("(sig_sweep = 1 OR sweep_1 = 1) AND sig_engulfing + sig_pinbar > 0", "(sig_sweep = -1 OR sweep_1 = -1) AND sig_engulfing + sig_pinbar < 0")}
    s14 = {"retest": "CASE WHEN island = 0 THEN 0 WHEN way > 0 AND low <= level + 0.25 * ATR_14 AND close > level AND close > open THEN 1 WHEN way < 0 AND high >= level - 0.25 * ATR_14 AND close < level AND close < open THEN -1 ELSE 0 END",
           "failed": f"CASE WHEN way > 0 AND close < level - 0.5 * ATR_14 THEN 1 WHEN way < 0 AND close > level + 0.5 * ATR_14 THEN 1 WHEN age > {max_wait} THEN 1 ELSE 0 END"}
    s15 = {"ended": f"sum(CASE WHEN retest <> 0 OR failed = 1 THEN 1 ELSE 0 END) OVER {first}"}
    s16 = {"sig_bos_retest": "CASE WHEN island > 0 AND retest <> 0 AND ended = 1 THEN retest ELSE 0 END"}
    return [s1, s2, s3, s4, s5, s6, s7, s8, s9, s10, s11, s12, s13, s14, s15, s16]


def total(columns: list[str]) -> str:
    """Number of signals on a bar."""
    return " + ".join(f"abs({c})" for c in columns)


__all__ = ["KEY", "SIGNALS", "STRUCTURE", "ZONE_SIGNALS", "stages", "total"]
