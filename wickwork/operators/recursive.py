"""Recursive filters: exponential and Wilder averages, MACD, ADX, Keltner and trend bands.

One pass computes all of them. Bars come in sorted partitions and the filters' state is carried from batch to batch,
so memory doesn't grow with a symbol's history.

Fixed definitions: ema(n) starts at bar n - 1 with the mean of its first n values, then v += 2 / (n + 1) * (x - v).
rma(n) starts with its first value, v += (x - v) / n, and is null until it has seen n values. RSI = 100 * gain / (gain + loss). True range at
the first bar is high - low. Trend bands are (high + low) / 2 -+ 3 * rma(true range, 10) and start at bar 9 with direction 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = [
    *(f"raw_ema_{n}" for n in (10, 20, 50, 100)), "raw_macd", "raw_macd_signal", *(f"raw_rsi_{n}" for n in (7, 14, 21)), "raw_atr_14", "raw_atr_21",
    *(f"raw_{a}_{n}" for n in (14, 20) for a in ("adx", "dmp", "dmn")), "raw_kc_mid", "raw_kc_width", "raw_supertrend", "raw_direction",
]


class _Ema:
    def __init__(self, n: int):
        self.n, self.seen, self.total, self.value = n, 0, 0.0, None

    def step(self, x: float | None) -> float | None:
        if x is None:
            return self.value
        self.seen += 1
        if self.seen < self.n:
            self.total += x
        elif self.seen == self.n:
            self.value = (self.total + x) / self.n
        else:
            self.value += 2.0 / (self.n + 1) * (x - self.value)
        return self.value


class _Rma:
    def __init__(self, n: int):
        self.n, self.seen, self.value = n, 0, 0.0

    def step(self, x: float | None) -> float | None:
        if x is not None:
            self.value = x if not self.seen else self.value + (x - self.value) / self.n
            self.seen += 1
        return self.value if self.seen >= self.n else None


class _State:
    """All filters of one symbol."""

    def __init__(self):
        self.before = None
        self.ema = {n: _Ema(n) for n in (10, 20, 50, 100, 12, 26)}
        self.signal, self.width = _Ema(9), _Ema(20)
        self.gain, self.loss = ({n: _Rma(n) for n in (7, 14, 21)} for _ in range(2))
        self.atr = {n: _Rma(n) for n in (10, 14, 20, 21)}
        self.plus, self.minus, self.dx = ({n: _Rma(n) for n in (14, 20)} for _ in range(3))
        self.upper = self.lower = None
        self.direction = 1

    def step(self, high: float, low: float, close: float) -> tuple:
        old = self.before
        emas = {n: f.step(close) for n, f in self.ema.items()}
        macd = emas[12] - emas[26] if emas[26] is not None else None
        signal = self.signal.step(macd) if macd is not None else None
        span = high - low if old is None else max(high - low, abs(high - old[2]), abs(low - old[2]))
        rsis = []
        for n in (7, 14, 21):
            change = None if old is None else close - old[2]
            up = self.gain[n].step(None if change is None else max(change, 0.0))
            down = self.loss[n].step(None if change is None else max(-change, 0.0))
            rsis.append(None if up is None or up + down == 0 else 100 * up / (up + down))
        atr = {n: f.step(span) for n, f in self.atr.items()}
        rise, fall = (None, None) if old is None else (high - old[0], old[1] - low)
        trends = []
        for n in (14, 20):
            plus = self.plus[n].step(None if rise is None else rise if rise > fall and rise > 0 else 0.0)
            minus = self.minus[n].step(None if rise is None else fall if fall > rise and fall > 0 else 0.0)
            if plus is None or not atr[n]:
                trends += [None, None, None]
                continue
            dmp, dmn = 100 * plus / atr[n], 100 * minus / atr[n]
            adx = self.dx[n].step(100 * abs(dmp - dmn) / (dmp + dmn) if dmp + dmn else None)
            trends += [adx, dmp, dmn]
        band = direction = None
        if atr[10] is not None:
            upper, lower = (high + low) / 2 + 3 * atr[10], (high + low) / 2 - 3 * atr[10]
            if self.upper is not None:
                if close > self.upper:
                    self.direction = 1
                elif close < self.lower:
                    self.direction = -1
                if self.direction > 0:
                    lower = max(lower, self.lower)
                else:
                    upper = min(upper, self.upper)
            self.upper, self.lower, direction = upper, lower, self.direction
            band = lower if direction > 0 else upper
        self.before = (high, low, close)
        return (*(emas[n] for n in (10, 20, 50, 100)), macd, signal, *rsis, atr[14], atr[21], *trends, emas[20], self.width.step(span), band, direction)


def scanned(df: DataFrame, make, columns: list[str], inputs: list[str], kinds: str = "double") -> DataFrame:
    """df with columns that a fold over each symbol's bars gives: make() is a new state, its step(*inputs) gives one bar's values."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{c} {kinds}" for c in columns])
    names = df.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, state = None, None
        for part in parts:
            rows = []
            for now, *values in part[["symbol", *inputs]].itertuples(index=False):
                if state is None or now != symbol:
                    symbol, state = now, make()
                rows.append(state.step(*(None if v != v else v for v in values)))
            found = pd.DataFrame(rows, columns=columns, index=part.index)
            if kinds == "double":
                found = found.astype("float64")
            yield pd.concat([part[names], found], axis=1)

    return df.repartition("symbol").sortWithinPartitions("symbol", "bar").mapInPandas(run, schema)


def recursive(df: DataFrame) -> DataFrame:
    """df (symbol, bar, high, low, close, ...) with COLUMNS; NaN never stands for a missing value."""
    out = scanned(df, _State, COLUMNS, ["high", "low", "close"])
    return out.selectExpr(*(f"`{c}`" for c in df.columns), *(f"nullif({c}, double('NaN')) AS {c}" for c in COLUMNS))


def oracle(source: str) -> list[str]:
    """The same as recursive CTEs for DuckDB: `averages` with the state, `recursed` with the columns of COLUMNS."""
    emas = (10, 12, 20, 26, 50, 100)
    seeds = ", ".join(f"avg(close) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS seed_{n}" for n in emas)
    prepared = f"""prepared AS (
      SELECT *, avg(span) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS seed_width FROM (
        SELECT symbol, bar, high, low, close, {seeds},
          greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS down,
          CASE WHEN bar = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS span,
          CASE WHEN high - lag(high) OVER w > lag(low) OVER w - low AND high > lag(high) OVER w THEN high - lag(high) OVER w WHEN bar > 0 THEN 0 END AS plus,
          CASE WHEN lag(low) OVER w - low > high - lag(high) OVER w AND low < lag(low) OVER w THEN lag(low) OVER w - low WHEN bar > 0 THEN 0 END AS minus
        FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY bar)))"""
    wilder = {**{f"g{n}": ("up", n, 1) for n in (7, 14, 21)}, **{f"l{n}": ("down", n, 1) for n in (7, 14, 21)}, **{f"a{n}": ("span", n, 0) for n in (10, 14, 20, 21)}, **{f"p{n}": ("plus", n, 1) for n in (14, 20)}, **{f"m{n}": ("minus", n, 1) for n in (14, 20)}}
    start = ", ".join([*(f"CAST(NULL AS DOUBLE) AS e{n}" for n in emas), "CAST(NULL AS DOUBLE) AS kw", *(f"CAST({x} AS DOUBLE) AS {k}" if not first else f"CAST(NULL AS DOUBLE) AS {k}" for k, (x, _, first) in wilder.items())])
    step = ", ".join([
        *(f"CASE WHEN c.bar < {n - 1} THEN NULL WHEN c.bar = {n - 1} THEN c.seed_{n} ELSE s.e{n} + {2.0 / (n + 1)!r} * (c.close - s.e{n}) END" for n in emas),
        f"CASE WHEN c.bar < 19 THEN NULL WHEN c.bar = 19 THEN c.seed_width ELSE s.kw + {2.0 / 21!r} * (c.span - s.kw) END",
        *(f"CASE WHEN c.bar = {first} THEN c.{x} ELSE s.{k} + (c.{x} - s.{k}) / {n} END" for k, (x, n, first) in wilder.items())])
    averages = f"""averages AS (
      SELECT symbol, bar, {start} FROM prepared WHERE bar = 0
      UNION ALL SELECT c.symbol, c.bar, {step} FROM averages s JOIN prepared c ON c.symbol = s.symbol AND c.bar = s.bar + 1)"""
    dm = lambda k, n: f"CASE WHEN a.bar >= {n} THEN 100 * a.{k}{n} / nullif(a.a{n}, 0) END"
    derived = f"""derived AS (
      SELECT a.*, p.high, p.low, p.close, a.e12 - a.e26 AS macd, {', '.join(f'{dm("p", n)} AS dmp{n}, {dm("m", n)} AS dmn{n}' for n in (14, 20))},
        CASE WHEN a.bar >= 9 THEN (p.high + p.low) / 2 + 3 * a.a10 END AS bu, CASE WHEN a.bar >= 9 THEN (p.high + p.low) / 2 - 3 * a.a10 END AS bl
      FROM averages a JOIN prepared p USING (symbol, bar))"""
    second = f"""second AS (
      SELECT *, {', '.join(f'100 * abs(dmp{n} - dmn{n}) / nullif(dmp{n} + dmn{n}, 0) AS dx{n}' for n in (14, 20))},
        avg(macd) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS seed_signal FROM derived),
    counted AS (SELECT *, {', '.join(f'count(dx{n}) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS ndx{n}' for n in (14, 20))} FROM second)"""
    adx = lambda n: f"CASE WHEN c.dx{n} IS NULL THEN s.x{n} WHEN c.ndx{n} = 1 THEN c.dx{n} ELSE s.x{n} + (c.dx{n} - s.x{n}) / {n} END"
    turn = "CASE WHEN s.fu IS NULL THEN 1 WHEN c.close > s.fu THEN 1 WHEN c.close < s.fl THEN -1 ELSE s.dir END"
    bands = f"""bands AS (
      SELECT symbol, bar, CAST(NULL AS DOUBLE) AS sig, CAST(NULL AS DOUBLE) AS x14, CAST(NULL AS DOUBLE) AS x20, CAST(NULL AS DOUBLE) AS fu, CAST(NULL AS DOUBLE) AS fl, 1 AS dir FROM counted WHERE bar = 0
      UNION ALL SELECT c.symbol, c.bar,
        CASE WHEN c.bar < 33 THEN NULL WHEN c.bar = 33 THEN c.seed_signal ELSE s.sig + 0.2 * (c.macd - s.sig) END, {adx(14)}, {adx(20)},
        CASE WHEN s.fu IS NOT NULL AND ({turn}) < 0 THEN least(c.bu, s.fu) ELSE c.bu END,
        CASE WHEN s.fl IS NOT NULL AND ({turn}) > 0 THEN greatest(c.bl, s.fl) ELSE c.bl END, {turn}
      FROM bands s JOIN counted c ON c.symbol = s.symbol AND c.bar = s.bar + 1)"""
    rsi = lambda n: f"CASE WHEN d.bar >= {n} THEN 100 * d.g{n} / nullif(d.g{n} + d.l{n}, 0) END AS raw_rsi_{n}"
    out = f"""recursed AS (
      SELECT b.*, {', '.join(f'd.e{n} AS raw_ema_{n}' for n in (10, 20, 50, 100))}, d.macd AS raw_macd, s.sig AS raw_macd_signal, {', '.join(map(rsi, (7, 14, 21)))},
        {', '.join(f'CASE WHEN d.bar >= {n - 1} THEN d.a{n} END AS raw_atr_{n}' for n in (14, 21))},
        {', '.join(f'CASE WHEN d.ndx{n} >= {n} THEN s.x{n} END AS raw_adx_{n}, d.dmp{n} AS raw_dmp_{n}, d.dmn{n} AS raw_dmn_{n}' for n in (14, 20))},
        d.e20 AS raw_kc_mid, d.kw AS raw_kc_width, CASE WHEN d.bar >= 9 THEN CASE WHEN s.dir > 0 THEN s.fl ELSE s.fu END END AS raw_supertrend, CASE WHEN d.bar >= 9 THEN CAST(s.dir AS DOUBLE) END AS raw_direction
      FROM {source} b JOIN counted d USING (symbol, bar) JOIN bands s USING (symbol, bar))"""
    return [prepared, averages, derived, second, bands, out]
