"""Bracket trades: outcomes once for each bar and direction, then chains of trades that don't overlap.

A trade's relative gain doesn't depend on the account: equity is multiplied by 1 + g. So the exit of a trade entered after each bar is
found once, in a frame of the next bars, for both directions; any signal or combination of conditions is a chain over these
outcomes. Stop comes before target inside a bar; fees are charged for each leg.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bracket:
    """Account and exits; percentages as numbers (0.5 is half a percent)."""

    initial_capital: float = 100.0
    risk_per_trade_pct: float = 2.0
    stop_loss_pct: float = 0.5
    take_profit_pct: float = 1.0
    max_hold_bars: int = 20
    fee_pct: float = 0.05

    @property
    def breakeven_win_rate_pct(self) -> float:
        return 100.0 / (1 + self.take_profit_pct / self.stop_loss_pct)

    @property
    def fee_pct_of_risk(self) -> float | None:
        """What both legs' fees take of the risk; None without a stop."""
        return self.fee_pct * 2 / self.stop_loss_pct * 100 if self.stop_loss_pct else None

    @property
    def leverage(self) -> float | None:
        return self.risk_per_trade_pct / self.stop_loss_pct if self.stop_loss_pct else None

    @property
    def fee_adjusted_breakeven_win_rate_pct(self) -> float:
        return (1 + self.fee_pct_of_risk / 100) * self.breakeven_win_rate_pct


def outcomes(bars: DataFrame, b: Bracket = Bracket(), directions: tuple[int, ...] = (1, -1)) -> DataFrame:
    """symbol, bar, direction, entry_bar, exit_bar, entry_price, stop_price, target_price, exit_price, exit_reason, g of the trade that a signal on `bar` opens.

    Bars without a next one have none.
    """
    w = Window.partitionBy("symbol").orderBy("bar")
    ahead = F.collect_list(F.struct("bar", "high", "low", "close")).over(w.rowsBetween(1, b.max_hold_bars + 1))
    base = bars.select("symbol", "bar", F.lead("open").over(w).alias("entry_price"), ahead.alias("ahead")).filter("entry_price is not null")
    rows = base.withColumn("direction", F.explode(F.array(*map(F.lit, directions))))
    risk = F.col("entry_price") * (b.stop_loss_pct / 100)
    rows = rows.withColumn("stop_price", F.col("entry_price") - F.col("direction") * risk).withColumn("target_price", F.col("entry_price") + F.col("direction") * F.col("entry_price") * (b.take_profit_pct / 100))
    long = F.col("direction") > 0
    stopped = lambda x: F.when(long, x["low"] <= F.col("stop_price")).otherwise(x["high"] >= F.col("stop_price"))
    reached = lambda x: F.when(long, x["high"] >= F.col("target_price")).otherwise(x["low"] <= F.col("target_price"))
    rows = rows.withColumn("hit", F.get(F.filter("ahead", lambda x: stopped(x) | reached(x)), F.lit(0))).withColumn("last", F.element_at("ahead", -1))
    reason = F.when(F.col("hit").isNull(), "time").when(stopped(F.col("hit")), "stop").otherwise("target")
    rows = rows.withColumn("exit_reason", reason)
    price = F.when(F.col("exit_reason") == "time", F.col("last.close")).when(F.col("exit_reason") == "stop", F.col("stop_price")).otherwise(F.col("target_price"))
    rows = rows.withColumn("exit_price", price).withColumn("exit_bar", F.coalesce("hit.bar", "last.bar"))
    gain = (F.col("exit_price") - F.col("entry_price")) * F.col("direction") - F.col("entry_price") * (b.fee_pct / 100 * 2)
    return rows.select("symbol", "bar", "direction", (F.col("bar") + 1).alias("entry_bar"), "exit_bar", "entry_price", "stop_price", "target_price", "exit_price", "exit_reason", (b.risk_per_trade_pct / 100 * gain / risk).alias("g"))


def fired(df: DataFrame, signals: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """symbol, bar, signal, direction: one row for each signal on a bar."""
    out = df.unpivot(["symbol", "bar", *keep], signals, "signal", "direction").filter("direction <> 0")
    return out.withColumn("direction", F.col("direction").cast("int"))


@dataclass
class Account:
    """What an account goes through, trade after trade; `free` is the first bar on which it may enter again."""

    equity: float
    free: int = -1
    trades: int = 0
    wins: int = 0
    profit: float = 0.0
    loss: float = 0.0
    peak: float | None = None
    drawdown: float = 0.0

    def trade(self, exit_bar: int, g: float) -> None:
        after = self.equity * (1 + g)
        pnl = after - self.equity
        self.peak = after if self.peak is None else max(self.peak, after)  # the first trade's equity is the first peak
        self.drawdown = max(self.drawdown, (self.peak - after) / self.peak * 100)
        self.equity, self.free, self.trades, self.wins = after, exit_bar + 1, self.trades + 1, self.wins + (pnl > 0)
        self.profit, self.loss = self.profit + max(pnl, 0.0), self.loss + min(pnl, 0.0)

    def run(self, bars: np.ndarray, exits: np.ndarray, gains: np.ndarray) -> None:
        """The chain over signals on ascending bars: bars inside a trade are leapt over."""
        k = int(np.searchsorted(bars, self.free))
        while k < len(bars):
            self.trade(int(exits[k]), float(gains[k]))
            k = int(np.searchsorted(bars, self.free))

    def row(self) -> tuple:
        return self.equity, self.trades, self.wins, self.profit, self.loss, self.drawdown


ACCOUNT = "equity double, trades int, wins int, profit double, loss double, drawdown double"


def chained(fires: DataFrame, out: DataFrame, keys: list[str], b: Bracket = Bracket()) -> DataFrame:
    """keys, and account: the chain over each key's fires (symbol, bar, direction, keys; symbol is one of the keys). Rows stream through sorted partitions; the state is one account."""
    met = fires.join(out.select("symbol", "bar", "direction", "exit_bar", "g"), ["symbol", "bar", "direction"]).select(*keys, "bar", "exit_bar", "g")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.select(*keys).schema)
    capital = float(b.initial_capital)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, account = None, None
        columns = [*keys, *(x.split()[0] for x in ACCOUNT.split(", "))]
        for part in parts:
            done, names = [], part[keys].to_numpy()
            new = np.ones(len(part), bool)
            new[1:] = (names[1:] != names[:-1]).any(1)
            starts = [*np.flatnonzero(new).tolist(), len(part)]
            bars, exits, gains = part["bar"].to_numpy(), part["exit_bar"].to_numpy(), part["g"].to_numpy()
            for a, z in zip(starts, starts[1:], strict=False):
                if tuple(names[a]) != key:
                    if account is not None:
                        done.append((*key, *account.row()))
                    key, account = tuple(names[a]), Account(capital)
                account.run(bars[a:z], exits[a:z], gains[a:z])
            yield pd.DataFrame(done, columns=columns)
        if account is not None:
            yield pd.DataFrame([(*key, *account.row())], columns=columns)

    rows = met.repartition(*keys).sortWithinPartitions(*keys, "bar").mapInPandas(run, f"{schema}, {ACCOUNT}")
    return rows.select(*keys, F.struct(*(x.split()[0] for x in ACCOUNT.split(", "))).alias("account"))


def statistics(accounts: DataFrame, keys: list[str], b: Bracket = Bracket()) -> DataFrame:
    """One row for each key with trades: counts, rates and money, rounded as the original does; pnl_raw isn't rounded."""
    a = F.col("account")
    pnl = a["equity"] - b.initial_capital
    r = lambda x, k=2: F.round(x, k)
    return accounts.filter("account.trades > 0").select(
        *keys, a["trades"].alias("trades"), r(a["wins"] / a["trades"] * 100).alias("win_rate_pct"), r(a["equity"]).alias("final_equity"), r(pnl).alias("total_pnl"),
        r(a["profit"]).alias("total_profit"), r(a["loss"]).alias("total_loss"), r(pnl / b.initial_capital * 100).alias("return_pct"), r(pnl / a["trades"], 4).alias("avg_pnl_per_trade"), r(a["drawdown"]).alias("max_drawdown_pct"), pnl.alias("pnl_raw"))


def backtest(df: DataFrame, signals: list[str], b: Bracket = Bracket()) -> DataFrame:
    """Statistics of each signal of each symbol, best first (order by total_pnl, then signal)."""
    return statistics(chained(fired(df, signals), outcomes(df, b), ["symbol", "signal"], b), ["symbol", "signal"], b)


def ranked(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("total_pnl"), "symbol", "signal")


def no_fee_comparison(df: DataFrame, signals: list[str], b: Bracket = Bracket()) -> DataFrame:
    """Each signal without and with fees; fee_drag is what the fees took."""
    free = Bracket(**{**b.__dict__, "fee_pct": 0.0})
    left = backtest(df, signals, free).select("symbol", "signal", "trades", F.col("total_pnl").alias("pnl_no_fee"))
    right = backtest(df, signals, b).select("symbol", "signal", F.col("total_pnl").alias("pnl_with_fee"))
    return left.join(right, ["symbol", "signal"], "left").withColumn("fee_drag", F.round(F.col("pnl_no_fee") - F.col("pnl_with_fee"), 2))


def trade_list(fires: DataFrame, out: DataFrame, keys: list[str], b: Bracket = Bracket()) -> DataFrame:
    """Every trade taken, in order, with its size, gain and the equity after it. Rows stream through sorted partitions; the state is two numbers."""
    met = fires.join(out, ["symbol", "bar", "direction"])
    columns = [*keys, *[c for c in ("symbol", "bar", "direction", "entry_bar", "exit_bar", "entry_price", "stop_price", "target_price", "exit_price", "exit_reason", "g") if c not in keys]]
    met = met.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema) + ", position_size double, pnl double, equity_after double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, free, equity = None, -1, 0.0
        for part in parts:
            taken, sizes, gains, after = [], [], [], []
            for k, (now, bar, exit_bar, entry, g) in enumerate(zip(part[keys].itertuples(index=False, name=None), part["bar"], part["exit_bar"], part["entry_price"], part["g"], strict=True)):
                if now != key:
                    key, free, equity = now, -1, b.initial_capital
                if bar < free:
                    continue
                taken.append(k)
                sizes.append(equity * b.risk_per_trade_pct / 100 / (entry * b.stop_loss_pct / 100))
                gains.append(equity * g)
                equity *= 1 + g
                after.append(equity)
                free = exit_bar + 1
            yield part.iloc[taken].assign(position_size=sizes, pnl=gains, equity_after=after)

    return met.repartition(*keys).sortWithinPartitions(*keys, "bar").mapInPandas(run, schema)


def records(taken: DataFrame, bars: DataFrame) -> DataFrame:
    """trade_list's rows with the direction by name and the times of entry and exit, from bars (symbol, bar, ts)."""
    at = lambda side: bars.select("symbol", F.col("bar").alias(f"{side}_bar"), F.col("ts").alias(f"{side}_time"))
    named = taken.withColumn("direction", F.when(F.col("direction") > 0, "LONG").otherwise("SHORT"))
    return named.join(at("entry"), ["symbol", "entry_bar"], "left").join(at("exit"), ["symbol", "exit_bar"], "left")


def oracle_outcomes(source: str, b: Bracket = Bracket(), name: str = "outcomes") -> list[str]:
    """CTEs for DuckDB that end in `outcomes`."""
    return [f"""{name}_e AS (SELECT symbol, bar, d.direction, lead(open) OVER (PARTITION BY symbol, d.direction ORDER BY bar) AS entry_price FROM {source}, (VALUES (1), (-1)) d(direction))""",
            f"""{name}_p AS (SELECT *, entry_price - direction * entry_price * {b.stop_loss_pct / 100!r} AS stop_price, entry_price + direction * entry_price * {b.take_profit_pct / 100!r} AS target_price FROM {name}_e WHERE entry_price IS NOT NULL)""",
            f"""{name}_h AS (SELECT p.symbol, p.bar, p.direction, any_value(p.entry_price) AS entry_price, any_value(p.stop_price) AS stop_price, any_value(p.target_price) AS target_price,
              min(CASE WHEN (p.direction = 1 AND (c.low <= p.stop_price OR c.high >= p.target_price)) OR (p.direction = -1 AND (c.high >= p.stop_price OR c.low <= p.target_price)) THEN c.bar END) AS hit_bar, max(c.bar) AS last_bar
              FROM {name}_p p JOIN {source} c ON c.symbol = p.symbol AND c.bar BETWEEN p.bar + 1 AND p.bar + {b.max_hold_bars + 1} GROUP BY ALL)""",
            f"""{name}_r AS (SELECT h.*, coalesce(hit_bar, last_bar) AS exit_bar, CASE WHEN hit_bar IS NULL THEN 'time' WHEN (h.direction = 1 AND c.low <= stop_price) OR (h.direction = -1 AND c.high >= stop_price) THEN 'stop' ELSE 'target' END AS exit_reason, c.close AS last_close
              FROM {name}_h h JOIN {source} c ON c.symbol = h.symbol AND c.bar = coalesce(h.hit_bar, h.last_bar))""",
            f"""{name} AS (SELECT symbol, bar, direction, bar + 1 AS entry_bar, exit_bar, entry_price, stop_price, target_price, exit_price, exit_reason, {b.risk_per_trade_pct / 100!r} * ((exit_price - entry_price) * direction - entry_price * {b.fee_pct / 100 * 2!r}) / (entry_price * {b.stop_loss_pct / 100!r}) AS g
              FROM (SELECT *, CASE exit_reason WHEN 'time' THEN last_close WHEN 'stop' THEN stop_price ELSE target_price END AS exit_price FROM {name}_r))"""]


def oracle_chain(fires: str, b: Bracket = Bracket(), out: str = "outcomes", name: str = "chain") -> list[str]:
    """CTEs for DuckDB from `fires` (k, symbol, bar, direction): `chain` (k, bar, exit_bar, pnl, equity) and `chain_stats`."""
    return [f"{name}_f AS (SELECT f.k, f.bar, o.exit_bar, o.g FROM {fires} f JOIN {out} o ON o.symbol = f.symbol AND o.bar = f.bar AND o.direction = f.direction)",
            f"{name}_n AS (SELECT a.*, (SELECT min(b.bar) FROM {name}_f b WHERE b.k = a.k AND b.bar > a.exit_bar) AS next_bar, row_number() OVER (PARTITION BY k ORDER BY bar) AS place FROM {name}_f a)",
            f"""{name} AS (SELECT k, bar, exit_bar, next_bar, {b.initial_capital!r}::DOUBLE * g AS pnl, {b.initial_capital!r}::DOUBLE * (1 + g) AS equity, 1 AS n FROM {name}_n WHERE place = 1
              UNION ALL SELECT x.k, x.bar, x.exit_bar, x.next_bar, c.equity * x.g, c.equity * (1 + x.g), c.n + 1 FROM {name} c JOIN {name}_n x ON x.k = c.k AND x.bar = c.next_bar)""",
            f"""{name}_stats AS (SELECT k, CAST(count(*) AS INTEGER) AS trades, round(count(*) FILTER (pnl > 0) / count(*)::DOUBLE * 100, 2) AS win_rate_pct, round(arg_max(equity, n), 2) AS final_equity, round(arg_max(equity, n) - {b.initial_capital!r}, 2) AS total_pnl,
              round(coalesce(sum(pnl) FILTER (pnl > 0), 0), 2) AS total_profit, round(coalesce(sum(pnl) FILTER (pnl <= 0), 0), 2) AS total_loss, round((arg_max(equity, n) - {b.initial_capital!r}) / {b.initial_capital!r} * 100, 2) AS return_pct,
              round((arg_max(equity, n) - {b.initial_capital!r}) / count(*), 4) AS avg_pnl_per_trade, round(max((peak - equity) / peak * 100), 2) AS max_drawdown_pct
              FROM (SELECT *, max(equity) OVER (PARTITION BY k ORDER BY n) AS peak FROM {name}) GROUP BY k)"""]
