"""Every registered query of the candle, signal and combination engine, with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.functions.dialect import DUCK, SPARK, apply, rendered
from wickwork.functions.storage import kept, stored
from wickwork.operators import combos, indicators, signals, trades
from wickwork.sources import candles

from . import features, report

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
#: A small pool for the searches that are held against SQL.
COLUMNS, MARKS = ["RSI_14", "volume_ratio", "close_position", "zscore_10", "MACD_hist"], ["sig_donchian", "sig_engulfing", "sig_pinbar", "sig_swing_break"]
SEARCH = combos.Search(max_combo_size=3)
EXPORTED = ["RSI_14>median", "volume_ratio>median"]
NATIVE = {"basic", "volume", "candle", "statistical"}


def add(name: str, query: Callable, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def rounded(columns: list[str], places: int = 6) -> list[str]:
    return ["symbol", "bar", *(f"round(CAST({c} AS DOUBLE), {places}) + 0e0 AS {c}" for c in columns)]


def _select(columns: list[str], source: str, places: int = 6) -> str:
    return f"SELECT {', '.join(rounded(columns, places))} FROM {source}"


def native(spark, sf_dir) -> DataFrame:
    return apply(candles.candles(spark, sf_dir), indicators.native(SPARK))


def enriched(spark, sf_dir) -> DataFrame:
    return features.enriched(candles.candles(spark, sf_dir))


def whole(spark, sf_dir) -> DataFrame:
    """All columns but the zone signals, written once for the queries that read them several times."""
    return kept(spark, ("whole", sf_dir), lambda: stored(features.table(spark, sf_dir, zoned=False)))


def native_oracle(columns: list[str]) -> str:
    fills = [{f"b_{c}": DUCK.back_fill(c) for c in columns}, {f"f_{c}": DUCK.forward_fill(f"b_{c}") for c in columns}]
    ctes = [*candles.oracle(), *rendered("candles", [*indicators.native(DUCK), *fills], "features"), f"named AS (SELECT symbol, bar, {', '.join(f'f_{c} AS {c}' for c in columns)} FROM features)"]
    return features.query(ctes, _select(columns, "named", 5))


def native_query(columns: list[str]) -> Callable:
    def run(spark, sf_dir):
        fills = [{f"b_{c}": SPARK.back_fill(c) for c in columns}, {f"f_{c}": SPARK.forward_fill(f"b_{c}") for c in columns}]
        return apply(native(spark, sf_dir), fills).selectExpr("symbol", "bar", *(f"f_{c} AS {c}" for c in columns)).selectExpr(*rounded(columns, 5))

    return run


_TS = "CAST(ts AS VARCHAR)"
add("candles_hourly", lambda s, d: candles.candles(s, d).select("symbol", "bar", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *indicators.BASE),
    features.query(candles.oracle(), f"SELECT symbol, bar, {_TS} AS ts, open, high, low, close, volume FROM candles"))
add("candles_single_symbol", lambda s, d: candles.candles(s, d, single=True).select("symbol", "bar", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *indicators.BASE),
    features.query(candles.oracle(single=True), f"SELECT symbol, bar, {_TS} AS ts, open, high, low, close, volume FROM candles"))

for _group, _names in indicators.GROUPS.items():
    _columns = _names.split()
    if _group in NATIVE:
        add(f"indicators_{_group}", native_query(_columns), native_oracle(_columns))
    else:
        _columns = [*_columns, "RSI_14"] if _group == "momentum" else _columns
        add(f"indicators_{_group}", lambda s, d, c=_columns: enriched(s, d).selectExpr(*rounded(c, 5)), features.query(features.oracle(), _select(_columns, "enriched", 5)))

add("structure", lambda s, d: features.table(s, d, zoned=False).selectExpr(*rounded(signals.STRUCTURE)), features.query(features.oracle(), _select(signals.STRUCTURE, "signalled")))
for _signal in signals.SIGNALS:
    _zone = _signal in signals.ZONE_SIGNALS
    add(_signal, lambda s, d, c=_signal, z=_zone: features.table(s, d, zoned=z).select("symbol", "bar", F.col(c).cast("int").alias(c)),
        None if _zone else features.query(features.oracle(), f"SELECT symbol, bar, CAST({_signal} AS INTEGER) AS {_signal} FROM signalled"))

PLAIN = [c for c in signals.SIGNALS if c not in signals.ZONE_SIGNALS]
add("signal_totals", lambda s, d: trades.fired(features.table(s, d, zoned=False), PLAIN).groupBy("symbol", "signal").agg(F.count("*").alias("fires"), F.sum(F.col("direction").cast("bigint")).alias("balance")),
    features.query(features.oracle(), f"SELECT symbol, signal, count(*) AS fires, CAST(sum(direction) AS BIGINT) AS balance FROM (UNPIVOT signalled ON {', '.join(PLAIN)} INTO NAME signal VALUE direction) WHERE direction <> 0 GROUP BY ALL"))

_OUT = ["entry_price", "stop_price", "target_price", "exit_price", "g"]
add("trade_outcomes", lambda s, d: trades.outcomes(candles.candles(s, d)).selectExpr("symbol", "bar", "direction", "entry_bar", "exit_bar", "exit_reason", *(f"round({c}, 6) AS {c}" for c in _OUT)),
    features.query([*candles.oracle(), *trades.oracle_outcomes("candles")], f"SELECT symbol, bar, direction, entry_bar, exit_bar, exit_reason, {', '.join(f'round({c}, 6) AS {c}' for c in _OUT)} FROM outcomes"))

_FIRES = f"fires AS (SELECT symbol || '|' || signal AS k, symbol, bar, CAST(direction AS INTEGER) AS direction FROM (UNPIVOT signalled ON {', '.join(PLAIN)} INTO NAME signal VALUE direction) WHERE direction <> 0)"
_STATS = ["win_rate_pct", "final_equity", "total_pnl", "total_profit", "total_loss", "return_pct", "avg_pnl_per_trade", "max_drawdown_pct"]


def _signal_stats(spark, sf_dir) -> DataFrame:
    return trades.backtest(whole(spark, sf_dir), PLAIN)


_STATS_CTES = [*features.oracle(), *trades.oracle_outcomes("candles"), _FIRES, *trades.oracle_chain("fires")]
add("signal_stats", lambda s, d: trades.ranked(_signal_stats(s, d)).select("symbol", "signal", "trades", *_STATS),
    features.query(_STATS_CTES, f"SELECT split_part(k, '|', 1) AS symbol, split_part(k, '|', 2) AS signal, trades, {', '.join(_STATS)} FROM chain_stats"))
add("profitable_signals", lambda s, d: _signal_stats(s, d).filter("total_pnl > 0").select("symbol", "signal", "total_pnl"),
    features.query(_STATS_CTES, "SELECT split_part(k, '|', 1) AS symbol, split_part(k, '|', 2) AS signal, total_pnl FROM chain_stats WHERE total_pnl > 0"))
add("best_signal", lambda s, d: trades.ranked(_signal_stats(s, d)).limit(1).select("symbol", "signal", "trades", "total_pnl"),
    features.query(_STATS_CTES, "SELECT split_part(k, '|', 1) AS symbol, split_part(k, '|', 2) AS signal, trades, total_pnl FROM chain_stats ORDER BY total_pnl DESC, symbol, signal LIMIT 1"))


def _trade_list(spark, sf_dir) -> DataFrame:
    df = whole(spark, sf_dir)
    out = trades.trade_list(trades.fired(df, PLAIN), trades.outcomes(df), ["symbol", "signal"])
    return out.select("symbol", "signal", "bar", "exit_bar", F.round("pnl", 5).alias("pnl"), F.round("equity_after", 5).alias("equity_after"))


add("signal_trades", _trade_list, features.query(_STATS_CTES, "SELECT split_part(k, '|', 1) AS symbol, split_part(k, '|', 2) AS signal, bar, exit_bar, round(pnl, 5) AS pnl, round(equity, 5) AS equity_after FROM chain"))

_B0 = trades.Bracket()
_RECORD = ["entry_price", "exit_price", "stop_price", "target_price", "position_size", "pnl", "equity_after"]


def _records(spark, sf_dir) -> DataFrame:
    df = whole(spark, sf_dir)
    out = trades.records(trades.trade_list(trades.fired(df, PLAIN), trades.outcomes(df), ["symbol", "signal"]), df)
    return out.select("symbol", "signal", "direction", "exit_reason", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("entry_time", "exit_time")], *[F.round(c, 5).alias(c) for c in _RECORD])


add("signal_trade_records", _records, features.query(_STATS_CTES, f"""SELECT o.symbol, split_part(t.k, '|', 2) AS signal, CASE WHEN o.direction > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, exit_reason, CAST(a.ts AS VARCHAR) AS entry_time, CAST(b.ts AS VARCHAR) AS exit_time,
  round(entry_price, 5) AS entry_price, round(exit_price, 5) AS exit_price, round(stop_price, 5) AS stop_price, round(target_price, 5) AS target_price, round((equity - pnl) * {_B0.risk_per_trade_pct / 100!r} / (entry_price * {_B0.stop_loss_pct / 100!r}), 5) AS position_size, round(pnl, 5) AS pnl, round(equity, 5) AS equity_after
  FROM chain t JOIN fires f ON f.k = t.k AND f.bar = t.bar JOIN outcomes o ON o.symbol = f.symbol AND o.bar = f.bar AND o.direction = f.direction JOIN candles a ON a.symbol = o.symbol AND a.bar = o.entry_bar JOIN candles b ON b.symbol = o.symbol AND b.bar = o.exit_bar"""))
_FREE = trades.Bracket(fee_pct=0.0)
add("no_fee_comparison", lambda s, d: trades.no_fee_comparison(whole(s, d), PLAIN),
    features.query([*_STATS_CTES, *trades.oracle_outcomes("candles", _FREE, "free"), *trades.oracle_chain("fires", _FREE, "free", "free_chain")],
                   "SELECT split_part(a.k, '|', 1) AS symbol, split_part(a.k, '|', 2) AS signal, a.trades, a.total_pnl AS pnl_no_fee, b.total_pnl AS pnl_with_fee, round(a.total_pnl - b.total_pnl, 2) AS fee_drag FROM free_chain_stats a LEFT JOIN chain_stats b USING (k)"))
_B = trades.Bracket()
add("breakeven", lambda s, d: s.range(1).select(F.round(F.lit(_B.breakeven_win_rate_pct), 6).alias("breakeven"), F.round(F.lit(_B.fee_adjusted_breakeven_win_rate_pct), 6).alias("fee_adjusted"), F.lit(_B.leverage).alias("leverage"), F.lit(_B.fee_pct_of_risk).alias("fee_pct_of_risk")),
    "SELECT round(100.0::DOUBLE / (1 + 1.0 / 0.5), 6) AS breakeven, round((1 + 0.05::DOUBLE * 2 / 0.5) * 100 / (1 + 1.0 / 0.5), 6) AS fee_adjusted, 4.0::DOUBLE AS leverage, 20.0::DOUBLE AS fee_pct_of_risk")
_MERGED = ["sig_donchian", "sig_sr_breakout"]


def _combined(spark, sf_dir) -> DataFrame:
    """One account over both directions of several signals; on one bar Long goes first."""
    df = whole(spark, sf_dir)
    hits = trades.fired(df, _MERGED).groupBy("symbol", "bar").agg(F.max("direction").alias("direction"))
    return trades.statistics(trades.chained(hits, trades.outcomes(df), ["symbol"]), ["symbol"]).select("symbol", "trades", *_STATS)


add("combined_long_short", _combined, features.query([*features.oracle(), *trades.oracle_outcomes("candles"),
    f"fires AS (SELECT symbol AS k, symbol, bar, CAST(max(direction) AS INTEGER) AS direction FROM (UNPIVOT signalled ON {', '.join(_MERGED)} INTO NAME signal VALUE direction) WHERE direction <> 0 GROUP BY ALL)", *trades.oracle_chain("fires")],
    f"SELECT k AS symbol, trades, {', '.join(_STATS)} FROM chain_stats"))

# --- conditions and combinations
_W = f"(PARTITION BY symbol ORDER BY bar ROWS BETWEEN {SEARCH.condition_window - 1} PRECEDING AND CURRENT ROW)"
_CONDITIONS = [
    *features.oracle(),
    "conds AS (" + " UNION ALL ".join([
        *(f"SELECT symbol, CASE WHEN v > m THEN 'Long' ELSE 'Short' END AS direction, '{c}' || CASE WHEN v > m THEN '>median' ELSE '<median' END AS cond, {k} AS rank, bar FROM (SELECT symbol, bar, CAST({c} AS DOUBLE) AS v, CASE WHEN count({c}) OVER {_W} = {SEARCH.condition_window} THEN quantile_cont(CAST({c} AS DOUBLE), 0.5) OVER {_W} END AS m FROM signalled) WHERE v <> m" for k, c in enumerate(COLUMNS)),
        *(f"SELECT symbol, CASE WHEN {c} > 0 THEN 'Long' ELSE 'Short' END AS direction, '{c[4:]}' || CASE WHEN {c} > 0 THEN ' (L)' ELSE ' (S)' END AS cond, {len(COLUMNS) + k} AS rank, bar FROM signalled WHERE {c} <> 0" for k, c in enumerate(MARKS))]) + ")",
    f"pool AS (SELECT symbol, direction, cond, rank, count(*) AS fires FROM conds GROUP BY ALL HAVING count(*) >= {SEARCH.min_fires})",
    "kept AS (SELECT c.* FROM conds c JOIN pool USING (symbol, direction, cond))",
    f"level2 AS (SELECT a.symbol, a.direction, a.cond AS c1, b.cond AS c2, a.rank AS r1, b.rank AS r2, count(*) AS fires FROM kept a JOIN kept b ON a.symbol = b.symbol AND a.direction = b.direction AND a.bar = b.bar AND b.rank > a.rank GROUP BY ALL HAVING count(*) >= {SEARCH.min_fires})",
    f"level3 AS (SELECT a.symbol, a.direction, a.cond AS c1, b.cond AS c2, c.cond AS c3, count(*) AS fires FROM kept a JOIN kept b ON a.symbol = b.symbol AND a.direction = b.direction AND a.bar = b.bar AND b.rank > a.rank JOIN kept c ON a.symbol = c.symbol AND a.direction = c.direction AND a.bar = c.bar AND c.rank > b.rank GROUP BY ALL HAVING count(*) >= {SEARCH.min_fires})",
]
_COMBO_FIRES = [*_CONDITIONS, *trades.oracle_outcomes("candles"), f"""fires AS (
  SELECT symbol || '|' || direction || '|' || cond AS k, symbol, bar, CASE WHEN direction = 'Long' THEN 1 ELSE -1 END AS direction FROM kept
  UNION ALL SELECT a.symbol || '|' || a.direction || '|' || a.cond || ' AND ' || b.cond, a.symbol, a.bar, CASE WHEN a.direction = 'Long' THEN 1 ELSE -1 END FROM kept a JOIN kept b ON a.symbol = b.symbol AND a.direction = b.direction AND a.bar = b.bar AND b.rank > a.rank
  UNION ALL SELECT a.symbol || '|' || a.direction || '|' || a.cond || ' AND ' || b.cond || ' AND ' || c.cond, a.symbol, a.bar, CASE WHEN a.direction = 'Long' THEN 1 ELSE -1 END FROM kept a JOIN kept b ON a.symbol = b.symbol AND a.direction = b.direction AND a.bar = b.bar AND b.rank > a.rank JOIN kept c ON a.symbol = c.symbol AND a.direction = c.direction AND a.bar = c.bar AND c.rank > b.rank)""",
    *trades.oracle_chain("fires"),
    f"results AS (SELECT split_part(k, '|', 1) AS symbol, split_part(k, '|', 2) AS direction, split_part(k, '|', 3) AS combo, CAST(len(string_split(split_part(k, '|', 3), ' AND ')) AS INTEGER) AS size, f.fires, trades, win_rate_pct AS win_rate, final_equity, total_pnl, return_pct FROM chain_stats JOIN (SELECT k, count(*) AS fires FROM fires GROUP BY k HAVING count(*) >= {SEARCH.min_fires}) f USING (k) WHERE trades >= {SEARCH.min_fires})"]
_RESULT = ["symbol", "direction", "combo", "size", "fires", "trades", "win_rate", "final_equity", "total_pnl", "return_pct"]


def _base(spark, sf_dir) -> DataFrame:
    """The columns of the small pool."""
    return whole(spark, sf_dir).select("symbol", "bar", "ts", *indicators.BASE, *COLUMNS, *MARKS)


def _conds(spark, sf_dir) -> DataFrame:
    return combos.conditions(_base(spark, sf_dir), COLUMNS, MARKS, SEARCH)


def _levels(spark, sf_dir) -> tuple[DataFrame, list[dict]]:
    """One search, shared by the queries that read its results."""
    return kept(spark, ("search", sf_dir), lambda: combos.search(_base(spark, sf_dir), COLUMNS, MARKS, SEARCH))


def _searched(spark, sf_dir) -> DataFrame:
    return _levels(spark, sf_dir)[0]


def _level(n: int) -> Callable:
    def run(spark, sf_dir):
        pool = stored(combos.pool(_conds(spark, sf_dir), SEARCH))
        front = pool.select("symbol", "direction", F.array("cond").alias("conditions"), F.array("rank").alias("ranks"), "fires", "bits", F.lit(0.0).alias("score"))
        for _ in range(n - 1):
            front = combos.extended(front, pool, SEARCH)
        return front.select("symbol", "direction", *[F.col("conditions")[k].alias(f"c{k + 1}") for k in range(n)], "fires")

    return run


add("rolling_median_conditions", lambda s, d: _conds(s, d).select("symbol", "direction", "cond", "bar"), features.query(_CONDITIONS, "SELECT symbol, direction, cond, bar FROM conds"))
add("condition_pool_counts", lambda s, d: combos.pool(_conds(s, d), SEARCH).select("symbol", "direction", "cond", F.col("rank").cast("int").alias("rank"), "fires"), features.query(_CONDITIONS, "SELECT symbol, direction, cond, CAST(rank AS INTEGER) AS rank, fires FROM pool"))
add("dropped_columns", lambda s, d: combos.dropped_columns(_base(s, d), [*COLUMNS, *MARKS], combos.pool(_conds(s, d), SEARCH)),
    features.query(_CONDITIONS, f"SELECT s.symbol, c.col FROM (SELECT DISTINCT symbol FROM signalled) s, (VALUES {', '.join(f'({k}, {c!r})' for k, c in enumerate([*COLUMNS, *MARKS]))}) c(rank, col) WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.symbol = s.symbol AND p.rank = c.rank)"))
add("combo_level2_fires", _level(2), features.query(_CONDITIONS, "SELECT symbol, direction, c1, c2, fires FROM level2"))
add("combo_level3_fires", _level(3), features.query(_CONDITIONS, "SELECT symbol, direction, c1, c2, c3, fires FROM level3"))
add("combo_backtest", lambda s, d: _searched(s, d).select(*_RESULT), features.query(_COMBO_FIRES, f"SELECT {', '.join(_RESULT)} FROM results"))
add("combo_topn", lambda s, d: combos.top(_searched(s, d), SEARCH.console_top_n).select(*_RESULT), features.query(_COMBO_FIRES, f"SELECT {', '.join(_RESULT)} FROM results WHERE total_pnl > 0 ORDER BY total_pnl DESC, symbol, direction, combo LIMIT {SEARCH.console_top_n}"))
add("combo_top_by_direction", lambda s, d: combos.top(_searched(s, d), 20, by_direction=True).select(*_RESULT, F.col("place").cast("int").alias("place")),
    features.query(_COMBO_FIRES, f"SELECT {', '.join(_RESULT)}, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY total_pnl DESC, symbol, combo) AS place FROM results WHERE total_pnl > 0) WHERE place <= 20"))
add("combo_best_per_size", lambda s, d: combos.best_per_size(_searched(s, d)).select(*_RESULT), features.query(_COMBO_FIRES, f"SELECT {', '.join(_RESULT)} FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY total_pnl DESC, symbol, direction, combo) AS place FROM results) WHERE place = 1"))
add("combo_top_winrate", lambda s, d: combos.top_win_rate(_searched(s, d)).select(*_RESULT), features.query(_COMBO_FIRES, f"SELECT {', '.join(_RESULT)} FROM results ORDER BY win_rate DESC, total_pnl DESC, symbol, direction, combo LIMIT 5"))
add("condition_dictionary", lambda s, d: report.dictionary(_searched(s, d)).select("cond", F.col("number").cast("int").alias("number")), features.query(_COMBO_FIRES, "SELECT cond, CAST(row_number() OVER (ORDER BY cond) - 1 AS INTEGER) AS number FROM (SELECT DISTINCT unnest(string_split(combo, ' AND ')) AS cond FROM results)"))


def _funnel(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame([(x["size"], int(x["survivors"])) for x in _levels(spark, sf_dir)[1] if "survivors" in x], "size int, survivors bigint")


add("combo_funnel", _funnel, features.query(_CONDITIONS, "SELECT 1 AS size, count(*) AS survivors FROM pool UNION ALL SELECT 2, count(*) FROM level2 UNION ALL SELECT 3, count(*) FROM level3"))
add("mask_bitstring", lambda s, d: report.bitstrings(report.masked(_base(s, d), EXPORTED)),
    features.query([*_CONDITIONS, "hit AS (SELECT a.symbol, a.bar FROM conds a JOIN conds b USING (symbol, bar) WHERE a.cond = 'RSI_14>median' AND b.cond = 'volume_ratio>median')"],
                   "SELECT s.symbol, string_agg(CASE WHEN h.bar IS NULL THEN '0' ELSE '1' END, '' ORDER BY s.bar) AS bits FROM signalled s LEFT JOIN hit h USING (symbol, bar) GROUP BY s.symbol"))
_ALL = [*features.BARS, *indicators.INDICATORS, "RSI_14", *signals.STRUCTURE, *PLAIN]
add("dataset_summary", lambda s, d: report.dataset(features.table(s, d, zoned=False).select(*_ALL)),
    features.query(features.oracle(), f"SELECT count(*) AS n_rows, {len(_ALL)} AS n_columns, CAST(min(ts) AS VARCHAR) AS first_ts, CAST(max(ts) AS VARCHAR) AS last_ts, CAST({' + '.join(f'count(*) - count({c})' for c in _ALL)} AS BIGINT) AS n_missing FROM signalled"))

# --- the whole search: every indicator and structure column, all signals, the default sizes. SQL can't follow the zone signals' folds.
EVERY = combos.Search()


def _all(spark, sf_dir) -> DataFrame:
    """All columns with the zone signals, written once for the queries that read them several times."""
    return kept(spark, ("all", sf_dir), lambda: stored(features.table(spark, sf_dir, zoned=True)))


def _all_pool(spark, sf_dir) -> tuple[DataFrame, list[str], DataFrame]:
    """The table, the columns that take part, and the pool of their conditions."""
    df = _all(spark, sf_dir)
    columns, marks = combos.pool_columns(df)
    return df, [*columns, *marks], combos.pool(combos.conditions(df, columns, marks, EVERY), EVERY)


def _all_levels(spark, sf_dir) -> tuple[DataFrame, list[dict]]:
    """One search, shared by the queries that read its results."""
    df = _all(spark, sf_dir)
    return kept(spark, ("all search", sf_dir), lambda: combos.search(df, *combos.pool_columns(df), EVERY))


def _all_searched(spark, sf_dir) -> DataFrame:
    return _all_levels(spark, sf_dir)[0]


def _all_dropped(spark, sf_dir) -> DataFrame:
    return combos.dropped_columns(*_all_pool(spark, sf_dir))


def _all_funnel(spark, sf_dir) -> DataFrame:
    levels = _all_levels(spark, sf_dir)[1]
    return spark.createDataFrame([(x["size"], int(x["survivors"])) for x in levels if "survivors" in x], "size int, survivors bigint")


def _report(spark, sf_dir) -> DataFrame:
    df = _all(spark, sf_dir)
    return report.documents(df, _all_searched(spark, sf_dir), EVERY)


def _chart(spark, sf_dir) -> DataFrame:
    df = _all(spark, sf_dir)
    return report.payload(df, report.best_of_sides(_all_searched(spark, sf_dir), EVERY.console_top_n), EVERY)


def _all_stats_of_search(spark, sf_dir) -> DataFrame:
    """One row of what the search went through, and the columns without a condition in the pool."""
    n = _all_dropped(spark, sf_dir).count()
    return spark.createDataFrame([tuple(map(int, (*report.funnel(_all_levels(spark, sf_dir)[1]).values(), n)))], "long_pool_size bigint, short_pool_size bigint, combos_tested bigint, combos_cleared_min_fires bigint, combos_simulated bigint, dropped_columns bigint")


def _lines(spark, sf_dir) -> DataFrame:
    """The console reports, line by line."""
    results, levels = _all_levels(spark, sf_dir)
    text = [*report.signal_report(_all_stats(spark, sf_dir), EVERY), *report.combo_report(results, levels, EVERY)]
    return spark.createDataFrame(list(enumerate(text)), "line int, text string")


add("all_condition_pool_counts", lambda s, d: _all_pool(s, d)[2].select("symbol", "direction", "cond", F.col("rank").cast("int").alias("rank"), "fires"))
add("all_dropped_columns", _all_dropped)
add("all_combo_backtest", lambda s, d: _all_searched(s, d).select(*_RESULT))
add("all_combo_topn", lambda s, d: combos.top(_all_searched(s, d), EVERY.console_top_n).select(*_RESULT))
add("all_combo_top_by_direction", lambda s, d: combos.top(_all_searched(s, d), 20, by_direction=True).select(*_RESULT, F.col("place").cast("int").alias("place")))
add("all_combo_best_per_size", lambda s, d: combos.best_per_size(_all_searched(s, d)).select(*_RESULT))
add("all_combo_top_winrate", lambda s, d: combos.top_win_rate(_all_searched(s, d)).select(*_RESULT))
add("all_combo_funnel", _all_funnel)
add("all_condition_dictionary", lambda s, d: report.dictionary(_all_searched(s, d)).select("cond", F.col("number").cast("int").alias("number")))
add("all_combo_stats", _all_stats_of_search)
add("report_documents", _report)
add("report_lines", _lines)
add("chart_payload", _chart)

# --- sources
add("chunk_ranges", lambda s, d: candles.chunk_ranges(s, "2024-01-01", "2024-04-10").select(F.date_format("chunk_start", "yyyy-MM-dd").alias("chunk_start"), F.date_format("chunk_end", "yyyy-MM-dd").alias("chunk_end")),
    "SELECT strftime(a, '%Y-%m-%d') AS chunk_start, strftime(least(a + INTERVAL 30 DAY, TIMESTAMP '2024-04-10'), '%Y-%m-%d') AS chunk_end FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-04-09 23:00:00', INTERVAL 30 DAY)) AS a)")
add("union_first_of_each", lambda s, d: candles.united([candles.candles(s, d).filter("bar < 100").drop("bar"), candles.candles(s, d).filter("bar >= 50").drop("bar").withColumn("close", F.lit(0.0))]).select("symbol", "bar", "close"),
    features.query(candles.oracle(), "SELECT symbol, bar, CASE WHEN bar < 100 THEN close ELSE 0 END AS close FROM candles"))


def _from_json(spark, sf_dir) -> DataFrame:
    record = F.struct(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("time"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")], F.when(F.col("bar") % 7 > 0, F.col("volume").cast("string")).alias("volume"))
    bars = candles.candles(spark, sf_dir).groupBy("symbol").agg(F.collect_list(record).alias("result"))
    return candles.from_json(bars.select("symbol", F.to_json(F.struct(F.lit(True).alias("success"), "result")).alias("payload"))).select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", "close", "volume")


add("candles_from_json", _from_json, features.query(candles.oracle(), "SELECT symbol, CAST(ts + INTERVAL 330 MINUTE AS VARCHAR) AS ts, open, high, low, close, CASE WHEN bar % 7 > 0 THEN volume ELSE 0 END AS volume FROM candles"))


# --- single signals, all 24 of them. The queries above are held against SQL, which can't follow the two zone signals' folds.
def _all_stats(spark, sf_dir) -> DataFrame:
    return trades.backtest(_all(spark, sf_dir), signals.SIGNALS)


def _all_trades(spark, sf_dir) -> DataFrame:
    df = _all(spark, sf_dir)
    out = trades.trade_list(trades.fired(df, signals.SIGNALS), trades.outcomes(df), ["symbol", "signal"])
    return out.select("symbol", "signal", "bar", "exit_bar", F.round("pnl", 5).alias("pnl"), F.round("equity_after", 5).alias("equity_after"))


add("all_signal_totals", lambda s, d: trades.fired(features.table(s, d), signals.SIGNALS).groupBy("symbol", "signal").agg(F.count("*").alias("fires"), F.sum(F.col("direction").cast("bigint")).alias("balance")))
add("all_signal_stats", lambda s, d: trades.ranked(_all_stats(s, d)).select("symbol", "signal", "trades", *_STATS))
add("all_profitable_signals", lambda s, d: _all_stats(s, d).filter("total_pnl > 0").select("symbol", "signal", "total_pnl"))
add("all_best_signal", lambda s, d: trades.ranked(_all_stats(s, d)).limit(1).select("symbol", "signal", "trades", "total_pnl"))
add("all_signal_trades", _all_trades)
add("all_no_fee_comparison", lambda s, d: trades.no_fee_comparison(_all(s, d), signals.SIGNALS))
add("all_dataset_summary", lambda s, d: report.dataset(features.table(s, d)))


def flagship(spark, sf_dir) -> DataFrame:
    return QUERIES["all_signal_stats"](spark, sf_dir)
