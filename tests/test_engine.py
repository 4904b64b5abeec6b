"""Hand fixtures and oracle parity of the candle, signal and combination engine."""

import random

import duckdb
import pytest

from wickwork.functions.dialect import SPARK, apply
from wickwork.operators import combos, indicators, signals, trades, zones
from wickwork.plans import catalog, report
from wickwork.sources import candles

SF = "/root/testdata/sf0.001"
BAR = "symbol string, bar bigint, open double, high double, low double, close double"


def test_reference_tables_match_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    for name in ("candles_hourly", "trade_outcomes", "chunk_ranges", "union_first_of_each", "candles_from_json"):
        df = catalog.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        got = sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())
        want = sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in db.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall())
        assert got == want, name


def bars(spark, rows, symbol="A"):
    return spark.createDataFrame([(symbol, i, *map(float, r)) for i, r in enumerate(rows)], BAR)


def test_bracket_stop_before_target_and_time_exit(spark):
    df = bars(spark, [(100, 100, 100, 100), (100, 102, 99, 100), (100, 100.2, 99.9, 100.1), (100, 100.1, 99.95, 100.05)])
    out = {(r.bar, r.direction): r for r in trades.outcomes(df, trades.Bracket(max_hold_bars=1)).collect()}
    assert out[0, 1].exit_reason == "stop" and out[0, 1].exit_bar == 1
    assert out[1, 1].exit_reason == "time" and out[1, 1].exit_bar == 3
    assert (3, 1) not in out  # a signal on the last bar can't enter


def test_chain_skips_signals_inside_a_trade_and_ignores_the_first_loss_in_drawdown(spark):
    out = spark.createDataFrame([("A", 0, 1, 3, -0.1), ("A", 3, 1, 4, 0.5), ("A", 4, 1, 6, 0.2), ("A", 7, 1, 8, -0.5)], "symbol string, bar bigint, direction int, exit_bar bigint, g double")
    fires = out.select("symbol", "bar", "direction").selectExpr("*", "'s' AS signal")
    row = trades.statistics(trades.chained(fires, out, ["symbol", "signal"]), ["symbol", "signal"]).first()
    assert row.trades == 3 and row.final_equity == round(100 * 0.9 * 1.2 * 0.5, 2) and row.max_drawdown_pct == 50.0


def zone_loop(rows, atr, max_age=50, most=3):
    """A plain version of gap fills on lists."""
    gaps, out = {1: [], -1: []}, []
    for i, (o, h, low, c) in enumerate(rows):
        fired = 0
        if i >= 2:
            if low > rows[i - 2][1]:
                gaps[1] = [*gaps[1], (rows[i - 2][1], low, i)][-most:]
            if h < rows[i - 2][2]:
                gaps[-1] = [*gaps[-1], (h, rows[i - 2][2], i)][-most:]
            for way in (1, -1):
                left = []
                for lo, hi, birth in gaps[way]:
                    dead = i - birth > max_age or (c < lo - atr if way > 0 else c > hi + atr)
                    hit = not fired and (low <= hi < c and c > o if way > 0 else h >= lo > c and c < o)
                    if not dead and hit:
                        fired = way
                    elif not dead:
                        left.append((lo, hi, birth))
                gaps[way] = left
        out.append(fired)
    return out


def test_gap_fills_against_a_plain_loop_for_two_symbols(spark):
    rng, both, want = random.Random(5), None, {}
    for symbol in "AB":
        price, rows = 100.0, []
        for _ in range(150):
            o = price + rng.choice([-1, 0, 0, 1.5]) * rng.random()
            c = o + rng.gauss(0, 1)
            rows.append((o, max(o, c) + rng.random() * 0.3, min(o, c) - rng.random() * 0.3, c))
            price = c
        want |= {(symbol, i): x for i, x in enumerate(zone_loop(rows, 0.8))}
        df = bars(spark, rows, symbol)
        both = df if both is None else both.unionByName(df)
    found = zones.zone_signals(both.selectExpr("*", "0.8D AS ATR_14")).collect()
    assert {(r.symbol, r.bar): r.sig_fvg_fill for r in found} == want and any(want.values())


def test_structure_breaks_against_a_plain_loop(spark):
    rng, price, rows = random.Random(9), 100.0, []
    for _ in range(250):
        o = price
        c = round(o + rng.choice([-1, -0.5, 0, 0.5, 1]), 1)
        rows.append((o, max(o, c) + rng.choice([0, 0.5]), min(o, c) - rng.choice([0, 0.5]), c))
        price = c
    extra = {c: 1.0 for c in "BB_upper BB_lower BB_middle KC_upper KC_lower EMA_20 EMA_50 supertrend_direction MACD_hist DMP_14 DMN_14 ADX_14 VWAP RSI_14 ATR_14 volume_ratio".split()}
    df = bars(spark, rows).selectExpr("*", *(f"{v}D AS {k}" for k, v in extra.items()))
    found = apply(df, signals.stages(SPARK)).orderBy("bar").select("bar", "last_swing_high", "last_swing_low", "sig_bos", "sig_choch", "structure_trend").collect()
    trend, used_high, used_low = 0, None, None
    for r, bar in zip(found, rows, strict=True):
        bos = choch = 0
        close, high, low = bar[3], r.last_swing_high, r.last_swing_low
        if high is not None and high != used_high and close > high:
            bos, choch = (bos, 1) if trend == -1 else (1, choch)
            trend, used_high = 1, high
        if low is not None and low != used_low and close < low:
            bos, choch = (bos, -1) if trend == 1 else (-1, choch)
            trend, used_low = -1, low
        assert (r.sig_bos, r.sig_choch, r.structure_trend) == (bos, choch, trend), r.bar


def test_bitmaps_count_pairs_like_a_join(spark):
    rng = random.Random(2)
    rows = [("A", d, c, k, b) for d in ("Long", "Short") for k, c in enumerate("xyz") for b in range(200) if rng.random() < 0.5]
    conds = spark.createDataFrame(rows, "symbol string, direction string, cond string, rank int, bar bigint")
    import pyspark.sql.functions as F

    pool = combos.pool(conds)
    front = pool.select("symbol", "direction", F.array("cond").alias("conditions"), F.array("rank").alias("ranks"), "fires", "bits", F.lit(0.0).alias("score"))
    got = {(r.direction, *r.conditions): r.fires for r in combos.extended(front, pool).collect()}
    sets = {(d, c): {r[4] for r in rows if r[1] == d and r[2] == c} for d in ("Long", "Short") for c in "xyz"}
    assert got == {(d, a, b): len(sets[d, a] & sets[d, b]) for d in ("Long", "Short") for a, b in ("xy", "xz", "yz")}


def test_condition_names(spark):
    with pytest.raises(ValueError):
        report.condition("close")
    assert str(report.condition("donchian (L)"))


def test_csv_cache_round_trip(spark, tmp_path):
    df = candles.candles(spark, SF, single=True).limit(50)
    back = candles.cached(spark, str(tmp_path / candles.cache_name("ALL", "1h", 30)), "ALL", lambda: df)
    assert back.count() == 50 and sorted(r.close for r in back.collect()) == sorted(r.close for r in df.collect())


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())


def test_whole_search_takes_every_column_and_signal(spark, monkeypatch):
    seen = {}

    def search(df, columns, marks, s):
        seen.update(columns=columns, marks=marks, search=s)
        raise InterruptedError

    monkeypatch.setattr(combos, "search", search)
    df = catalog.features.table(spark, SF)
    monkeypatch.setattr(catalog, "_all", lambda s, d: df)
    for name in ("all_combo_backtest", "all_combo_topn", "all_combo_top_by_direction", "all_combo_best_per_size", "all_combo_top_winrate", "all_combo_funnel", "all_condition_dictionary", "report_documents", "chart_payload"):
        seen.clear()
        with pytest.raises(InterruptedError):
            catalog.QUERIES[name](spark, SF)
        assert seen["marks"] == signals.SIGNALS and seen["search"] == combos.Search(), name
        assert {*indicators.INDICATORS, "RSI_14"} <= set(seen["columns"]) and len(seen["columns"]) == 103 and not {"close", "bar", "swing_high_at_pivot"} & set(seen["columns"]), name


def test_entry_ranks_the_zone_signals_too(spark):
    import __spark_entry__ as e

    table = catalog.features.table(spark, SF).select("symbol", "bar", "open", "high", "low", "close", *signals.ZONE_SIGNALS).cache()
    exits = {(r.symbol, r.bar, r.direction): (r.exit_bar, r.g) for r in trades.outcomes(table).collect()}
    want = {}
    for r in table.orderBy("symbol", "bar").collect():
        for name in signals.ZONE_SIGNALS:
            n, free, equity = want.get((r.symbol, name), (0, -1, 100.0))
            if r[name] and r.bar >= free and (r.symbol, r.bar, r[name]) in exits:
                exit_bar, g = exits[r.symbol, r.bar, r[name]]
                want[r.symbol, name] = n + 1, exit_bar + 1, equity * (1 + g)
    got = {(r.symbol, r.signal): (r.trades, r.final_equity) for r in e.entry(spark).collect()}
    assert want and {k: (n, round(x, 2)) for k, (n, _, x) in want.items()} == {k: x for k, x in got.items() if k[1] in signals.ZONE_SIGNALS}
