"""The search against brute force, both of its ways, reports and payload, the HTTP source, streaming candles, order blocks."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from itertools import combinations
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from wickwork.functions.dialect import SPARK
from wickwork.operators import combos, trades, zones
from wickwork.plans import features, report
from wickwork.sources import candles, http
from wickwork.streaming import bars as stream

SF = "/root/testdata/sf0.001"
MARKS = ["sig_a", "sig_b", "sig_c", "sig_d"]


def fixture(spark, n=260, symbols="AB"):
    """Bars of a random walk with two columns and four signals."""
    rng, rows = random.Random(3), []
    for symbol in symbols:
        price = 100.0
        for i in range(n):
            open_ = price
            price = round(open_ * (1 + rng.gauss(0, 0.004)), 4)
            high, low = max(open_, price) * (1 + 0.002 * rng.random()), min(open_, price) * (1 - 0.002 * rng.random())
            rows.append((symbol, i, float(open_), high, low, price, rng.random(), float(rng.randrange(5)), *(rng.choice([-1, 0, 0, 1]) for _ in MARKS)))
    return rows, spark.createDataFrame(rows, "symbol string, bar bigint, open double, high double, low double, close double, x double, y double, " + ", ".join(f"{m} int" for m in MARKS))


def plain_median(values, i, window):
    part = sorted(values[i - window + 1 : i + 1])
    return (part[(window - 1) // 2] + part[window // 2]) / 2 if i >= window - 1 else None


def plain_search(rows, s, columns=("x", "y")):
    """(symbol, direction, combo) -> fires, trades, pnl by trying every set of conditions."""
    out, b = {}, s.bracket
    for symbol in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == symbol]
        n = len(own)
        exits = {}
        for way in (1, -1):
            for i in range(n - 1):
                entry = own[i + 1][2]
                stop, target = entry * (1 - way * b.stop_loss_pct / 100), entry * (1 + way * b.take_profit_pct / 100)
                last, price = min(n - 1, i + 1 + b.max_hold_bars), None
                for j in range(i + 1, last + 1):
                    high, low = own[j][3], own[j][4]
                    if (low <= stop) if way > 0 else (high >= stop):
                        price = stop
                    elif (high >= target) if way > 0 else (low <= target):
                        price = target
                    if price is not None:
                        break
                price = own[j][5] if price is None else price
                exits[i, way] = j, b.risk_per_trade_pct / 100 * ((price - entry) * way - entry * b.fee_pct / 100 * 2) / (entry * b.stop_loss_pct / 100)
        for direction, way in (("Long", 1), ("Short", -1)):
            conditions = []
            for k, c in enumerate(columns):
                values = [r[6 + k] for r in own]
                middle = [plain_median(values, i, s.condition_window) for i in range(n)]
                hits = {i for i in range(n) if middle[i] is not None and (values[i] - middle[i]) * way > 0}
                conditions.append((f"{c}{'>' if way > 0 else '<'}median", hits))
            conditions += [(f"{m[4:]} ({direction[0]})", {i for i in range(n) if own[i][8 + k] == way}) for k, m in enumerate(MARKS)]
            conditions = [(c, hits) for c, hits in conditions if len(hits) >= s.min_fires]
            for size in range(1, s.max_combo_size + 1):
                for chosen in combinations(conditions, size):
                    fires = sorted(set.intersection(*(hits for _, hits in chosen)))
                    free, equity, taken = -1, b.initial_capital, 0
                    for i in fires:
                        if i >= free and (i, way) in exits:
                            free, equity, taken = exits[i, way][0] + 1, equity * (1 + exits[i, way][1]), taken + 1
                    if len(fires) >= s.min_fires and taken >= s.min_fires:
                        out[symbol, direction, " AND ".join(c for c, _ in chosen)] = len(fires), taken, round(equity - b.initial_capital, 2)
    return out


@pytest.mark.parametrize("most", [combos.BROADCAST, 0])
def test_search_against_brute_force_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(combos, "BROADCAST", most)
    rows, df = fixture(spark)
    s = combos.Search(max_combo_size=4, min_fires=8, condition_window=20)
    results, levels = combos.search(df, ["x", "y"], MARKS, s)
    found = {(r.symbol, r.direction, r.combo): (r.fires, r.trades, r.total_pnl) for r in results.collect()}
    assert found == plain_search(rows, s) and len(found) > 40
    assert [x["size"] for x in levels] == list(range(1, len(levels) + 1)) and not any(x.get("trimmed") for x in levels)


@pytest.mark.parametrize("most", [combos.BROADCAST, 0])
def test_search_trims_survivors_and_keeps_raw_and_time_limits(spark, monkeypatch, most):
    monkeypatch.setattr(combos, "BROADCAST", most)
    rows, df = fixture(spark, symbols="A")
    s = combos.Search(max_combo_size=2, min_fires=8, condition_window=20, max_survivors_per_level=3)
    single = {(d, c): v[2] for (_, d, c), v in plain_search(rows, combos.Search(max_combo_size=1, min_fires=8, condition_window=20)).items()}
    results, levels = combos.search(df, ["x", "y"], MARKS, s)
    kept = {(r.direction, r.combo) for r in results.filter("size = 2").collect()}
    order = {c: k for k, c in enumerate([f"{c}{m}median" for c in "xy" for m in "<>"] + [f"{m[4:]} ({d})" for m in MARKS for d in "LS"])}
    for direction in ("Long", "Short"):
        names = sorted((c for d, c in single if d == direction), key=order.get)
        pairs = sorted((-(single[direction, a] + single[direction, b]), order[a], order[b], f"{a} AND {b}") for a, b in combinations(names, 2))
        assert {c for d, c in kept if d == direction} <= {x[3] for x in pairs[:3]}
    assert levels[1]["survivors"] == 6 and levels[1]["trimmed"] > 0
    none = combos.search(df, ["x", "y"], MARKS, combos.Search(max_combo_size=3, min_fires=8, condition_window=20, max_raw_candidates_per_level=2))[1]
    assert none[1]["survivors"] == 0
    late = combos.search(df, ["x", "y"], MARKS, combos.Search(max_combo_size=3, min_fires=8, condition_window=20, max_search_seconds=-1.0))[1]
    assert late[-1]["ended"] == "time" and len(late) == 2


def test_payload_reports_and_guards(spark):
    rows, df = fixture(spark)
    df = df.withColumn("ts", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(bar))")).withColumn("volume", F.lit(1.0))
    s = combos.Search(max_combo_size=3, min_fires=8, condition_window=20)
    results, levels = combos.search(df, ["x", "y"], MARKS, s)
    plain = plain_search(rows, s)
    with pytest.raises(ValueError):
        report.best_of_sides(results.filter("total_pnl < -1e9"))
    best = report.best_of_sides(results, 5)
    for r in report.payload(df, best, s, "1h").collect():
        page = json.loads(r.json)
        assert page["params"]["symbol"] == r.symbol and page["params"]["stop_loss_pct"] == 0.5 and len(page["time"]) == len(page["close"]) == 260
        for side, direction in (("long_combos", "Long"), ("short_combos", "Short")):
            want = sorted((-v[2], c) for (sy, d, c), v in plain.items() if sy == r.symbol and d == direction and v[2] > 0)[:5]
            assert [(-x["total_pnl"], x["combo"]) for x in page[side]] == want
            assert all(x["mask"].count("1") == x["fires"] and len(x["mask"]) == 260 for x in page[side])
    funnel = report.funnel(levels)
    assert funnel["combos_simulated"] == sum(x["survivors"] for x in levels) and funnel["long_pool_size"] == 12
    lines = report.combo_report(results, levels, s)
    assert any(x.startswith("Best: [") for x in lines) and "Largest size reached: 3 of 3" in lines
    stats = trades.backtest(df, MARKS)
    assert any("Break-even win rate 33.3 %" in x for x in report.signal_report(stats, s))
    assert json.loads(report.stamped(s))["generated_at"].endswith("+00:00")
    sections = {r.section for r in report.documents(df, results, s).collect()}
    assert sections == {"config", "dataset", "condition", "combination"}
    with pytest.raises(ValueError):
        candles.checked(df, 1000)
    assert candles.checked(df, 150).count() == 520
    odd = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "i int, v double")
    assert [r.v for r in odd.select("i", report.safe(F.col("v")).alias("v")).orderBy("i").collect()] == [None, None, 1.5]


def test_back_fill_takes_the_next_value(spark):
    rng = random.Random(4)
    rows = [(s, i, None if rng.random() < 0.6 else float(i)) for s in "AB" for i in range(300)]
    found = spark.createDataFrame(rows, "symbol string, bar bigint, v double").selectExpr("symbol", "bar", f"{SPARK.back_fill('v')} AS f").collect()
    want = {(s, i): next((v for t, j, v in rows if t == s and j >= i and v is not None), None) for s, i, _ in rows}
    assert {(r.symbol, r.bar): r.f for r in found} == want


def test_order_block_retests_against_a_plain_loop(spark):
    rng, price, rows = random.Random(6), 100.0, []
    for _ in range(400):
        open_ = price
        price = open_ + rng.choice([-1.2, -0.3, 0.3, 1.2]) * rng.random() + (1.5 if rng.random() < 0.05 else -1.5 if rng.random() < 0.05 else 0)
        rows.append((open_, max(open_, price) + rng.random() * 0.4, min(open_, price) - rng.random() * 0.4, price))
    atr, live, want = 0.8, {1: [], -1: []}, []
    for i, (o, h, low, c) in enumerate(rows):
        fired = 0
        for way in (1, -1):
            if i >= 3 and way * (c - rows[i - 3][3]) > 1.5 * atr:
                against = [k for k in range(max(0, i - 4), i) if way * (rows[k][3] - rows[k][0]) < 0]
                if against:
                    zone = rows[against[-1]][2], rows[against[-1]][1]
                    if not live[way] or live[way][-1][:2] != zone:
                        live[way] = [*live[way], (*zone, i)][-3:]
        for way in (1, -1):
            left = []
            for bottom, top, born in live[way] if i >= 3 else []:
                gone = i - born > 50 or (c < bottom - atr if way > 0 else c > top + atr)
                back = not fired and (low <= top < c and c > o if way > 0 else h >= bottom > c and c < o)
                if not gone and back:
                    fired = way
                elif not gone:
                    left.append((bottom, top, born))
            live[way] = left if i >= 3 else live[way]
        want.append(fired)
    df = spark.createDataFrame([("A", i, *r, atr) for i, r in enumerate(rows)], "symbol string, bar bigint, open double, high double, low double, close double, ATR_14 double")
    found = {r.bar: r.sig_ob_retest for r in zones.zone_signals(df).collect()}
    assert [found[i] for i in range(len(rows))] == want and {1, -1} <= set(want)


def test_http_source_retries_and_drops_failed_chunks(spark):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(q["start"])
            start = int(q["start"])
            if asked.count(q["start"]) == 1 and start == 1704067200:  # the first chunk fails once
                self.send_response(503)
                self.end_headers()
                return
            rows = [{"time": start + 3600 * k, "open": "1", "high": 2, "low": 0.5, "close": 1.5 + k, "volume": None} for k in range(-1, 2)]
            failed = start == 1704067200 + 2 * 30 * 86400
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"success": not failed, "result": rows}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        out = http.fetched(spark, "UTC", url=f"http://127.0.0.1:{server.server_port}/", symbol="X", resolution="1h", start="2024-01-01", end="2024-03-10", pause="0.01").orderBy("bar").collect()
    finally:
        server.shutdown()
    assert len(out) == 6 and [r.bar for r in out] == list(range(6)) and {r.volume for r in out} == {0.0}
    assert http.answer(f"http://127.0.0.1:{server.server_port}/", {}, retries=2, timeout=0.2, pause=0) is None


def test_streaming_candles_equal_batch_ones(spark, tmp_path):
    ticks = candles.walk(spark, SF, single=True)
    ticks.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "ticks"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "ticks")).schema).parquet(str(tmp_path / "ticks"))
    query = stream.bars(source).writeStream.format("memory").queryName("live_bars").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    live = sorted((str(r.ts), r.open, r.high, r.low, r.close) for r in spark.table("live_bars").collect())
    assert live == sorted((str(r.ts), r.open, r.high, r.low, r.close) for r in candles.resample(ticks).collect())


def test_ready_adds_the_missing_stages(spark):
    bars = candles.candles(spark, SF, single=True)
    assert set(features.ready(bars).columns) == set(features.ready(features.enriched(bars)).columns) >= {"sig_ob_retest", "sig_bos"}
    df = features.ready(bars)
    assert features.ready(df) is df


def test_partitioned_write_and_report_save(spark, tmp_path):
    bars = candles.candles(spark, SF)
    candles.write_partitioned(bars, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == bars.count()
    report.save(spark.createDataFrame([("a", "{}")], "section string, json string"), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["{}"]
