"""Reports: condition names to predicates, masks, the combination dictionary, dataset figures, JSON documents."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.dialect import SPARK
from wickwork.operators.combos import Search, best_per_size, top, top_win_rate


def condition(name: str, window: int = 100) -> Column:
    """The predicate that a condition's name stands for: 'x (L)', 'x (S)', 'x>median', 'x<median'."""
    if name.endswith((" (L)", " (S)")):
        return F.coalesce(F.col(f"sig_{name[:-4]}") == (1 if name[-2] == "L" else -1), F.lit(False))
    for mark in (">", "<"):
        if name.endswith(f"{mark}median"):
            column = name[: -len("median") - 1]
            return F.coalesce(F.expr(f"CAST({column} AS DOUBLE) {mark} ({SPARK.median(f'CAST({column} AS DOUBLE)', window)})"), F.lit(False))
    raise ValueError(f"no condition has the form of {name!r}")


def masked(df: DataFrame, names: list[str], window: int = 100) -> DataFrame:
    """df with `mask`: whether all the conditions hold on a bar."""
    df = df.withColumns({f"__c{k}": condition(n, window) for k, n in enumerate(names)})
    return df.withColumn("mask", reduce(lambda a, b: a & b, [F.col(f"__c{k}") for k in range(len(names))])).drop(*[f"__c{k}" for k in range(len(names))])


def _characters(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n (bars), bits: one character for each bar, in order, from rows (keys, bar, mask). 64 bars are one number until the last step."""
    words = df.groupBy(*keys, F.expr("bar div 64").alias("word")).agg(F.bit_or(F.when(F.col("mask"), F.expr("shiftleft(1L, int(bar % 64))")).otherwise(F.lit(0).cast("bigint"))).alias("w"), F.count("*").alias("n"))
    text = F.reverse(F.lpad(F.bin("w"), 64, "0"))
    rows = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("word", text.alias("t")))).alias("r"), F.sum("n").alias("n"))
    return rows.select(*keys, "n", F.array_join(F.col("r.t"), "").alias("bits"))


def bitstrings(df: DataFrame) -> DataFrame:
    """symbol, bits: one character for each bar, in order; bars are numbered from 0 without gaps."""
    return _characters(df, ["symbol"]).select("symbol", F.expr("substring(bits, 1, int(n))").alias("bits"))


def masks(df: DataFrame, combos: DataFrame, window: int = 100) -> DataFrame:
    """combos (symbol, direction, combo, conditions, ...) with `mask`: their bars as characters. The distinct conditions are worked out once, together."""
    names = sorted(r[0] for r in combos.select(F.explode("conditions")).distinct().collect())  # of the few combinations that are exported
    wide = df.select("symbol", "bar", *[condition(n, window).alias(f"c{k}") for k, n in enumerate(names)])
    number = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))])
    flags = wide.select("symbol", "bar", F.array(*[f"c{k}" for k in range(len(names))]).alias("flags"))
    own = combos.select("symbol", "direction", "combo", F.transform("conditions", lambda c: number[c]).alias("numbers"))
    hits = flags.join(F.broadcast(own), "symbol").select("symbol", "direction", "combo", "bar", F.forall("numbers", lambda k: F.get("flags", k)).alias("mask"))
    made = _characters(hits, ["symbol", "direction", "combo"])
    return combos.join(made.select("symbol", "direction", "combo", F.expr("substring(bits, 1, int(n))").alias("mask")), ["symbol", "direction", "combo"])


def dictionary(combos: DataFrame) -> DataFrame:
    """cond, number: the distinct conditions of all combinations, by name from 0."""
    return combos.select(F.explode("conditions").alias("cond")).distinct().withColumn("number", F.row_number().over(Window.orderBy("cond")) - 1)


def compact(combos: DataFrame) -> DataFrame:
    """combos with `indexes`, the numbers of their conditions in order."""
    parts = combos.select("symbol", "direction", "combo", F.posexplode("conditions").alias("pos", "cond")).join(dictionary(combos), "cond")
    numbers = parts.groupBy("symbol", "direction", "combo").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "number"))), lambda x: x["number"]).alias("indexes"))
    return combos.drop("conditions", "ranks").join(numbers, ["symbol", "direction", "combo"])


def safe(x: Column) -> Column:
    """A number for JSON: null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def dataset(df: DataFrame) -> DataFrame:
    """rows, columns, first and last time, missing values: one aggregation over the table."""
    missing = reduce(lambda a, b: a + b, [F.sum(F.col(c).isNull().cast("bigint")) for c in df.columns])
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"), missing.alias("n_missing"))


def column_groups(df: DataFrame) -> dict[str, list[str]]:
    base = ("symbol", "bar", "ts", "open", "high", "low", "close", "volume")
    return {"candle": [c for c in df.columns if c in base], "signal": [c for c in df.columns if c.startswith("sig_")], "indicator": [c for c in df.columns if c not in base and not c.startswith("sig_")]}


def best_of_sides(results: DataFrame, n: int = 20) -> DataFrame:
    """The n best profitable combinations of each symbol and direction, with their place; raises if there is none at all."""
    w = Window.partitionBy("symbol", "direction").orderBy(F.desc("total_pnl"), "combo")
    out = results.filter("total_pnl > 0").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    if out.isEmpty():
        raise ValueError("no profitable combination: nothing to export")
    return out


def payload(df: DataFrame, best: DataFrame, s: Search = Search(), interval: str = "1h") -> DataFrame:
    """symbol, json: parameters, candles as arrays by column, and the best long and short combinations with their masks, for one chart page a symbol.

    best: as best_of_sides gives it. A symbol's bars are one document, as its page needs them.
    """
    number = lambda c: safe(F.col(c)).alias(c)
    bars = df.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("bar", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), *map(number, ("open", "high", "low", "close"))))).alias("c"))
    fields = ["combo", "size", "fires", "trades", safe(F.col("win_rate")).alias("win_rate_pct"), number("total_pnl"), number("return_pct"), "mask"]
    side = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("direction") == name, F.struct("place", F.struct(*fields).alias("x"))))), lambda r: r["x"])
    found = masks(df, best, s.condition_window).groupBy("symbol").agg(side("Long").alias("long_combos"), side("Short").alias("short_combos"))
    params = F.struct(*[F.lit(v).alias(k) for k, v in s.bracket.__dict__.items()], F.col("symbol"), F.lit(interval).alias("interval"))
    doc = F.struct(params.alias("params"), *[F.col(f"c.{x}").alias(x) for x in ("time", "open", "high", "low", "close")], "long_combos", "short_combos")
    return bars.join(found, "symbol", "left").select("symbol", F.to_json(doc).alias("json"))


def settings(s: Search = Search()) -> str:
    """Settings as JSON."""
    return json.dumps({**{k: v for k, v in s.__dict__.items() if k != "bracket"}, **s.bracket.__dict__}, sort_keys=True)


def stamped(s: Search = Search()) -> str:
    """Settings as JSON with the time of the export (UTC)."""
    return json.dumps({"generated_at": datetime.now(UTC).isoformat(timespec="seconds"), **json.loads(settings(s))}, sort_keys=True)


def funnel(levels: list[dict]) -> dict[str, int]:
    """What the search went through: pool sizes by direction, candidates tested, those that cleared (after trimming), and combinations simulated."""
    first, rest = levels[0], levels[1:]
    cleared = sum(x.get("survivors", 0) for x in rest)
    return {"long_pool_size": first["long"], "short_pool_size": first["short"], "combos_tested": sum(x["raw_candidates"] for x in rest), "combos_cleared_min_fires": cleared, "combos_simulated": first["survivors"] + cleared}


def table_text(df: DataFrame, title: str, n: int = 20) -> list[str]:
    """The first n rows as lines of an aligned text table."""
    cell = lambda x: "" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x)
    rows = [df.columns, *([cell(x) for x in r] for r in df.limit(n).collect())]
    wide = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return [title, *("  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip() for r in rows), ""]


def best_line(row, capital: float, name: str) -> str:
    return f"Best: {name} -> {capital:.0f} became {row['final_equity']:.2f} ({row['return_pct']:+.1f} %) over {row['trades']} trades"


def signal_report(stats: DataFrame, s: Search = Search()) -> list[str]:
    """The signals' backtest as text: profitable ones, break-even rates, the best."""
    b, good = s.bracket, stats.filter("total_pnl > 0").orderBy(F.desc("total_pnl"), "symbol", "signal")
    out = table_text(good.select("symbol", "signal", "trades", "win_rate_pct", "final_equity", "total_pnl", "return_pct", "max_drawdown_pct"), "Profitable signals", s.console_top_n)
    out.append(f"Break-even win rate {b.breakeven_win_rate_pct:.1f} %, with fees {b.fee_adjusted_breakeven_win_rate_pct:.1f} %; fees take {b.fee_pct_of_risk or 0:.1f} % of the risk of each trade")
    top = good.first()
    out.append(best_line(top, b.initial_capital, f"{top['symbol']} {top['signal']}") if top else "No signal made a profit")
    return out


def combo_report(results: DataFrame, levels: list[dict], s: Search = Search()) -> list[str]:
    """The search as text: funnel, why levels were trimmed or ended, the best combinations overall, for each size and by win rate."""
    columns = ["symbol", "size", "direction", "combo", "fires", "trades", "win_rate", "final_equity", "total_pnl", "return_pct"]
    out = [", ".join(f"{k} {v}" for k, v in funnel(levels).items())]
    reached = max(x["size"] for x in levels if x.get("survivors"))
    out.append(f"Largest size reached: {reached} of {s.max_combo_size}")
    out += [f"Size {x['size']}: {x['trimmed']} beyond the {s.max_survivors_per_level} best by symbol and direction were left out" for x in levels if x.get("trimmed")]
    out += [f"Size {x['size']}: ended by the time limit" for x in levels if x.get("ended")]
    good = results.filter("total_pnl > 0")
    out += table_text(top(results, s.console_top_n).select(*columns), "Best combinations", s.console_top_n)
    out += table_text(best_per_size(good).orderBy("size").select(*columns), "Best of each size", s.max_combo_size)
    out += table_text(top_win_rate(good).select(*columns), "Highest win rates", 5)
    first = good.orderBy(F.desc("total_pnl"), "symbol", "direction", "combo").first()
    out.append(best_line(first, s.bracket.initial_capital, f"[{first['direction']}] {first['combo']} (size {first['size']})") if first else "No combination made a profit")
    return out


def documents(df: DataFrame, combos: DataFrame, s: Search = Search()) -> DataFrame:
    """section, json: the report as one row for each section or combination."""
    head = df.sparkSession.createDataFrame([("config", stamped(s))], "section string, json string")
    groups = F.struct(*[F.array(*map(F.lit, v)).alias(k) for k, v in column_groups(df).items()]).alias("columns")
    data = dataset(df).select(F.lit("dataset").alias("section"), F.to_json(F.struct("*", groups)).alias("json"))
    words = dictionary(combos).select(F.lit("condition").alias("section"), F.to_json(F.struct("number", "cond")).alias("json"))
    numbers = {c: safe(F.col(c)) for c, kind in combos.dtypes if kind == "double"}
    rows = compact(combos.withColumns(numbers)).select(F.lit("combination").alias("section"), F.to_json(F.struct("*")).alias("json"))
    return head.unionByName(data).unionByName(words).unionByName(rows)


def save(report: DataFrame, path: str) -> None:
    report.select("json").write.mode("overwrite").text(path)
