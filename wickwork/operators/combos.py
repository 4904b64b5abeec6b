"""Condition pools and the level-wise search for combinations of conditions that fire often enough.

A condition's bars are a bitmap: 64-bit words in an array for each symbol, so that a combination's bars are the bitwise AND of its members'
and fires are counted bits. A level extends each surviving combination by conditions of greater rank (each set comes up once) and
keeps what fires at least `min_fires` times. Pools are small by nature (two or so for each column); their bytes are
checked before they are broadcast, and beyond a bound bitmaps move through joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from time import monotonic

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.dialect import KEY, SPARK
from wickwork.functions.storage import stored

from . import trades

#: Bytes of bitmaps, and of outcomes, that are broadcast at most.
BROADCAST = 64 << 20


@dataclass(frozen=True)
class Search:
    min_combo_size: int = 1
    max_combo_size: int = 8
    min_fires: int = 15
    condition_window: int = 100
    max_raw_candidates_per_level: int = 20_000_000
    max_survivors_per_level: int = 20_000
    max_search_seconds: float | None = None  # off: a clock makes results differ from run to run
    console_top_n: int = 20
    bracket: trades.Bracket = field(default_factory=trades.Bracket)


def pool_columns(df: DataFrame, never: tuple[str, ...] = ("symbol", "bar", "open", "high", "low", "close", "volume", "swing_high_at_pivot", "swing_low_at_pivot")) -> tuple[list[str], list[str]]:
    """Numeric indicator columns and signal columns, in the order of the table. The two look-ahead pivot columns never take part."""
    kinds = ("double", "float", "tinyint", "smallint", "int", "bigint", "boolean", "decimal")
    numeric = [n for n, t in df.dtypes if t.split("(")[0] in kinds and n.lower() not in never]
    return [c for c in numeric if not c.startswith("sig_")], [c for c in numeric if c.startswith("sig_")]


def conditions(df: DataFrame, columns: list[str], signals: list[str], s: Search = Search()) -> DataFrame:
    """symbol, direction, cond, rank, bar: where a column lies above (Long) or below (Short) its rolling median, and where a signal fires."""
    place = {c: k for k, c in enumerate([*columns, *signals])}
    rank = F.create_map(*[x for c, k in place.items() for x in (F.lit(c), F.lit(k))])
    out = None
    if columns:
        wide = df.select("symbol", "bar", *[F.col(c).cast("double").alias(c) for c in columns])
        long = wide.unpivot(["symbol", "bar"], columns, "col", "v")
        key = KEY.replace("PARTITION BY symbol", "PARTITION BY symbol, col")
        long = long.selectExpr("symbol", "bar", "col", "v", SPARK.median("v", s.condition_window).replace(KEY, key) + " AS m", "min(v) OVER (PARTITION BY symbol, col) AS low", "max(v) OVER (PARTITION BY symbol, col) AS high").filter("low < high")
        out = long.filter("v <> m").select("symbol", F.when(F.col("v") > F.col("m"), "Long").otherwise("Short").alias("direction"), F.concat("col", F.when(F.col("v") > F.col("m"), F.lit(">median")).otherwise(F.lit("<median"))).alias("cond"), rank[F.col("col")].alias("rank"), "bar")
    if signals:
        hits = trades.fired(df, signals)
        named = hits.select("symbol", F.when(F.col("direction") > 0, "Long").otherwise("Short").alias("direction"), F.concat(F.regexp_replace("signal", "^sig_", ""), F.when(F.col("direction") > 0, F.lit(" (L)")).otherwise(F.lit(" (S)"))).alias("cond"), rank[F.col("signal")].alias("rank"), "bar")
        out = named if out is None else out.unionByName(named)
    return out


def pool(conds: DataFrame, s: Search = Search()) -> DataFrame:
    """symbol, direction, cond, rank, fires, bits: conditions that alone fire often enough."""
    words = conds.groupBy("symbol", "direction", "cond", "rank", F.expr("bar div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bar % 64))")).alias("bits"))
    own = words.groupBy("symbol", "direction", "cond", "rank").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"), F.sum(F.bit_count("bits")).alias("fires"))
    last = conds.groupBy("symbol").agg(F.max(F.expr("bar div 64")).alias("last"))
    full = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("last")), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("bigint")))
    return own.filter(F.col("fires") >= s.min_fires).join(last, "symbol").select("symbol", "direction", "cond", "rank", "fires", full.alias("bits"))


def dropped_columns(df: DataFrame, columns: list[str], kept: DataFrame) -> DataFrame:
    """symbol, col: columns none of whose conditions is in the pool."""
    names = df.select("symbol").distinct().withColumn("col", F.explode(F.array(*map(F.lit, columns))))
    used = kept.select("symbol", F.regexp_replace(F.regexp_replace("cond", r"[<>]median$", ""), r"^(.*) \([LS]\)$", "sig_$1").alias("col")).distinct()
    return names.join(used, ["symbol", "col"], "left_anti")


def ones(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))


def small(pool_: DataFrame) -> bool:
    """Whether the pool's bitmaps may be broadcast, by their bytes."""
    return pool_.agg(F.coalesce(F.sum(F.size("bits")), F.lit(0))).first()[0] * 8 <= BROADCAST


def _pools(pool_: DataFrame) -> dict[tuple[str, str], tuple[list, list, np.ndarray, np.ndarray]]:
    """For each symbol and direction: names, ranks (ascending), scores and bitmaps of its conditions. Of at most BROADCAST bytes."""
    out: dict = {}
    score = F.col("score") if "score" in pool_.columns else F.lit(0.0).alias("score")
    for r in pool_.select("symbol", "direction", "cond", "rank", "bits", score).orderBy("symbol", "direction", "rank", "cond").collect():
        out.setdefault((r.symbol, r.direction), []).append(r)
    return {k: ([r.cond for r in v], [r["rank"] for r in v], np.array([r.score for r in v]), np.array([r.bits for r in v], np.int64).view(np.uint64)) for k, v in out.items()}


def extended(front: DataFrame, pool_: DataFrame, s: Search = Search()) -> DataFrame:
    """The next level, with bitmaps: each combination with each condition of greater rank, where enough bars are left. For pools of any size."""
    one = pool_.select("symbol", "direction", F.col("cond").alias("c"), F.col("rank").alias("r"), F.col("bits").alias("b"), F.col("score").alias("sc") if "score" in pool_.columns else F.lit(0.0).alias("sc"))
    met = front.join(F.broadcast(one) if small(pool_) else one, ["symbol", "direction"]).filter(F.col("r") > F.element_at("ranks", -1))
    both = met.withColumn("bits", F.zip_with("bits", "b", lambda x, y: x.bitwiseAND(y))).withColumn("fires", ones(F.col("bits")))
    return both.filter(F.col("fires") >= s.min_fires).select("symbol", "direction", F.concat("conditions", F.array("c")).alias("conditions"), F.concat("ranks", F.array("r")).alias("ranks"), "fires", "bits", (F.col("score") + F.col("sc")).alias("score"))


def _next_level(front: DataFrame, pools, s: Search) -> DataFrame:
    """symbol, direction, places (of the members in their pool), fires, score of the next level's best combinations, and rows without places that count those that cleared.

    Each task keeps its own `max_survivors_per_level` best, so what all tasks keep holds the best of all.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found, cleared = {}, {}
            for symbol, direction, places, score in zip(part["symbol"], part["direction"], part["places"], part["score"], strict=True):
                _, ranks, scores, bits = pools.value[symbol, direction]
                own = np.bitwise_and.reduce(bits[places], axis=0)
                after = np.searchsorted(ranks, ranks[places[-1]], side="right")
                fires = np.bitwise_count(bits[after:] & own).sum(1)
                hits = np.flatnonzero(fires >= s.min_fires)
                key = symbol, direction
                cleared[key] = cleared.get(key, 0) + len(hits)
                mine = found.setdefault(key, [])
                mine += [(-(score + scores[after + k]), (*places.tolist(), int(after + k)), int(fires[k])) for k in hits.tolist()]
                if len(mine) > 2 * s.max_survivors_per_level:
                    found[key] = sorted(mine)[: s.max_survivors_per_level]
            rows = [(*key, list(places), n, -score) for key, mine in found.items() for score, places, n in sorted(mine)[: s.max_survivors_per_level]]
            yield pd.DataFrame(rows + [(*key, None, n, 0.0) for key, n in cleared.items()], columns=["symbol", "direction", "places", "fires", "score"])

    return front.select("symbol", "direction", "places", "score").mapInPandas(run, "symbol string, direction string, places array<int>, fires bigint, score double")


def bars_of(combos: DataFrame) -> DataFrame:
    """A row for each bar on which a combination (symbol, direction, name, bits) fires."""
    words = combos.select("symbol", "direction", "name", F.posexplode("bits").alias("word", "w")).filter("w <> 0")
    bits = words.select("symbol", "direction", "name", "word", "w", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).filter("(shiftrightunsigned(w, bit) & 1) = 1")
    return bits.select("symbol", F.col("direction").alias("side"), "name", (F.col("word") * 64 + F.col("bit")).cast("bigint").alias("bar"), F.when(F.col("direction") == "Long", 1).otherwise(-1).alias("direction"))


def _outcomes_of(out: DataFrame) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each symbol and direction: bars that open a trade, their exit bars and gains. For tables of at most BROADCAST bytes."""
    rows: dict = {}
    for r in out.select("symbol", "direction", "bar", "exit_bar", "g").collect():
        rows.setdefault((r.symbol, "Long" if r.direction > 0 else "Short"), []).append((r.bar, r.exit_bar, r.g))
    return {k: tuple(np.array(c) for c in zip(*sorted(v), strict=True)) for k, v in rows.items()}


RESULT = ["symbol", "direction", "combo", "conditions", "size", "fires", "trades", "win_rate", "final_equity", "total_pnl", "return_pct", "ranks"]


def _results(accounts: DataFrame, s: Search) -> DataFrame:
    """accounts: symbol, direction, conditions, ranks, fires, account. Of combinations with at least min_fires trades (trades, not fires)."""
    stats = trades.statistics(accounts, ["symbol", "direction", "conditions", "ranks", "fires"], s.bracket).filter(F.col("trades") >= s.min_fires)
    return stats.withColumns({"combo": F.array_join("conditions", " AND "), "size": F.size("conditions"), "win_rate": F.col("win_rate_pct")}).select(*RESULT)


def evaluated(combos: DataFrame, out: DataFrame, s: Search = Search()) -> DataFrame:
    """Trade statistics of combinations with bitmaps, by joins: for tables of any size."""
    named = combos.withColumn("name", F.concat_ws(",", F.col("ranks").cast("array<string>")))
    keys = ["symbol", "side", "name"]
    accounts = trades.chained(bars_of(named), out, keys, s.bracket)
    return _results(accounts.withColumnRenamed("side", "direction").join(named.select("symbol", "direction", "name", "conditions", "ranks", "fires"), ["symbol", "direction", "name"]), s)


def _evaluated(combos: DataFrame, pools, outs, s: Search) -> DataFrame:
    """The same for combinations given by the places of their members, with pool and outcomes at hand."""
    capital = float(s.bracket.initial_capital)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for symbol, direction, places, n in zip(part["symbol"], part["direction"], part["places"], part["fires"], strict=True):
                names, ranks, _, bits = pools.value[symbol, direction]
                own = np.bitwise_and.reduce(bits[places], axis=0)
                fired = np.flatnonzero(np.unpackbits(own.view(np.uint8), bitorder="little"))
                bars, exits, gains = outs.value.get((symbol, direction), (np.zeros(0, np.int64),) * 3)
                at = np.searchsorted(bars, fired)
                at = at[at < len(bars)]
                at = at[bars[at] == fired[: len(at)]]
                account = trades.Account(capital)
                account.run(bars[at], exits[at], gains[at])
                rows.append((symbol, direction, [names[k] for k in places], [ranks[k] for k in places], n, *account.row()))
            yield pd.DataFrame(rows, columns=["symbol", "direction", "conditions", "ranks", "fires", *(x.split()[0] for x in trades.ACCOUNT.split(", "))])

    made = combos.select("symbol", "direction", "places", "fires").mapInPandas(run, f"symbol string, direction string, conditions array<string>, ranks array<int>, fires bigint, {trades.ACCOUNT}")
    return _results(made.select("symbol", "direction", "conditions", "ranks", "fires", F.struct(*(x.split()[0] for x in trades.ACCOUNT.split(", "))).alias("account")), s)


def search(df: DataFrame, columns: list[str], signals: list[str], s: Search = Search()) -> tuple[DataFrame, list[dict]]:
    """Results of all levels (stored), and for each level what happened (candidates, survivors, why it was trimmed or the search ended).

    Levels are written to the shared folder. Where the pool's bitmaps and the outcomes fit BROADCAST bytes, tasks hold them and a level's rows are only places
    of members; beyond that, bitmaps move through joins. Both ways give the same rows.
    """
    spark = df.sparkSession
    out = stored(trades.outcomes(df, s.bracket).select("symbol", "bar", "direction", "exit_bar", "g"))
    base = stored(pool(conditions(df, columns, signals, s), s))
    at_hand = small(base) and out.count() * 32 <= BROADCAST
    single = base.select("symbol", "direction", F.array("cond").alias("conditions"), F.array("rank").alias("ranks"), "fires", "bits", F.lit(0.0).alias("score"))
    results = stored(evaluated(single, out, s))
    scores = results.select("symbol", "direction", F.col("ranks")[0].alias("rank"), F.col("total_pnl").alias("score"))
    base = stored(base.join(scores, ["symbol", "direction", "rank"], "left").fillna({"score": 0.0}))
    pools = spark.sparkContext.broadcast(_pools(base)) if at_hand else None
    outs = spark.sparkContext.broadcast(_outcomes_of(out)) if at_hand else None
    w = Window.partitionBy("symbol", "direction")
    if at_hand:
        place = F.row_number().over(w.orderBy("rank", "cond")) - 1
        front = base.select("symbol", "direction", F.array(place).alias("places"), F.col("rank").alias("last"), "fires", "score")
    else:
        front = base.select("symbol", "direction", F.array("cond").alias("conditions"), F.array("rank").alias("ranks"), "fires", "bits", "score")
    sides = {r.direction: r["count"] for r in base.groupBy("direction").count().collect()}
    levels, found = [{"size": 1, "survivors": sum(sides.values()), "long": sides.get("Long", 0), "short": sides.get("Short", 0)}], [results] if s.min_combo_size <= 1 else []
    # Sums over pairs (last rank, later ranks), not over candidates.
    later = stored(base.select("symbol", "direction", F.col("rank").alias("last"), (F.count("*").over(w.orderBy(F.desc("rank")).rangeBetween(Window.unboundedPreceding, -1))).alias("later")).distinct())
    fronts, began = [], monotonic()
    for size in range(2, s.max_combo_size + 1):
        last = F.col("last") if at_hand else F.element_at("ranks", -1)
        raw = stored(front.groupBy("symbol", "direction", last.alias("last")).agg(F.count("*").alias("n")).join(later, ["symbol", "direction", "last"]).groupBy("symbol", "direction").agg(F.sum(F.col("n") * F.col("later")).alias("n")))
        level = {"size": size, "raw_candidates": raw.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]}
        if s.max_search_seconds is not None and monotonic() - began > s.max_search_seconds:
            levels.append(level | {"ended": "time"})
            break
        allowed = front.join(F.broadcast(raw.filter(F.col("n") <= s.max_raw_candidates_per_level).select("symbol", "direction")), ["symbol", "direction"], "left_semi")
        if at_hand:
            new = stored(_next_level(allowed.repartition(spark.sparkContext.defaultParallelism), pools, s))
            cleared = new.filter("places is null").agg(F.coalesce(F.sum("fires"), F.lit(0))).first()[0]
            ranked = new.filter("places is not null").withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "places")))
            ranks = base.select("symbol", "direction", (F.row_number().over(w.orderBy("rank", "cond")) - 1).alias("p"), F.col("rank").alias("last"))
            kept = ranked.filter(F.col("place") <= s.max_survivors_per_level).withColumn("p", F.element_at("places", -1)).join(F.broadcast(ranks), ["symbol", "direction", "p"])
            front = stored(kept.select("symbol", "direction", "places", "last", "fires", "score"))
        else:
            new = stored(extended(allowed, base, s))
            cleared = new.count()
            front = stored(new.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "ranks"))).filter(F.col("place") <= s.max_survivors_per_level).drop("place"))
        survivors = front.count()
        levels.append(level | {"survivors": survivors, "trimmed": cleared - survivors})
        if not survivors:
            break
        if size >= s.min_combo_size:
            fronts.append(front)
    if fronts:
        every = fronts[0]
        for x in fronts[1:]:
            every = every.unionByName(x)
        found.append(_evaluated(every.repartition(spark.sparkContext.defaultParallelism), pools, outs, s) if at_hand else evaluated(every, out, s))
    all_ = found[0] if found else results.limit(0)
    for x in found[1:]:
        all_ = all_.unionByName(x)
    return stored(all_), levels


def top(results: DataFrame, n: int, by_direction: bool = False) -> DataFrame:
    """The n best profitable combinations (for each direction)."""
    good = results.filter("total_pnl > 0")
    if not by_direction:
        return good.orderBy(F.desc("total_pnl"), "symbol", "direction", "combo").limit(n)
    w = Window.partitionBy("direction").orderBy(F.desc("total_pnl"), "symbol", "combo")
    return good.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def best_per_size(results: DataFrame) -> DataFrame:
    w = Window.partitionBy("size").orderBy(F.desc("total_pnl"), "symbol", "direction", "combo")
    return results.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def top_win_rate(results: DataFrame, n: int = 5) -> DataFrame:
    return results.orderBy(F.desc("win_rate"), F.desc("total_pnl"), "symbol", "direction", "combo").limit(n)
