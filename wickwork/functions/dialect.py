"""Window macros from which features are written once and rendered for Spark SQL or for the DuckDB oracle.

A feature is a SQL expression over bars of one symbol; a stage is a set of features that only read earlier stages. Spark
merges all window frames of a stage over one sort by (symbol, bar), and stages after it need no new exchange.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

KEY = "PARTITION BY symbol ORDER BY bar"


class Dialect:
    """spark=False renders for DuckDB."""

    def __init__(self, spark: bool = True):
        self.spark = spark

    @staticmethod
    def frame(n: int) -> str:
        return f"({KEY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def roll(self, function: str, x: str, n: int) -> str:
        """function over the last n bars; null until all n have a value."""
        return f"CASE WHEN count({x}) OVER {self.frame(n)} = {n} THEN {function}({x}) OVER {self.frame(n)} END"

    def centred(self, function: str, x: str, left: int, right: int) -> str:
        f = f"({KEY} ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING)"
        return f"CASE WHEN count({x}) OVER {f} = {left + right + 1} THEN {function}({x}) OVER {f} END"

    @staticmethod
    def lag(x: str, k: int = 1) -> str:
        return f"lag({x}, {k}) OVER ({KEY})"

    @staticmethod
    def running(function: str, x: str) -> str:
        return f"{function}({x}) OVER ({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def forward_fill(self, x: str, last: str = "CURRENT ROW") -> str:
        f = f"({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND {last})"
        return f"last_value({x}) IGNORE NULLS OVER {f}" if self.spark else f"last_value({x} IGNORE NULLS) OVER {f}"

    def back_fill(self, x: str) -> str:
        """The first value from this bar on. Spark works a frame that ends at the last row out anew for each row, so there it is a running value in reverse."""
        if self.spark:
            return f"last_value({x}) IGNORE NULLS OVER ({KEY} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return f"first_value({x} IGNORE NULLS) OVER ({KEY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

    def median(self, x: str, n: int) -> str:
        f = self.frame(n)
        exact = f"percentile({x}, 0.5) OVER {f}" if self.spark else f"quantile_cont({x}, 0.5) OVER {f}"
        return f"CASE WHEN count({x}) OVER {f} = {n} THEN {exact} END"

    @staticmethod
    def ratio(a: str, b: str) -> str:
        """Division that gives null at zero."""
        return f"(({a}) / nullif({b}, 0))"

    @staticmethod
    def sign(up: str, down: str) -> str:
        """+1, -1 or 0; the first condition wins, a null condition hasn't fired."""
        return f"CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END"

    def day(self, ts: str) -> str:
        return f"to_date({ts})" if self.spark else f"CAST({ts} AS DATE)"


SPARK, DUCK = Dialect(True), Dialect(False)

Stage = dict[str, str]


def apply(df: DataFrame, stages: Iterable[Stage]) -> DataFrame:
    """df with the stages' columns; a stage may replace columns."""
    for stage in stages:
        low = {k.lower() for k in stage}
        df = df.selectExpr(*(f"`{c}`" for c in df.columns if c.lower() not in low), *(f"{e} AS {n}" for n, e in stage.items()))
    return df


def rendered(source: str, stages: Iterable[Stage], name: str) -> list[str]:
    """CTEs for the oracle, the last one called `name`; stages that replace columns aren't for it."""
    out, last, stages = [], source, list(stages)
    for k, stage in enumerate(stages):
        now = name if k == len(stages) - 1 else f"{name}_{k}"
        out.append(f"{now} AS (SELECT {last}.*, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {last})")
        last = now
    return out
