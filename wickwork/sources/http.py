"""Candles from an HTTP service, as a Spark data source: one partition for each chunk of time, fetched by the executors."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import candles


def answer(url: str, params: dict[str, str], retries: int = 3, timeout: float = 10, pause: float = 1) -> str | None:
    """The body of the first answer with status 200; None after `retries` failures, each followed by a pause."""
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers={"Accept": "application/json"})
    for _ in range(retries):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                if response.status == 200:
                    return response.read().decode()
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            pass
        time.sleep(pause)
    return None


@dataclass
class Chunk(InputPartition):
    number: int
    start: int
    end: int


class CandleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Chunk]:
        at, end = (datetime.fromisoformat(self.options[k]).replace(tzinfo=UTC) for k in ("start", "end"))
        out, step = [], timedelta(days=int(self.options.get("days", "30")))
        while at < end:
            out.append(Chunk(len(out), int(at.timestamp()), int(min(at + step, end).timestamp())))
            at += step
        return out

    def read(self, chunk: Chunk) -> Iterator[tuple]:
        o = self.options
        params = {"resolution": o["resolution"], "symbol": o["symbol"], "start": str(chunk.start), "end": str(chunk.end)}
        body = answer(o["url"], params, int(o.get("retries", "3")), float(o.get("timeout", "10")), float(o.get("pause", "1")))
        if body is not None:
            yield o["symbol"], chunk.number, body


class CandleSource(DataSource):
    """Options: url, symbol, resolution, start, end (ISO times, UTC); days (of a chunk), retries, timeout and pause (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "candle_http"

    def schema(self) -> str:
        return "symbol string, chunk int, payload string"

    def reader(self, schema) -> CandleReader:
        return CandleReader(dict(self.options))


def fetched(spark: SparkSession, zone: str = "Asia/Kolkata", **options: str) -> DataFrame:
    """Candles with bar numbers; of equal times the earliest chunk's stays. Failed and unsuccessful chunks give no rows."""
    spark.dataSource.register(CandleSource)
    rows = candles.from_json(spark.read.format("candle_http").options(**options).load(), zone=zone)
    return candles.numbered(candles.first_of_each(rows, ["symbol", "ts"], ["chunk"]).drop("chunk"))
