"""Tables written to the cluster's shared folder and read again: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_KEPT: dict[tuple, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of its own, deleted at exit, only where none is named and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    name = spark.conf.get("spark.app.id", "local")
    if name not in _OWN:
        _OWN[name] = tempfile.mkdtemp(prefix="wickwork-")
        atexit.register(shutil.rmtree, _OWN[name], ignore_errors=True)
    return _OWN[name]


def stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/wickwork-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def kept(spark: SparkSession, key: Hashable, build: Callable[[], object]) -> object:
    """What build() gives, made once for each session and key: for tables that several queries read."""
    name = (spark.conf.get("spark.app.id", "local"), key)
    if name not in _KEPT:
        _KEPT[name] = build()
    return _KEPT[name]


def forget() -> None:
    """Nothing that is kept is used again (the bench times each query from its sources)."""
    _KEPT.clear()
