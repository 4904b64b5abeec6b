"""What the operators share: cutting lineage, byte-level hashing, a registry of queries."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 2**64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text as the operators see it: null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of its own only where none is named (local tests)."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or (context._jsc.sc().getCheckpointDir().get() if context._jsc.sc().getCheckpointDir().isDefined() else None)
    if at:
        return at
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="wickwork-")
    return _OWN[context.applicationId]


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    gc.collect()
    spark._jvm.System.gc()  # shuffle files of earlier steps go once the driver has forgotten their plans
    at = f"{shared_folder(spark)}/wickwork-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    if at := getattr(df, "_stored_at", None):
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Words of 64 bits of a sieve: at most so many rows are broadcast, 16 bytes each, however many ids there are.
SIEVE_WORDS = 1 << 20


def sifted(df: DataFrame, ids: DataFrame, *columns: str, rest: bool = False) -> DataFrame:
    """Rows of df whose columns are among ids, and few others: a Bloom filter of bounded size, so that a join that follows doesn't move what it drops.

    With many more ids than bits it lets all rows pass; no row that is in ids is ever lost. rest: the other rows, none of which is in ids.
    """
    spot = lambda: F.xxhash64(*columns)
    word = lambda: F.shiftrightunsigned(spot(), 6).bitwiseAND(F.lit(SIEVE_WORDS - 1))
    bit = lambda: F.expr(f"shiftleft(1L, cast(xxhash64({', '.join(f'`{c}`' for c in columns)}) & 63 as int))")
    sieve = ids.select(word().alias("__word"), bit().alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = df.withColumns({"__at": word(), "__one": bit()})
    return marked.join(F.broadcast(sieve), (F.col("__at") == F.col("__word")) & (F.col("__bits").bitwiseAND(F.col("__one")) != 0), "left_anti" if rest else "left_semi").drop("__at", "__one")


#: Most rows that `attached` broadcasts (a key and a few numbers each), and salts of a key beyond.
MANY, SALTS = 10_000, 64


def attached(rows: DataFrame, small: DataFrame, key: str, many: int = MANY) -> DataFrame:
    """rows with what `small` has for their key (one row for each key), null where it has none: no key's rows meet in one task."""
    if small.count() <= many:
        return rows.join(F.broadcast(small), key, "left")
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")  # the same again when a task is repeated
    return rows.withColumn("__salt", spread).join(salted, [key, "__salt"], "left").drop("__salt")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column without nulls, one after another, and where each text starts (one entry more than texts)."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Cuts a batch so that each part holds about `most` bytes of text, or one text: bounds memory with very long texts."""
    position = batch.schema.get_field_index(column)
    _, at = text_bytes(batch.column(position))
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that the low and high bits of polynomial hashes are usable."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> np.ndarray:
    """MULTIPLIER ** 0 .. n - 1 modulo 2**64."""
    out = np.full(n, MULTIPLIER, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse_powers(n: int) -> np.ndarray:
    out = np.full(n, _INVERSE, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the sum of (raw[t] + 1) * MULTIPLIER**t for i <= t < j, modulo 2**64."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes hash alike wherever they stand."""
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each run of bytes other than space and \\t-\\r; runs end where a text ends."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = ~blank
    first = inside.copy()
    first[1:] &= blank[:-1]
    heads = at[:-1][(at[:-1] < at[1:])]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= blank[1:]
    tails = at[1:][(at[:-1] < at[1:])] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1
