"""Packing into optimal length buckets (operator 5).

Texts longer than a sequence are cut into segments, so lengths have a fixed range and their histogram is small
whatever the input. Over this global histogram dynamic programming finds the bucket boundaries with the least
padding. Inside a bucket, rows are numbered without bringing it together: rows get numbers within even hash cells
and cells get offsets from their counts, and each `budget // boundary` consecutive rows form a batch, so only the
last batch of a bucket is short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tools import stored, table

#: Longest sequence, number of buckets, tokens in a batch including padding.
SEQUENCE, BUCKETS, BUDGET = 2048, 8, 16384
#: Rows that a cell of a bucket aims at; cells are numbered in one task each.
CELL_ROWS, LEAST_CELLS = 50_000, 512


def best_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` length buckets with the least total padding; the last is the greatest length.

    Padding of lengths a < l <= b in one bucket is sum(count[l] * (b - l)). Only lengths that occur can be useful ends.
    Ties go to the smaller end. One row of the table for each number of buckets, over all ends at once.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.float64)
    n, before = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    size = len(lengths)
    # cost[i, j]: lengths i .. j - 1 in one bucket that ends at lengths[j - 1]
    ends = np.concatenate([[0], lengths])
    cost = ends[None, :] * (n[None, :] - n[:, None]) - (before[None, :] - before[:, None])
    cost[np.tril_indices(size + 1)] = np.inf
    best, choice = cost[0].copy(), []
    best[0] = 0
    for _ in range(1, min(buckets, size)):
        through = best[:, None] + cost
        from_ = np.argmin(through, axis=0)
        new = through[from_, np.arange(size + 1)]
        keep = best <= new
        choice.append(np.where(keep, -1, from_))
        best = np.where(keep, best, new)
    out, j = [], size
    for row in [*reversed(choice), np.zeros(size + 1, dtype=np.int64)]:
        if row[j] == -1:
            continue
        out.append(int(lengths[j - 1]))
        j = int(row[j])
        if j == 0:
            break
    return out[::-1]


def segments(docs: DataFrame, id_col: str, n_tokens, sequence: int) -> DataFrame:
    """id, segment, n_tokens: each text's tokens in runs of `sequence`, the rest last; a text without tokens has one empty segment."""
    n = F.coalesce(n_tokens, F.lit(0)).cast("bigint")
    whole = docs.select(id_col, n.alias("n"))
    return whole.select(id_col, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {sequence}")))).alias("segment")).select(
        id_col, "segment", F.least(F.lit(sequence).cast("bigint"), F.col("n") - F.col("segment") * sequence).alias("n_tokens"))


def pack(docs: DataFrame, id_col: str, n_tokens, sequence: int = SEQUENCE, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """id, segment, n_tokens, bucket (0 is the shortest), pad_to, batch (within the bucket), slot (within the batch).

    Every row of docs takes part, repeated ones each by itself. Null and empty texts have one segment of 0 tokens. An
    empty table gives no rows. A batch holds at most budget // pad_to segments, at least one.
    """
    if min(sequence, buckets, budget) < 1:
        raise ValueError("sequence, buckets and budget must be positive")
    rows = stored(segments(docs, id_col, n_tokens, sequence))
    histogram = {x.n_tokens: x.n for x in rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # sequence + 1 rows at most
    ends = best_boundaries(histogram, buckets)
    cells = max(LEAST_CELLS, -(-sum(histogram.values()) // CELL_ROWS))
    ends_col = F.array(*[F.lit(x).cast("bigint") for x in ends]) if ends else F.array().cast("array<bigint>")
    placed = rows.withColumn("bucket", F.size(F.filter(ends_col, lambda e: e < F.col("n_tokens")))).withColumn(
        "pad_to", F.try_element_at(ends_col, F.col("bucket") + 1)).withColumn("cell", F.pmod(F.xxhash64(id_col, "segment"), F.lit(cells)))
    counts = placed.groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "cell").orderBy(id_col, "segment")
    numbered = placed.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["bucket", "cell"])
    per_batch = F.greatest(F.lit(1).cast("bigint"), F.expr(f"{budget} div greatest(pad_to, 1)"))
    index = F.col("offset") + F.col("rank")
    return numbered.withColumn("per_batch", per_batch).withColumn("index", index).select(
        id_col, "segment", "n_tokens", "bucket", "pad_to", F.expr("index div per_batch").alias("batch"), F.expr("index % per_batch").alias("slot"))


def words(column: str = "text"):
    """Words of a text, as its token count; the count of any tokenizer can stand in its place."""
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), "doc_id", words())
