"""Sharding by extendible hashing (operator 6), in DataFrame operations alone.

A key's hash gives 60 bits. The directory starts with one bucket; a bucket whose rows hold more bytes than
the limit splits on its next bit, and no other bucket does. As a bucket's total never grows when it splits,
a bucket's final depth is the least d at which the total over its d-bit prefix fits. So instead of splitting
bucket by bucket, sizes are summed once for prefixes of `step` bits (with partial sums before the shuffle),
rolled up to all shorter prefixes, and only prefixes that are still too large are looked at in the next `step`
bits. The directory has about one row for each shard and stays distributed; it meets the rows by an
equi-join on a hash prefix, which is even whatever the keys are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import stored

#: Bytes that a shard may hold unless told otherwise.
SHARD_BYTES = 1 << 20
#: Bits of the hash; a whole number of steps.
BITS, STEP = 60, 12


def hash60(*keys: Column) -> Column:
    """60 bits of the MD5 of the keys, as a non-negative bigint."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _prefix(h: Column, depth: int | Column) -> Column:
    """The first `depth` bits of h."""
    if isinstance(depth, int):
        return F.shiftright(h, BITS - depth)
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def directory(sized: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """For each level (a multiple of STEP) at which buckets settle: level, and (prefix of `level` bits, local_depth, shard_bytes, shard_rows).

    sized: columns h and n_bytes. One bucket settled at depth d has a row for each of the 2 ** (level - d) prefixes that lead to it,
    as in the directory of an extendible hash table.
    """
    out, level, open_prefixes = [], STEP, None
    while True:
        low, rows = level - STEP, sized
        if open_prefixes is not None:
            rows = rows.join(open_prefixes, _prefix(rows.h, low) == open_prefixes.parent, "left_semi")
        leaf = rows.groupBy(_prefix(F.col("h"), level).alias("leaf")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        totals = stored(
            leaf.select(F.explode(F.sequence(F.lit(low), F.lit(level))).alias("d"), "leaf", "b", "n")
            .groupBy("d", F.expr(f"shiftright(leaf, {level} - d)").alias("prefix")).agg(F.sum("b").alias("b"), F.sum("n").alias("n")))
        fits = (F.col("b") <= limit) | (F.col("d") == BITS)
        split = totals.filter(~fits).select((F.col("d") + 1).alias("d"), F.col("prefix").alias("above"))
        below = totals.filter(fits).withColumn("above", F.shiftright("prefix", 1)).join(split, ["d", "above"], "left_semi")
        settled = below.drop("above") if low else below.drop("above").unionByName(totals.filter(fits & (F.col("d") == 0)))
        width = F.expr(f"shiftleft(1L, {level} - d)")
        out.append((level, settled.withColumn("width", width).select(
            F.explode(F.sequence(F.col("prefix") * F.col("width"), (F.col("prefix") + 1) * F.col("width") - 1)).alias("prefix"),
            F.col("d").alias("local_depth"), F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"))))
        open_prefixes = totals.filter(~fits & (F.col("d") == level)).select(F.col("prefix").alias("parent"))
        if level == BITS or open_prefixes.isEmpty():
            return out
        level += STEP


def shard(docs: DataFrame, keys: list[str], n_bytes: Column, limit: int = SHARD_BYTES) -> DataFrame:
    """keys, n_bytes, shard (its hash-prefix bits as text, '' for the whole table), local_depth, shard_bytes, shard_rows, oversized.

    Every shard holds at most `limit` bytes, but for a shard whose rows all have one 60-bit hash, such as a single
    text over the limit or a key repeated in very many rows: it can't be split and is marked oversized. Null keys are a key
    like any other, null and empty texts have 0 bytes, repeated rows are all kept and land together, an empty table
    gives no rows, other columns are ignored.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    sized = docs.select(*keys, F.coalesce(n_bytes, F.lit(0)).cast("bigint").alias("n_bytes"), hash60(*map(F.col, keys)).alias("h"))
    parts = [sized.withColumn("prefix", _prefix(F.col("h"), level)).join(at, "prefix") for level, at in directory(sized.select("h", "n_bytes"), limit)]
    rows = reduce(DataFrame.unionByName, parts)
    bits = F.lpad(F.conv(F.col("h").cast("string"), 10, 2), BITS, "0")
    return rows.select(*keys, "n_bytes", F.substring(bits, F.lit(1), F.col("local_depth")).alias("shard"), "local_depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversized"))


def query(spark, sf_dir):
    from .tools import table

    docs = table(spark, sf_dir, "documents")
    return shard(docs, ["doc_id"], F.octet_length("text"))


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
depths AS (SELECT unnest(range(0, {BITS + 1}))::INTEGER AS d),
totals AS (
  SELECT d, h >> ({BITS} - d) AS prefix, sum(n_bytes)::BIGINT AS b, count(*)::BIGINT AS n
  FROM sized, depths GROUP BY ALL),
chosen AS (
  SELECT s.doc_id, min(t.d)::INTEGER AS local_depth
  FROM sized s JOIN totals t ON t.prefix = s.h >> ({BITS} - t.d)
  WHERE t.b <= {SHARD_BYTES} OR t.d = {BITS} GROUP BY ALL)
SELECT s.doc_id, s.n_bytes, left(right(s.h::BIT::VARCHAR, {BITS}), c.local_depth) AS shard, c.local_depth,
  t.b AS shard_bytes, t.n AS shard_rows, t.b > {SHARD_BYTES} AS oversized
FROM sized s JOIN chosen c USING (doc_id) JOIN totals t ON t.d = c.local_depth AND t.prefix = s.h >> ({BITS} - c.local_depth)
"""
