"""Fuzzy line dedup by MinHash (operator 7).

Lines with a word (a letter or a digit) are alike if the sets of their shingles of 4 characters have a Jaccard index of 0.8 or more.
They meet by MinHash signatures (one for each distinct line of a task) and banding (near_groups): signatures are over longer shingles, of
8 characters, as these keep unlike lines apart much better: of prose in one language two lines of 400 characters share a tenth
of their 4-character shingles, but one in 300 of the longer ones. An isolated edit breaks twice as many longer shingles as
short ones, so alike lines keep an index of 0.59 or more of the longer ones, which BANDS bands of ROWS coordinates find with a
probability over 0.997 (of that, the votes that tell chance meetings apart take 0.001). Lines with few different shingles, where that doesn't hold, are signed by the short ones; lines near the
border by both, so that two alike lines always have a sort in common. Then exact Jaccard verification and distributed
union-find. Of each component, and of equal lines, the first line by document and place stays; the others go from their texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_groups import AGREED, RANGE_ENTRIES, RUNS, VOTES, Kind, band_keys, groups, merged_runs, packed_runs, votes
from .tools import dropped, sifted, stored, table

#: Characters in a shingle that likeness counts, likeness, and coordinates of the signature that screens candidates.
SHINGLE, LIKENESS, WIDTH = 4, 0.8, 64
#: Characters in a shingle that bands are made of, bands, coordinates in a band; different shingles below which short ones are signed.
LONG, BANDS, ROWS, FEW = 8, 28, 3, 40
#: Rounds in which each hash gives one coordinate of a signature a value.
ROUNDS = 4
#: Lines of a task that are known to be signed already, and lines in a run.
SEEN, RUN_LINES = 200_000, 50_000
_WORD = re.compile(r"[^\W_]")
#: Multipliers of shingle hashes, by the length of what is joined.
_STEPS = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xC2B2AE3D27D4EB4F), 4: np.uint64(0xD6E8FEB86659FD93)}
#: The same as _WORD for Spark.
HAS_WORD = r"[\p{L}\p{N}]"
_RNG = np.random.default_rng(20)
_FACTORS, _PLACES, _VALUES = ((_RNG.integers(0, 2**31, n, dtype=np.uint64) * 2 + 1).astype(np.uint32) for n in (max(WIDTH, BANDS * ROWS), ROUNDS, ROUNDS))
#: A coordinate without a value.
_NONE = np.uint32(0xFFFFFFFF)


def shingles(lines: list[str], size: int = SHINGLE, mix: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of all lines (size: a power of two), and where each line's start (one entry more); a shorter line has itself as its one shingle.

    mix: 32 bits each, evenly spread, for signatures; else 64 bits each, which only tell whether shingles are equal.
    """
    text = "".join([x or "\0" for x in lines])
    h = np.frombuffer((text + "\0" * (size - 1)).encode("utf-32-le"), np.uint32)
    h = h if mix else h.astype(np.uint64)
    long = np.array([len(x) for x in lines], np.int64)
    ends = np.cumsum(np.maximum(1, long))
    first = np.concatenate([[0], np.cumsum(np.maximum(1, long - size + 1))])
    step = 1
    while step < size:  # from hashes of strings of `step` to those of twice as many
        following = h[step:]
        h = h[:-step] * _STEPS[step].astype(h.dtype)
        h += following
        step *= 2
    inside = np.ones(len(text), bool)
    for k in range(1, size):  # what starts so near a line's end goes beyond it; a line's first place stays
        inside[(ends - k)[long > k]] = False
    short = np.flatnonzero(long < size).tolist()
    inside[(ends - np.maximum(1, long))[short]] = True
    out = h[inside]
    if mix:
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            out ^= out >> np.uint32(shift)
            out *= np.uint32(factor)
        out ^= out >> np.uint32(16)
    for k in short:
        out[first[k]] = xxhash.xxh64_intdigest(lines[k].encode(), size) >> (32 if mix else 0)
    return out, first


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    hashes, first = shingles(lines, mix=False)
    return [hashes[a:b] for a, b in zip(first.tolist(), first.tolist()[1:], strict=False)]


def _parts(lines: list[str], most: int = 60_000) -> Iterator[tuple[int, int]]:
    """Bounds of parts of about `most` characters, or one line."""
    start = 0
    while start < len(lines):
        stop, size = start, 0
        while stop < len(lines) and (stop == start or size + len(lines[stop]) <= most):
            size += len(lines[stop])
            stop += 1
        yield start, stop
        start = stop


def minima(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """MinHash signatures, sets x width of uint32, of the upper 32 bits of hashes, in a few steps for each hash instead of `width`.

    In each of ROUNDS rounds a hash gives one coordinate a value. A coordinate takes the least value of the first round that gives it any;
    where none does, the least hash under multiplication by the coordinate's own odd factor. So a coordinate takes the first of
    all hashes in an order of its own, and those of two sets agree with a probability of their Jaccard index, as with plain MinHash.
    """
    small, count = (hashes >> hashes.dtype.type(8 * hashes.itemsize - 32)).astype(np.uint32), np.diff(first)
    out = np.full(len(count) * width, _NONE, np.uint32)
    table, which = out.reshape(len(count), width), np.arange(len(count))
    left, base = small, np.repeat(which * width, count)
    for k in range(ROUNDS):
        at = left * _PLACES[k]
        at >>= np.uint32(16)
        at *= np.uint32(width)
        at >>= np.uint32(16)
        given = np.full_like(out, _NONE) if k else out
        np.minimum.at(given, base + at, left * _VALUES[k])
        if k:
            np.copyto(out, given, where=out == _NONE)
        lacking = (table[which] == _NONE).any(1)
        keep = np.repeat(lacking, count[which])
        left, base, which = left[keep], base[keep], which[lacking]
        if not len(which):
            break
    for low in range(0, len(which), 2000):  # sets that still lack coordinates
        rows, columns = np.nonzero(table[which[low : low + 2000]] == _NONE)
        rows = which[low + rows]
        starts = np.cumsum(count[rows]) - count[rows]
        at = np.repeat(first[rows] - starts, count[rows])
        at += np.arange(len(at))
        table[rows, columns] = np.minimum.reduceat(small[at] * np.repeat(_FACTORS[columns], count[rows]), starts)
    return table ^ (table >> np.uint32(15))


def signatures(lines: list[str]) -> np.ndarray:
    """lines x WIDTH of uint8, over the short shingles: what screening compares."""
    out = np.zeros((len(lines), WIDTH), np.uint8)
    for a, b in _parts(lines):
        out[a:b] = minima(*shingles(lines[a:b]), WIDTH).astype(np.uint8)
    return out


def _among(lines: list[str], most: int) -> np.ndarray:
    """How many different short shingles there are among the first `most` of each line."""
    hashes, first = shingles([x[: most + SHINGLE - 1] for x in lines], mix=False)
    inside = first[:-1, None] + np.arange(most)
    head = np.sort(np.where(inside < first[1:, None], hashes[np.minimum(inside, len(hashes) - 1)], hashes[first[:-1]][:, None]), axis=1)
    return 1 + (head[:, 1:] != head[:, :-1]).sum(1)


def different(lines: list[str]) -> np.ndarray:
    """How many different short shingles each line has; lines with FEW or more among their first ones aren't counted further."""
    count = _among(lines, FEW + FEW // 4)
    for k in np.flatnonzero(count < FEW).tolist():
        if len(lines[k]) > FEW + FEW // 4:
            count[k] = len(np.unique(shingles([lines[k][: 4 * FEW]], mix=False)[0]))
            if count[k] < FEW and len(lines[k]) > 4 * FEW:
                count[k] = len(np.unique(shingles([lines[k]], mix=False)[0]))
    return count


def line_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys (int64, rows x BANDS), their votes (uint8), and the line that each row belongs to: each line has one or two rows."""
    keys, cast, owner = [np.zeros((0, BANDS), np.int64)], [np.zeros((0, BANDS), np.uint8)], [np.zeros(0, np.int64)]
    for a, b in _parts(lines):
        part = lines[a:b]
        count = different(part)
        for kind, picked in ((0, np.flatnonzero(count >= LIKENESS * FEW)), (1, np.flatnonzero(count < FEW))):
            if len(picked):
                made = minima(*shingles([part[k] for k in picked.tolist()], SHINGLE if kind else LONG), BANDS * ROWS)
                keys.append(band_keys(made, ROWS, kind))
                cast.append(votes(made, ROWS))
                owner.append(a + picked)
    return np.concatenate(keys), np.concatenate(cast), np.concatenate(owner)


def meet(a: str, b: str) -> bool:
    """Whether two lines share a band's key with votes that agree."""
    keys, cast, owner = line_keys([a, b])
    return any((keys[i] == keys[j])[np.bitwise_count(cast[i] ^ cast[j]) <= VOTES - AGREED].any() for i in np.flatnonzero(owner == 0) for j in np.flatnonzero(owner == 1))


KIND = Kind(shingle_sets, WIDTH, LIKENESS)


def lines_of(docs: DataFrame) -> DataFrame:
    """id, c, line (from 0), h1, h2 (56 and 64 bits of hash) of each line with a word of docs (id, c, text)."""
    split = docs.select("id", "c", F.posexplode(F.split("text", "\n", -1)).alias("line", "x")).filter(F.substring("x", 1, 16).rlike(HAS_WORD) | F.col("x").rlike(HAS_WORD))  # few lines are looked through
    return split.select("id", "c", "line", F.xxhash64("x").bitwiseAND(F.lit(-256)).alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"))


def _runs_of(docs: DataFrame, ranges: int) -> DataFrame:
    """Packed runs of band keys of the lines of docs (text); an entry's id is h1 with votes in its low byte. A task signs a line that it meets again only once in a while."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        new: dict[int, str] = {}
        size = 0

        def made() -> pd.DataFrame:
            keys, cast, owner = line_keys(list(new.values()))
            ids = np.fromiter(new, np.uint64, len(new)).view(np.int64)
            return packed_runs(keys.ravel(), np.repeat(ids[owner], BANDS) | cast.ravel(), ranges)

        for part in parts:
            for text in part["text"]:
                for line in text.split("\n"):
                    if _WORD.search(line):
                        h = xxhash.xxh64_intdigest(line.encode(), 42) & ~255
                        if h not in seen and h not in new:
                            new[h] = line
                            size += len(line)
                    if len(new) >= RUN_LINES or size > 40_000_000:
                        yield made()
                        seen.update(new)
                        new, size = {}, 0
                        if len(seen) > SEEN:
                            seen.clear()
        yield made()

    return docs.select("text").mapInPandas(run, RUNS)


def _signed(rows: DataFrame) -> DataFrame:
    """rows (id, text) with signatures."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(signature=[x.tobytes() for x in signatures(part["text"].tolist())])

    return rows.mapInPandas(run, "id bigint, text string, signature binary")


def doomed(docs: DataFrame, **blocks) -> DataFrame:
    """id, c, lines (stored): for each text (id, c: hash of the text, text) the numbers of the lines that go, for texts that lose some."""
    rows = stored(lines_of(docs))
    # one row for each distinct line: where it first stands
    nodes = stored(rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "c", "line")).alias("first"), F.count("*").alias("n")))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = stored(merged_runs(_runs_of(docs, max(4 * partitions, nodes.count() * BANDS // RANGE_ENTRIES))))
    # Lines meet by h1 and are removed by both hashes. Of different lines of one h1 (one in a billion at a hundred million lines) the first is compared.
    wanted = stored(nodes.join(shared.select(F.col("id").alias("h1")).distinct().hint("shuffle_hash"), "h1", "left_semi").groupBy("h1").agg(F.min("first").alias("first")))
    places = wanted.select(F.col("first.id").alias("id"), F.col("first.c").alias("c"), F.col("first.line").alias("line"), F.col("h1").alias("node"))
    split = docs.select("id", "c", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))  # lines travel, not their texts as a whole
    own = places.select(F.col("id").alias("__id"), F.col("c").alias("__c"), F.col("line").alias("__line"), "node").hint("shuffle_hash")
    at = sifted(split, places, "id", "c", "line").join(own, F.col("id").eqNullSafe(F.col("__id")) & (F.col("c") == F.col("__c")) & (F.col("line") == F.col("__line")))
    items = stored(_signed(at.select(F.col("node").alias("id"), "text")))
    if items.count() != wanted.count():  # rows that repeat an id and a text
        items = stored(items.dropDuplicates(["id"]))
    found = groups(shared, items, KIND, **blocks)
    named = wanted.join(found.select(F.col("id").alias("h1"), "root").hint("shuffle_hash"), "h1").select("h1", F.col("first").alias("own"), "root")
    both = nodes.join(named.hint("shuffle_hash"), "h1", "left").withColumn("root", F.when(F.col("first") == F.col("own"), F.col("root")))
    classes = stored(both.filter("root is not null or n > 1").select("h1", "h2", "first", F.coalesce("root", "h1").alias("root"), F.col("root").isNull().alias("alone")))
    keepers = classes.groupBy("root", F.when(F.col("alone"), F.col("h2"))).agg(F.min("first").alias("keep")).select("keep.*")
    repeats = rows.join(classes.select("h1", "h2").hint("shuffle_hash"), ["h1", "h2"], "left_semi").select("id", "c", "line")
    kept = keepers.select(F.col("id").alias("__id"), F.col("c").alias("__c"), F.col("line").alias("__line"))
    gone = repeats.join(kept.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("c") == F.col("__c")) & (F.col("line") == F.col("__line")), "left_anti")
    out = stored(gone.groupBy("id", "c").agg(F.sort_array(F.collect_set("line")).alias("lines")))
    for x in (rows, nodes, shared, wanted, items, found, classes):
        dropped(x)
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **blocks) -> DataFrame:
    """docs with repeated lines taken out of the texts; the columns stay, the length column follows the text. And n_lines, n_removed as __n_lines, __n_removed.

    Null and empty texts stay as they are. Rows that repeat an id and its text count as one text, and all of them are cleaned alike;
    different texts of one id are texts of their own. Rows without an id come first. Lines without a letter or digit (blanks,
    brackets, rules) aren't compared. Ties can't arise: of alike lines the first by (id, hash of the text, place) stays. A
    text may end up empty; its row stays. An empty table gives no rows.
    """
    keyed = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).withColumn("c", F.xxhash64("text"))
    gone = doomed(keyed, **blocks).select(F.col("id").alias("__id"), F.col("c").alias("__c"), F.col("lines").alias("__gone"))
    marked = docs.withColumn("__hash", F.xxhash64(F.col(text_col)))
    out = marked.join(gone.hint("shuffle_hash"), F.col(id_col).cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__c")), "left").drop("__id", "__c", "__hash")
    out = out.withColumn("__all", F.split(text_col, "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), "__gone")  # by hashes: linear, however many lines go
    kept = F.array_join(F.transform(left, lambda i: F.get("__all", i)), "\n")
    out = out.withColumn("__n_lines", F.coalesce(F.size("__all"), F.lit(0))).withColumn("__n_removed", F.when(F.col(text_col).isNull(), 0).otherwise(F.coalesce(F.size("__gone"), F.lit(0))))
    out = out.withColumn(text_col, F.when(F.col("__n_removed") > 0, kept).otherwise(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col("__n_removed") > 0, F.length(text_col)).otherwise(F.col(length_col)).cast(dict(docs.dtypes)[length_col]))
    return out.drop("__all", "__gone")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = without_repeats(docs)
    return out.select("doc_id", F.col("__n_lines").cast("bigint").alias("n_lines"), F.col("__n_removed").cast("bigint").alias("n_removed"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars_kept"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
