"""Near-duplicates by DartMinHash (operator 9).

A document is the set of its shingles of five words, each of weight 1 however often it stands: the likeness that is signed is the one
that is verified. Darts are thrown at a plane (they take any weights): each element owns a strip as wide as its weight, and for each unit of a strip's width the darts of a Poisson process
come in an order and at places that only depend on hashes of the element and the unit. A dart hits a document if its place lies
within the element's weight. Each dart belongs to one coordinate of the signature, and each coordinate keeps its
earliest hit, so two documents agree in a coordinate with the probability of their weighted Jaccard index. Only the
darts until a time by which all coordinates are very likely hit are thrown; where one isn't, the time is
doubled. The work is about the number of elements plus k log k.

Signatures are banded; candidates are verified exactly by the Jaccard index of the shingle sets and united (near_groups).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_groups import Kind, band_keys, bucketed, groups
from .tools import dropped, inverse_powers, mixed, prefix_sums, sifted, span_hashes, stored, table, text_bytes, text_of, word_spans

#: Words in a shingle, likeness, coordinates of a signature, coordinates in a band.
WORDS, LIKENESS, WIDTH, ROWS = 5, 0.8, 64, 4
_UNIT = np.uint64(0xA24BAED4963EE407)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts and the text that each belongs to, in order; a text of fewer words has one shingle, one without words none."""
    raw, at = text_bytes(pa.array([x.lower() for x in texts], pa.string()))
    starts, ends, owner = word_spans(raw, at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = span_hashes(prefix_sums(raw), starts, ends, inverse_powers(len(raw) + 1))
    n, count = len(word), np.bincount(owner, minlength=len(texts))
    out = np.zeros(n, np.uint64)
    for k in range(words):
        following = np.zeros(n, np.uint64)
        if k < n:
            following[: n - k] = np.where(owner[k:] == owner[: n - k], word[k:], np.uint64(0))
        out = mixed(out * np.uint64(3) + following + np.uint64(k))
    place = np.arange(n) - np.concatenate([[0], np.cumsum(count)])[owner]
    keep = place <= np.maximum(0, count[owner] - words)
    return out[keep], owner[keep]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    hashes, owner = shingles(texts)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    return [hashes[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def darts(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, width: int = WIDTH) -> np.ndarray:
    """n x width signatures (uint32) of weighted sets: one row for each element of each set."""
    total = np.bincount(owner, weights=weights, minlength=n)
    until = np.where(total > 0, width * (np.log(width) + 4) / np.maximum(total, 1e-300), 0)
    out, time = np.zeros((n, width), np.uint32), np.full((n, width), np.inf)
    open_ = total > 0
    while open_.any():
        mine = open_[owner]
        units = np.ceil(weights[mine]).astype(np.int64)
        element = np.repeat(np.flatnonzero(mine), units)
        unit = np.arange(len(element)) - np.repeat(np.cumsum(units) - units, units)
        key = mixed(hashes[element] + unit.astype(np.uint64) * _UNIT)
        now, set_ = np.zeros(len(element)), owner[element]
        rest = weights[element] - unit
        slots, times, ids, turn = [], [], [], 0
        while len(key):
            turn += 1
            draw = mixed(key + np.array([turn], np.uint64) * np.uint64(0x9FB21C651E98DF25))
            now = now - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
            alive = now <= until[set_]
            key, now, set_, rest, draw = key[alive], now[alive], set_[alive], rest[alive], draw[alive]
            second = mixed(draw ^ np.uint64(0x5851F42D4C957F2D))
            hit = ((second >> np.uint64(40)).astype(np.float64) * 2.0**-24) < rest
            slots.append(set_[hit] * width + (second[hit] & np.uint64(0xFFFFFF)).astype(np.int64) % width)
            times.append(now[hit])
            ids.append((mixed(draw[hit]) >> np.uint64(32)).astype(np.uint32))
        slot, when, name = map(np.concatenate, (slots, times, ids))
        order = np.argsort(-when, kind="stable")  # the earliest is written last
        time.ravel()[slot[order]] = when[order]
        out.ravel()[slot[order]] = name[order]
        open_ &= np.isinf(time).any(1)
        until = np.where(open_, until * 2, until)
    return out


def signatures(texts: list[str], width: int = WIDTH, rows: int = ROWS) -> list[tuple[np.ndarray | None, bytes]]:
    """For each text the keys of its bands, and the low bytes of its signature; None and nothing for a text without words."""
    out: list[tuple[np.ndarray | None, bytes]] = []
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= 500_000):
            size += len(texts[stop])
            stop += 1
        n = stop - start
        hashes, owner = shingles(texts[start:stop])
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        made = darts(hashes[at], np.ones(len(at)), owner[at], n, width)
        keys, low = band_keys(made, rows), made.astype(np.uint8)
        has = np.bincount(owner, minlength=n) > 0
        out += [(keys[k], low[k].tobytes()) if has[k] else (None, b"") for k in range(n)]
        start = stop
    return out


KIND = Kind(shingle_sets, WIDTH, LIKENESS)


def _classed(docs: DataFrame, id_col: str, text_col: str, **blocks) -> DataFrame:
    """id, content (hash of the text), n_words, class_id, kept, for each row."""

    @F.pandas_udf("keys array<bigint>, signature binary, n_words bigint")
    def sign(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = texts.tolist()
            made = signatures(rows)
            yield pd.DataFrame({"keys": [k for k, _ in made], "signature": [x for _, x in made], "n_words": [len(x.split()) for x in rows]})

    keyed = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).withColumn("content", F.md5(F.col("text").cast("binary")))
    rows = stored(keyed.select("id", "content", F.monotonically_increasing_id().alias("row"), sign("text").alias("s")).select("id", "content", "row", "s.*"))
    place = F.struct(F.col("id").isNull().alias("lacks"), "id", "row")  # rows without an id come last
    copies = stored(rows.groupBy("content").agg(F.min(place).alias("first"), F.max(F.struct("signature", "keys")).alias("s")).select(F.monotonically_increasing_id().alias("node"), "content", "first", "s.*"))
    shared = stored(bucketed(copies.filter("keys is not null").select(F.col("node").alias("id"), "keys")))
    wanted = stored(copies.join(shared.select(F.col("id").alias("node")).distinct().hint("shuffle_hash"), "node", "left_semi").select("node", F.col("content").alias("__content"), F.col("first.id").alias("__id"), "signature"))
    # Of equal texts only the first one's row is read; rows without an id have no other name than their text.
    at = sifted(keyed, wanted.select(F.col("__id").alias("id"), F.col("__content").alias("content")), "id", "content").join(wanted.hint("shuffle_hash"), (F.col("content") == F.col("__content")) & F.col("id").eqNullSafe(F.col("__id")))
    items = stored(at.select(F.col("node").alias("id"), "text", "signature").dropDuplicates(["id"]))
    found = groups(shared, items, KIND, **blocks)
    for x in (shared, wanted, items):
        dropped(x)
    united = copies.select("node", "first").join(found.withColumnRenamed("id", "node"), "node")
    least = united.groupBy("root").agg(F.min("first").alias("best"))
    named = copies.select("node", "content", "first").join(united.select("node", "root").join(least, "root").select("node", "best"), "node", "left").select("content", F.coalesce("best", "first").alias("best"))
    named = stored(named)
    out = rows.join(named, "content").select("id", "content", "n_words", F.col("best.id").alias("class_id"), (F.col("row") == F.col("best.row")).alias("kept"))
    for x in (copies, found):
        dropped(x)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **blocks) -> DataFrame:
    """id, class_id (the least id of its class), n_words, kept (true for one row of each class, of least id) for each row of docs.

    Equal texts are one class whatever they hold; beyond that, texts whose sets of lower-case word shingles have a Jaccard
    index of at least LIKENESS are, and what such links connect. Null texts are empty; all empty texts are one class, as are texts of the
    same blanks. Texts, not ids, are compared: different texts of one id may be of different classes, and rows that repeat an id and
    a text have a row each, one of which is kept at most. Rows without an id are compared too; a class of such rows alone has
    a null class_id and keeps one. An empty table gives no rows; other columns are ignored, texts are read whole.
    """
    return _classed(docs, id_col, text_col, **blocks).select(F.col("id").alias(id_col), "class_id", "n_words", "kept")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **blocks) -> DataFrame:
    """The rows of docs that stay, with docs' columns: one row of each class, also where ids are null, repeat or have several texts.

    Only rows that may go are moved: the rest passes a filter of bounded size.
    """
    found = stored(_classed(docs, id_col, text_col, **blocks))
    # An id with a text stays if one of its rows does; of its repeated rows one is left.
    gone = stored(found.groupBy("id", "content").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"))
    names = {"id": "__id", "content": "__content"}
    marked = docs.withColumns({"__id": F.col(id_col).cast("bigint"), "__content": F.md5(text_of(text_col).cast("binary"))})
    keys = gone.select(*(F.col(a).alias(b) for a, b in names.items()))
    same = lambda a, b: a["__id"].eqNullSafe(b["__id"]) & (a["__content"] == b["__content"])
    near = sifted(marked, keys, *names.values())
    out = sifted(marked, keys, *names.values(), rest=True).unionByName(near.join(keys.hint("shuffle_hash"), same(near, keys), "left_anti"))
    repeated = gone.filter("kept")
    if not repeated.isEmpty():
        again = repeated.select(*(F.col(a).alias(b) for a, b in names.items()))
        out = out.unionByName(near.join(again.hint("shuffle_hash"), same(near, again), "left_semi").dropDuplicates(list(names.values())))
    return out.select(*docs.columns)


def query(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"))
