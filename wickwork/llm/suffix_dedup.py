"""Exact removal of repeated substrings by a distributed merge sort of suffixes that is aware of common prefixes (operator 10).

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Sorting the suffixes of all bytes
isn't needed. Of each string of that length the leftmost 32-byte gram of least hash is its anchor, which only depends on
the string, so equal strings have equal anchors at equal places; there is an anchor for about 85 bytes. Then

1. anchors whose gram stands only once are dropped (counts of hashes);
2. each task sorts the suffixes of its anchors that are left (`length` bytes at most), for each hash range one run, and writes it
   front-coded: for each suffix how many bytes it shares with the one before it, and the rest. Equal contexts in a run are one entry;
3. each range merges its runs with a loser tree that holds, for each run, how many bytes its head shares with the last
   winner. Two heads that share differently many bytes are ordered by that number; only at equal numbers are bytes compared,
   from there on. So no known prefix is compared again, and the merged order comes with its common prefix lengths;
4. inside a gram's group these lengths tell how far two anchors agree to the right, and their left contexts how far to the left:
   where both together reach `length`, all between is repeated.

A gram's different contexts meet in one task (equal ones are one entry of each run): the rim of a passage that stands in
very many documents makes that group large. It costs time in proportion to the contexts there, not to their pairs, and
the common prefix lengths of the merged order serve there too.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tools import inverse_powers, prefix_sums, slices, span_hashes, stored, table, text_bytes, text_of

LENGTH, GRAM = 200, 32
#: Anchors that a hash range aims at.
RANGE_ANCHORS = 100_000


def anchors(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions in raw and gram hashes of the anchors of all windows of `length` bytes inside one text."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n, reach = len(raw), length - gram + 1
    if n < length:
        return none
    starts = np.arange(n - gram + 1)
    grams = span_hashes(prefix_sums(raw), starts, starts + gram, inverse_powers(n + 1))
    # Least gram of each window by its high half, then leftmost: minima from the left and from the right within blocks of `reach` grams.
    m = len(grams)
    whole = -(-m // reach) * reach
    padded = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = (grams >> np.uint64(32) << np.uint64(32)) | starts.astype(np.uint64)
    left = np.minimum.accumulate(padded.reshape(-1, reach), 1).ravel()
    right = np.ascontiguousarray(np.minimum.accumulate(padded.reshape(-1, reach)[:, ::-1], 1)[:, ::-1]).ravel()
    windows = np.arange(n - length + 1)
    least = np.minimum(right[windows], left[windows + reach - 1])
    owner = np.searchsorted(at, windows, side="right") - 1
    inside = windows + length <= at[owner + 1]
    least = least[inside]
    fresh = np.ones(len(least), bool)
    fresh[1:] = least[1:] != least[:-1]  # a window's anchor never lies before the last window's
    chosen = (least[fresh] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return chosen, grams[chosen]


def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """For each of sorted suffixes the bytes shared with the one before it, and the rest."""
    shared, rests, last = [], [], b""
    for x in suffixes:
        k = _common(last, x, 0)
        shared.append(k)
        rests.append(x[k:])
        last = x
    return shared, rests


def _common(a: bytes, b: bytes, start: int) -> int:
    """How many first bytes a and b share, known to be `start` at least."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, high = start, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class LoserTree:
    """Merges front-coded runs; gives (suffix, bytes shared with the one before, payload) in order.

    Each leaf has its run's current suffix and the number of bytes it shares with the last suffix that won. In a match, a
    greater number is the lesser suffix (both lie after the last winner); at equal numbers comparison starts there. The
    loser keeps the number of bytes it shares with the winner, which is what it needs when the winner moves on.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.heads: list[tuple[bytes, object] | None] = [None] * self.size
        self.shared = [0] * self.size
        for i in range(len(runs)):
            self._advance(i)
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _advance(self, i: int) -> None:
        """The next suffix of run i; its shared number is with the suffix before it in the run, which has just won."""
        nxt = next(self.runs[i], None)
        if nxt is None:
            self.heads[i], self.shared[i] = None, -1
            return
        shared, rest, payload = nxt
        before = self.heads[i][0] if self.heads[i] else b""
        self.heads[i], self.shared[i] = (before[:shared] + rest, payload), shared

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(self._build(2 * node), self._build(2 * node + 1), node)

    def _play(self, a: int, b: int, node: int) -> int:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            won, lost = (b, a) if x is None else (a, b)
        elif self.shared[a] != self.shared[b]:
            won, lost = (a, b) if self.shared[a] > self.shared[b] else (b, a)
        else:
            k = _common(x[0], y[0], self.shared[a])
            won, lost = (a, b) if x[0][k : k + 1] <= y[0][k : k + 1] else (b, a)
            self.shared[lost] = k
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple[bytes, int, object]]:
        while self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][0], self.shared[i], self.heads[i][1]
            self._advance(i)
            node, now = (i + self.size) // 2, i
            while node:
                now = self._play(now, self.losers[node], node)
                node //= 2
            self.winner = now


def _agree_left(a: bytes, b: bytes) -> int:
    """How many last bytes a and b share."""
    n = min(len(a), len(b))
    if not n or a[-n:] == b[-n:]:
        return n
    x = int.from_bytes(a[-n:], "little") ^ int.from_bytes(b[-n:], "little")
    return n - (x.bit_length() + 7) // 8


def resolve(group: list[tuple[bytes, int, bytes, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each of a gram's different contexts, sorted: (bytes to the left, bytes to the right) of repeated stretches around the anchor.

    group: right context from the anchor on, bytes shared with the one before, left context, number of occurrences.
    """
    n = len(group)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, (right, _, left, times) in enumerate(group):
        if times > 1:
            out[i].append((len(left), len(right)))
    if n * (n - 1) <= 2 * (length - GRAM):  # fewer pairs than places
        for i in range(n):
            reach = 1 << 30
            for j in range(i + 1, n):
                reach = min(reach, group[j][1])
                back = _agree_left(group[i][2], group[j][2])
                if back + reach >= length:
                    out[i].append((back, reach))
                    out[j].append((back, reach))
        return out
    # For each place of the anchor in the window: contexts whose known common prefix is long enough stand together, and of those the ones
    # whose left bytes are equal have the same window. No right context is compared again.
    shared = np.array([x[1] for x in group])
    long_right, long_left = np.array([len(x[0]) for x in group]), np.array([len(x[2]) for x in group])
    for o in range(length - GRAM + 1):
        run = np.cumsum(shared < length - o).tolist()
        seen: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero((long_left >= o) & (long_right >= length - o)).tolist():
            left = group[i][2]
            j = seen.setdefault((run[i], left[len(left) - o :]), i)
            if j != i:
                out[i].append((o, length - o))
                if not out[j] or out[j][-1] != (o, length - o):
                    out[j].append((o, length - o))
    return out


def _run_rows(items: dict[tuple[bytes, bytes], list[tuple[int, int]]], ranges: int) -> Iterator[dict]:
    """Front-coded runs, one for each hash range that the grams of items (right and left context: where) fall into."""
    by_range: dict[int, list] = {}
    for context in sorted(items):
        by_range.setdefault(zlib.crc32(context[0][:GRAM]) % ranges, []).append(context)
    pack = lambda x, kind="<i4": np.array(x, kind).tobytes()
    press = zstandard.ZstdCompressor(level=3).compress
    for number, entries in by_range.items():
        shared, rests = front_coded([x[0] for x in entries])
        where = [w for x in entries for w in items[x]]
        yield {
            "range": number, "shared": pack(shared), "sizes": pack([len(x) for x in rests]), "rests": press(b"".join(rests)),
            "lefts": press(b"".join(x[1] for x in entries)), "left_sizes": pack([len(x[1]) for x in entries]), "times": pack([len(items[x]) for x in entries], "<i8"),
            "docs": pack([w[0] for w in where], "<i8"), "places": pack([w[1] for w in where]),
        }


_RUN_SCHEMA = "range int, shared binary, sizes binary, rests binary, lefts binary, left_sizes binary, times binary, docs binary, places binary"


def _read_run(row) -> Iterator[tuple[int, bytes, object]]:
    shared, sizes, left_sizes, times = (np.frombuffer(row[c], k).tolist() for c, k in (("shared", "<i4"), ("sizes", "<i4"), ("left_sizes", "<i4"), ("times", "<i8")))
    docs, places = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["places"], "<i4")
    rests, lefts = zstandard.decompress(row["rests"]), zstandard.decompress(row["lefts"])
    at = left_at = owner_at = 0
    for k in range(len(shared)):
        yield shared[k], rests[at : at + sizes[k]], (lefts[left_at : left_at + left_sizes[k]], docs[owner_at : owner_at + times[k]], places[owner_at : owner_at + times[k]])
        at, left_at, owner_at = at + sizes[k], left_at + left_sizes[k], owner_at + times[k]


def _found(group: list[tuple], length: int) -> Iterator[tuple[int, int, int]]:
    """(doc, start, end) of repeated stretches from a gram's merged entries (right, shared, (left, docs, places)); equal contexts become one."""
    merged: list[list] = []
    where: list[list] = []
    known: dict[tuple[bytes, bytes], int] = {}
    for right, shared, (left, docs, places) in group:
        k = known.get((right, left))
        if k is None:
            k = known[right, left] = len(merged)
            # bytes shared with the kept entry before: equal contexts in between don't lower it below what `shared` says along the way
            merged.append([right, shared, left, 0])
            where.append([])
        merged[k][3] += len(docs)
        where[k].append((docs, places))
    # entries of equal right contexts stand together, so `shared` with the entry before is the same as with the kept one before
    for (right, left, spans), owners in zip(((m[0], m[2], s) for m, s in zip(merged, resolve([tuple(m) for m in merged], length), strict=True)), where, strict=True):
        if spans:
            for docs, places in owners:
                for doc, place in zip(docs.tolist(), places.tolist(), strict=True):
                    for back, forth in _united(spans):
                        yield doc, place - back, place + forth


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches around one anchor all hold it, so they unite to one."""
    return [(max(a for a, _ in spans), max(b for _, b in spans))]


def _union(spans: np.ndarray) -> np.ndarray:
    """Disjoint, maximal spans (touching ones united) from any."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > ends[:-1]
    first = np.flatnonzero(new)
    return np.column_stack([spans[first, 0], np.append(ends[first[1:] - 1], ends[-1])])


def _anchors_of(docs: DataFrame, length: int) -> DataFrame:
    """key, place, gram for each anchor of each text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for batch in slices(whole, "text"):
                raw, at = text_bytes(batch.column("text"))
                places, grams = anchors(raw, at, length)
                owner = np.searchsorted(at, places, side="right") - 1
                keys = batch.column("key").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(keys[owner]), pa.array((places - at[owner]).astype(np.int32)), pa.array(grams.view(np.int64))], names=["key", "place", "gram"])

    return docs.select("key", "text").mapInArrow(run, "key bigint, place int, gram bigint")


def _runs_of(docs: DataFrame, length: int, ranges: int) -> DataFrame:
    """Front-coded sorted runs from docs (key, text, places; other columns may stand there)."""
    names = ["range", "shared", "sizes", "rests", "lefts", "left_sizes", "times", "docs", "places"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, size = {}, 0
        for part in parts:
            for key, text, places in zip(part["key"].tolist(), part["text"], part["places"], strict=True):
                data = text.encode()
                for place in places.tolist():
                    context = data[place : place + length], data[max(0, place - length + GRAM) : place]
                    if context in items:
                        items[context].append((key, place))
                    else:
                        items[context] = [(key, place)]
                size += len(places)
                if size > 150_000:  # a run that fits in memory
                    yield pd.DataFrame(list(_run_rows(items, ranges)), columns=names)
                    items, size = {}, 0
        yield pd.DataFrame(list(_run_rows(items, ranges)), columns=names)

    return docs.mapInPandas(run, _RUN_SCHEMA)


def _merged(runs: DataFrame, length: int) -> DataFrame:
    """key, begin, stop of repeated stretches: each hash range's runs, one after another in sorted partitions, merged."""

    def merge(rows: list) -> pd.DataFrame:
        out, group, gram = [], [], None
        for right, shared, payload in LoserTree([_read_run(r) for r in rows]):
            if right[:GRAM] != gram:
                out += _found(group, length)
                group, gram = [], right[:GRAM]
            group.append((right, shared, payload))
        out += _found(group, length)
        return pd.DataFrame(out, columns=["key", "begin", "stop"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, rows = None, []
        for part in parts:
            for row in part.to_dict("records"):
                if row["range"] != number:
                    if rows:
                        yield merge(rows)
                    number, rows = row["range"], []
                rows.append(row)
        if rows:
            yield merge(rows)

    return runs.repartition("range").sortWithinPartitions("range").mapInPandas(run, "key bigint, begin int, stop int")


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, spans (array of begin, stop) of the bytes of each text (key, text, id) that a repeated string of `length` bytes covers, for keys that have some."""
    found = stored(_anchors_of(docs, length))
    # Written, so that the join reads plain exchanges on both sides and adaptive execution can split a frequent gram.
    grams = stored(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")).hint("merge")
    places = found.join(grams, "gram").groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("places"), F.count("*").alias("n_places"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(partitions, -(-found.count() // RANGE_ANCHORS))
    # repeated rows of one key count as so many texts
    # The id comes along unused: so this join reads the same exchange of texts as the last one.
    runs = _runs_of(docs.join(places, "key").select("key", "text", "id", "places"), length, ranges)
    return _merged(runs, length).groupBy("key").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes that stay) for each row of docs.

    Null texts are empty. Matches never cross texts. Repeated rows count as texts of their own, so each loses what it shares
    with the other. Texts under `length` bytes keep all; an empty table gives no rows; other columns are ignored.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    keyed = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("key", F.xxhash64(F.col("id").cast("string"), "text"))
    spans = repeated(keyed, length)

    @F.pandas_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, many in parts:
            rows = []
            for text, found in zip(texts, many, strict=True):
                data = text.encode()
                kept, removed, n = data, 0, 0
                if found is not None and len(found):
                    spans_ = _union(np.array([(x["begin"], x["stop"]) for x in found], np.int64))
                    n, removed = len(spans_), int((spans_[:, 1] - spans_[:, 0]).sum())
                    ends = [0, *spans_[:, 1].tolist()]
                    kept = b"".join(data[a:b] for a, b in zip(ends, [*spans_[:, 0].tolist(), len(data)], strict=True))
                rows.append((len(data), removed, n, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return keyed.join(spans, "key", "left").select(F.col("id").alias(id_col), cut("text", "spans").alias("s")).select(id_col, "s.*")


def query(spark, sf_dir):
    return cleaned(table(spark, sf_dir, "documents")).drop("kept")
