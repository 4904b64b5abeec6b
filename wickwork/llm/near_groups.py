"""From signatures to groups of near-duplicates: banding, exact verification, distributed union-find.

Items have a unique bigint id, band keys, a signature (the low byte of each coordinate) and a text. All steps
are joins and sums on even keys; no group of items, however large, meets in one task:

1. Banding. Items that share a band's key are a bucket; `bucketed` finds the buckets from exploded keys, `merged_runs` from packed
   runs of keys. Buckets with the same members (of several bands) count once.
2. Screening. Signatures of a bucket's members are compared. No pairs are emitted but the few that connect
   what is alike: all members are held against one of them; a small bucket's others are looked through in memory, those of
   a large one travel to blocks of the bucket. What signatures call alike is united into clusters (distributed union-find over edges).
3. Exact verification by Jaccard's index of the texts' shingles. A cluster is cut into blocks of bounded size. Inside a block
   each item is compared with those that its signature resembles, and no more with a component once it is in it. Then items outside a
   cluster's largest component travel to its other blocks, each once: any link between two components has such an end.
4. Union-find over the verified links gives the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .tools import attached, dropped, mixed, sifted, stored

#: Items and characters in a block; members of a bucket that are held against each other; members of each component that travel first.
BLOCK_ITEMS, BLOCK_CHARS, MEMBERS, SCOUTS = 500, 2_000_000, 1000, 8
#: Blocks that travellers meet at once (of no more characters than one block): copies of travellers and residents fall by as much.
TRAVEL = 4
#: Pairs of a group that are verified one by one at least, before a product of matrices may serve the rest; what a step of it costs, by the cost of one pair.
MANY_PAIRS, ENTRY = 500, 2e-6
#: Edges that are united in one task (16 bytes each); more go through distributed steps.
FEW_EDGES = 500_000
#: Bits that are kept with a band's key to tell chance meetings apart, and how many of them two alike items have in common at least.
VOTES, AGREED = 8, 5
#: Entries (of 12 bytes) that a range of band keys aims at.
RANGE_ENTRIES = 1_000_000


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _united(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    union, nodes = _Union(), set()
    for part in parts:
        for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
            nodes |= {a, b}
            union.join(a, b)
    ids = sorted(nodes)
    yield pd.DataFrame({"id": np.array(ids, np.int64), "root": np.array([union.root(x) for x in ids], np.int64)})


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """id, root (stored): for each node of edges (a, b: bigint) the least node of its component.

    Alternates large-star and small-star steps until nothing changes. At most `few` edges, by count, are united in one task instead, of bounded size.
    """
    now = stored(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= few:
        out = stored(now.coalesce(1).mapInPandas(_united, "id bigint, root bigint"))
        dropped(now)
        return out
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        new = stored(small)
        dropped(now)
        now = new
    out = stored(now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("id")).distinct().withColumn("root", F.col("id"))).distinct())
    dropped(now)
    return out


def band_keys(signatures: np.ndarray, rows: int, kind: int = 0) -> np.ndarray:
    """items x bands of int64, from items x width of uint32; keys of different kinds don't meet."""
    n, width = signatures.shape
    keys = np.zeros((n, width // rows), np.uint64)
    parts = signatures.astype(np.uint64).reshape(n, width // rows, rows)
    for k in range(rows):
        keys = mixed(keys * np.uint64(3) + parts[:, :, k] + np.uint64(k + 1))
    return mixed(keys + np.arange(width // rows, dtype=np.uint64)[None, :] + np.uint64(kind * 1000)).view(np.int64)


def bucketed(items: DataFrame) -> DataFrame:
    """key, id of the members of all buckets of more than one item, from items (id, keys: array of bigint)."""
    banded = items.select("id", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("key")
    return banded.join(shared.hint("shuffle_hash"), "key", "left_semi").distinct()


def votes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """items x bands of uint8: for each band one bit of each of the VOTES coordinates that follow it, by which two members of its bucket are told apart."""
    width = signatures.shape[1]
    bits = (signatures & np.uint32(1)).astype(np.uint8)[:, np.arange(width + rows + VOTES) % width]
    out = np.zeros((len(bits), width // rows), np.uint8)
    for k in range(rows, rows + VOTES):
        out <<= 1
        out |= bits[:, k : k + width : rows]
    return out


def packed_runs(keys: np.ndarray, ids: np.ndarray, ranges: int) -> pd.DataFrame:
    """A run for each range of keys: range, keys (4 bytes each), ids (8 bytes each; the low byte holds votes), of entries (key, id) as arrays of int64."""
    wide = keys.view(np.uint64)
    number = (wide >> np.uint64(32)) % np.uint64(ranges)
    order = np.argsort(number.astype(np.uint16 if ranges < 1 << 16 else np.uint64), kind="stable")
    number, low, ids = number[order].astype(np.int64), wide.astype(np.uint32)[order], ids[order]
    cuts = np.flatnonzero(np.diff(number)) + 1
    bounds = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)], strict=True)) if len(number) else []
    return pd.DataFrame({"range": [int(number[a]) for a, _ in bounds], "keys": [low[a:b].tobytes() for a, b in bounds], "ids": [ids[a:b].tobytes() for a, b in bounds]})


RUNS = "range int, keys binary, ids binary"


def merged_runs(runs: DataFrame) -> DataFrame:
    """key, id of the members of all buckets of more than one item, from packed runs; buckets with the same members have the same key.

    A key has 32 bits inside its range: the few buckets that so become one are told apart by screening. A bucket of two whose votes agree in fewer than
    AGREED places has met by chance and is left out. ids come without their votes.
    """

    def found(rows: list[tuple[bytes, bytes]]) -> pd.DataFrame:
        keys, ids = np.concatenate([np.frombuffer(k, np.uint32) for k, _ in rows]), np.concatenate([np.frombuffer(i, np.int64) for _, i in rows])
        both = np.sort((keys.astype(np.uint64) << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64))  # faster than to sort places by keys
        keys, order = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[1:] == keys[:-1]
        met = same[1:] | same[:-1]  # most keys have one entry
        keys, ids = keys[met], ids[order[met]]
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, cast, ids = keys[fresh], (ids[fresh] & 255).astype(np.uint8), ids[fresh] & ~255
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(keys)))
        if not len(keys):
            return pd.DataFrame({"key": keys.astype(np.int64), "id": ids})
        total = mixed(np.add.reduceat(mixed(ids.view(np.uint64)), starts) + sizes.astype(np.uint64)).view(np.int64)
        following = np.minimum(starts + 1, len(keys) - 1)
        chance = (sizes == 2) & (np.bitwise_count(cast[starts] ^ cast[following]) > VOTES - AGREED)
        many = np.repeat((sizes > 1) & ~chance, sizes)
        return pd.DataFrame({"key": np.repeat(total, sizes)[many], "id": ids[many]})

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, rows = None, []
        for part in parts:
            for now, k, i in zip(part["range"].tolist(), part["keys"], part["ids"], strict=True):
                if now != number:
                    if rows:
                        yield found(rows)
                    number, rows = now, []
                rows.append((k, i))
        if rows:
            yield found(rows)

    return runs.repartition("range").sortWithinPartitions("range").mapInPandas(merge, "key bigint, id bigint").distinct()


@F.pandas_udf(IntegerType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Equal coordinates of two signatures."""
    if not len(a):
        return pd.Series([], dtype="int32")
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    return pd.Series((x == np.frombuffer(b"".join(b), np.uint8).reshape(len(a), -1)).sum(1).astype(np.int32))


def _alike(ids: list[int], made: np.ndarray, travels: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs (id, id) that connect what agrees in `least` places; pairs of two residents don't count."""
    order = np.lexsort((ids, travels))
    ids, made, travels = [ids[k] for k in order], made[order], travels[order]
    known: dict[int, int] = {}  # a traveller may also be among the residents
    labels, out, first = [known.setdefault(x, i) for i, x in enumerate(ids)], [], int((~travels).sum())
    if len(ids) <= 32:  # all comparisons at once
        hits = [(i, j) for i, j in zip(*np.nonzero(np.tril((made[:, None] == made[None]).sum(2) >= least, -1)), strict=True) if i >= first]
        union = _Union()
        for i, j in hits:
            if union.root(labels[i]) != union.root(labels[j]):
                union.join(labels[i], labels[j])
                out.append((ids[i], ids[j]))
        return out
    labels = np.array(labels)
    for i in range(first, len(ids)):
        hits = np.flatnonzero((made[:i] == made[i]).sum(1) >= least)
        met, at = np.unique(labels[hits], return_index=True)
        for label, j in zip(met.tolist(), hits[at].tolist(), strict=True):
            if label != labels[i]:
                out.append((ids[i], ids[j]))
                labels[labels == label] = labels[i]
    return out


def _in_groups(rows: DataFrame, keys: list[str], columns: list[str], work: Callable[[pd.DataFrame, np.ndarray], list[tuple[int, int]]]) -> DataFrame:
    """a, b from work(rows of whole groups, where each group starts); groups come one after another in sorted partitions."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
            part = part.reset_index(drop=True)
            new = np.ones(len(part), bool)
            new[1:] = (part[keys].to_numpy()[1:] != part[keys].to_numpy()[:-1]).any(1)
            return part, np.flatnonzero(new)

        left: list[pd.DataFrame] = []  # of a group that may go on
        for part in parts:
            if not len(part):
                continue
            part, starts = made(part)
            if left and len(starts) == 1 and (left[0][keys].to_numpy()[0] == part[keys].to_numpy()[0]).all():
                left.append(part)
                continue
            now, starts = made(pd.concat([*left, part]))
            left = [now.iloc[starts[-1] :]]
            if len(starts) > 1:
                yield pd.DataFrame(work(now.iloc[: starts[-1]], starts[:-1]), columns=["a", "b"])
        if left:
            yield pd.DataFrame(work(*made(pd.concat(left))), columns=["a", "b"])

    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a bigint, b bigint")


def candidates(shared: DataFrame, signed: DataFrame, least: int, members: int = MEMBERS) -> DataFrame:
    """a, b (stored): pairs whose signatures agree in `least` places, enough of them to connect all such pairs of a bucket.

    shared: key, id (stored); signed: id, signature for each id there. In a bucket of more than `members`, all are held
    against one of them; what it doesn't resemble travels to blocks of the bucket and is held against all members there.
    """

    def screened(part: pd.DataFrame, starts: np.ndarray) -> list[tuple[int, int]]:
        sizes = np.diff(np.append(starts, len(part)))
        ids, travels = part["id"].to_numpy(), part["traveller"].to_numpy(bool)
        made = np.frombuffer(b"".join(part["signature"]), np.uint8).reshape(len(part), -1)
        head = np.repeat(starts, sizes)
        like = (made == made[head]).sum(1) >= least
        all_travel = np.minimum.reduceat(travels, starts) if len(starts) else travels[:0]
        whole = np.minimum.reduceat(like, starts) & all_travel if len(starts) else like[:0]  # all are like the first
        easy = np.repeat(whole, sizes) & (np.arange(len(part)) != head)
        out = list(zip(ids[easy].tolist(), ids[head[easy]].tolist(), strict=True))
        for a, n in zip(starts[~whole & (sizes > 2) | ~whole & ~all_travel].tolist(), sizes[~whole & (sizes > 2) | ~whole & ~all_travel].tolist(), strict=True):
            out += _alike(ids[a : a + n].tolist(), made[a : a + n], travels[a : a + n], least)
        return out

    large_ones = stored(shared.groupBy("key").agg(F.count("*").alias("n"), F.min(F.xxhash64("id", "key")).alias("pick")).filter(F.col("n") > members))
    full = stored(attached(shared, large_ones, "key").join(signed.hint("shuffle_hash"), "id").select("key", "id", "signature", "pick", "n"))
    columns, keys = ["id", "signature", "traveller"], ["key", "block", "party"]
    small = full.filter("n is null").withColumns({"block": F.lit(0), "party": F.lit(0), "traveller": F.lit(True)})
    out = _in_groups(small, keys, columns, screened)
    large = full.filter("n is not null")
    if large.isEmpty():
        pairs = stored(out.distinct())
        dropped(full)
        dropped(large_ones)
        return pairs
    heads = large.filter(F.xxhash64("id", "key") == F.col("pick")).groupBy("key").agg(F.min(F.struct("id", "signature")).alias("head"))
    star = stored(attached(large, heads, "key").filter("id <> head.id").withColumn("alike", agreement("signature", "head.signature") >= least).select("key", "id", "signature", "n", F.col("head.id").alias("b"), "alike"))
    left = star.filter("not alike")
    parties = stored(left.groupBy("key").agg(F.ceil(F.count("*") / members).cast("int").alias("parties")))
    blocks = F.ceil(F.col("n") / members).cast("int")
    going = attached(left, parties, "key").withColumn("party", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parties")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("traveller", F.lit(True))
    staying = attached(large, parties, "key").filter("parties is not null").withColumn("party", F.explode(F.sequence(F.lit(0), F.col("parties") - 1))).withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("traveller", F.lit(False))
    both = [*keys, *columns]
    out = out.unionByName(star.filter("alike").select(F.col("id").alias("a"), "b")).unionByName(_in_groups(going.select(*both).unionByName(staying.select(*both)), keys, columns, screened))
    pairs = stored(out.distinct())
    for x in (full, large_ones, star, parties):
        dropped(x)
    return pairs


@dataclass(frozen=True)
class Kind:
    """What makes items alike: shingle hashes (also repeated ones) of texts, as lists of arrays, and the least Jaccard index; width of the signatures that screen."""

    elements: Callable[[list[str]], list[np.ndarray]]
    width: int
    likeness: float

    @property
    def least(self) -> int:
        """Coordinates in which the signatures of a pair of that likeness nearly always agree: five standard deviations below the mean."""
        return int(self.width * self.likeness - 5 * np.sqrt(self.width * self.likeness * (1 - self.likeness)))


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    out = np.sort(hashes)
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def _similar(x: np.ndarray, y: np.ndarray, likeness: float) -> bool:
    """Whether two arrays of different values have that Jaccard index."""
    if min(len(x), len(y)) < likeness * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= likeness * (len(x) + len(y) - common)


def _links(ids: list, made: np.ndarray, sets: list, labels: list, travels: np.ndarray, kind: Kind, cross: bool) -> list[tuple[int, int]]:
    """Verified links that connect what is alike in a group; across components of `labels` only. cross: only pairs of a traveller and a resident count."""
    n, likeness, known, ready = len(ids), kind.likeness, {}, {}
    if n == 2 and not cross:  # most groups
        met = labels[0] != labels[1] and int((made[0] == made[1]).sum()) >= kind.least and _similar(_distinct(sets[0]), _distinct(sets[1]), likeness)
        return [(max(ids), min(ids))] if met else []

    def of(i: int) -> np.ndarray:
        if i not in ready:
            ready[i] = _distinct(sets[i])
        return ready[i]

    order = np.lexsort((ids, travels))
    made, travels = made[order], travels[order]
    part = np.array([known.setdefault(labels[k], i) for i, k in enumerate(order.tolist())])  # the component that each belongs to by now
    residents = int((~travels).sum())
    top = residents if cross else 1
    before = [residents if cross else i for i in range(top, n)]
    close = [np.flatnonzero(((made[:m] == made[i]).sum(1) >= kind.least) & (part[:m] != part[i])) for i, m in enumerate(before, top)]
    out, tried, due, start, alike = [], 0, MANY_PAIRS, top, None
    for i, js in enumerate(close, top):
        if alike is None and tried >= due:  # most pairs aren't alike, so that few go by what is known
            left = sum(int((part[x] != part[k]).sum()) for k, x in enumerate(close[i - top :], i))
            start, due, alike = i, 4 * tried, _alike_at_once(of, order, i, residents if cross else n, left, likeness)
        if alike is not None:
            js = js[alike[i - start, js]]
        for j in js[part[js] != part[i]].tolist():
            if part[i] == part[j]:
                continue
            if alike is None:
                tried += 1
                if not _similar(of(order[i]), of(order[j]), likeness):
                    continue
            part[part == part[i]] = part[j]
            out.append((ids[order[i]], ids[order[j]]))
    return out


def _alike_at_once(of: Callable[[int], np.ndarray], order: np.ndarray, start: int, width: int, pairs: int, likeness: float) -> np.ndarray | None:
    """Which pairs (start + row, column) have the likeness, by exact counts of common elements from a product of matrices; None where `pairs` one by one cost less."""
    rows = len(order) - start
    if ENTRY * rows * width * 100 > pairs:
        return None
    sets = [of(k) for k in order.tolist()]
    sizes = np.array([len(x) for x in sets], np.int64)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    used = np.bincount(code, minlength=len(values)) > 1  # others are common to no pair
    place = np.cumsum(used) - 1
    keep = used[code]
    code, owner, n = place[code[keep]], owner[keep], int(used.sum())
    if ENTRY * rows * width * n > pairs:
        return None
    by = np.argsort(code, kind="stable")
    code, owner = code[by], owner[by]
    common = np.zeros((rows, width), np.float32)  # whole numbers below 2 ** 24: exact
    for low in range(0, n, 2048):
        a, b = np.searchsorted(code, [low, low + 2048])
        has = np.zeros((len(sets), min(2048, n - low)), np.float32)
        has[owner[a:b], code[a:b] - low] = 1
        common += has[start:] @ has[:width].T
    return common >= likeness * (sizes[start:, None] + sizes[None, :width] - common.astype(np.float64))


def _verified(rows: DataFrame, keys: list[str], kind: Kind, cross: bool) -> DataFrame:
    def work(part: pd.DataFrame, starts: np.ndarray) -> list[tuple[int, int]]:
        ids, texts, labels, travels = part["id"].tolist(), part["text"].tolist(), part["label"].tolist(), part["traveller"].to_numpy(bool)
        made = np.frombuffer(b"".join(part["signature"]), np.uint8).reshape(len(part), -1)
        bounds, out, at = [(a, b) for a, b in zip(starts.tolist(), [*starts.tolist()[1:], len(part)], strict=True) if b - a > 1], [], 0
        while at < len(bounds):  # groups of about a hundred thousand characters at a time: arrays that fit a cache
            stop, size = at, 0
            while stop < len(bounds) and (stop == at or size < 100_000):
                size += sum(map(len, texts[slice(*bounds[stop])]))
                stop += 1
            sets, k = kind.elements([x for a, b in bounds[at:stop] for x in texts[a:b]]), 0
            for a, b in bounds[at:stop]:
                out += _links(ids[a:b], made[a:b], sets[k : k + b - a], labels[a:b], travels[a:b], kind, cross)
                k += b - a
            at = stop
        return out

    return _in_groups(rows, keys, ["id", "text", "signature", "label", "traveller"], work)


def groups(shared: DataFrame, items: DataFrame, kind: Kind, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS, members: int = MEMBERS) -> DataFrame:
    """id, root (stored) of all items that are alike to another one (root is the group's least id).

    shared: key, id of buckets (stored); items: id, text, signature of each id there (stored). What only this needs is deleted.
    """
    pairs = candidates(shared, items.select("id", "signature"), kind.least, members)
    clusters = components(pairs)
    dropped(pairs)
    member = stored(items.select("id", F.length("text").alias("chars")).join(clusters.withColumnRenamed("root", "cluster"), "id"))
    dropped(clusters)
    sizes = member.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    blocks = F.ceil(F.greatest(F.col("n") / block_items, F.col("chars") / block_chars, F.lit(1))).cast("int")
    meetings = F.ceil(F.greatest(F.col("n") / (TRAVEL * block_items), F.col("chars") / block_chars)).cast("int")
    wide_ones = stored(sizes.select("cluster", blocks.alias("blocks"), meetings.alias("meetings")).filter("blocks > 1"))
    where = attached(member, wide_ones, "cluster").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = stored(sifted(items.select("id", "text", "signature"), member, "id").join(where.select("id", "cluster", "blocks", "meetings", "block").hint("shuffle_hash"), "id").withColumn("label", F.col("id")).withColumn("traveller", F.lit(False)))
    links = stored(_verified(placed, ["cluster", "block"], kind, cross=False))
    if not wide_ones.isEmpty():
        wide = placed.filter("blocks > 1").drop("label")
        gone = None
        for scouts in (True, False):
            labels = components(links)
            named = stored(wide.join(labels.withColumnRenamed("root", "label"), "id", "left").withColumn("label", F.coalesce("label", "id")))
            counts = named.groupBy("cluster", "label").agg(F.count("*").alias("n"))
            first = stored(counts.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).select("cluster", F.col("top.label").alias("largest"), "labels").filter("labels > 1"))
            split = attached(named, first, "cluster").filter("labels is not null")
            if scouts:
                spot = Window.partitionBy("cluster", "block", "label").orderBy(F.xxhash64("id"))
                away = split.withColumn("spot", F.row_number().over(spot)).filter(F.col("spot") <= SCOUTS).drop("spot")
            else:
                away = split.filter("label <> largest").join(gone.select("id").hint("shuffle_hash"), "id", "left_anti")  # scouts have met all others
            away = stored(away)
            weights = stored(away.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).select("cluster", F.ceil(F.greatest(F.col("n") / (TRAVEL * block_items), F.col("chars") / block_chars)).cast("int").alias("parties")))
            going = attached(away, weights, "cluster").withColumn("party", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parties")).cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("meetings") - 1))).withColumn("traveller", F.lit(True))
            staying = attached(split, weights, "cluster").filter("parties is not null").withColumn("party", F.explode(F.sequence(F.lit(0), F.col("parties") - 1))).withColumn("at", F.floor(F.col("block") * F.col("meetings") / F.col("blocks")).cast("int"))
            columns = ["cluster", "at", "party", "id", "text", "signature", "label", "traveller"]
            new = stored(links.unionByName(_verified(going.select(*columns).unionByName(staying.select(*columns)), ["cluster", "at", "party"], kind, cross=True)))
            for x in (links, labels, named, first, weights, *([gone] if gone is not None else [])):
                dropped(x)
            links, gone = new, away
        dropped(gone)
    out = components(links)
    for x in (links, member, wide_ones, placed):
        dropped(x)
    return out
