"""Quality rules by robust multivariate outliers (operator 3).

Each text becomes a vector of transformed statistics. For each language and source the minimum-covariance-determinant
estimate of centre and scatter is found by concentration: the three quarters of the group's rows that lie nearest by
Mahalanobis distance give the next centre and scatter, until the determinant falls no more. It is tried from several starts,
all at coordinatewise medians: scatter from median deviations alone, with the correlations of squashed (tanh) coordinates, and with those of
directions (spatial signs). Of each group's estimates the one of least determinant counts; a last,
reweighted step takes all rows within its 97.5 % ellipsoid. Rows beyond `cutoff` are rejected.

All steps are sums over all rows with partial sums before each shuffle: medians and the distance that three quarters stay
within come from counts in fine bins, so a group of any size is never brought together. What a group's rows then need
(its centre and inverse scatter) comes by a broadcast of at most `many` groups, or else by a join with salted groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tools import MANY, attached, dropped, stored, table, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
_NOT_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)
#: Names of the vector's coordinates, and the least standard deviation of each (most texts have no symbols at all).
COORDINATES = {"words": 0.35, "word_length": 0.08, "symbols": 0.35, "repeated_lines": 0.08, "repeated_words": 0.08, "capitals": 0.04}
P = len(COORDINATES)
#: Squared distance beyond which a text is rejected; share of rows that the estimates concentrate on; most concentration steps, and the fall of the
#: logarithm of the determinant below which they end.
CUTOFF, SHARE, STEPS, SETTLED = 30.0, 0.75, 15, 0.01
#: Starts of the concentration.
STARTS = ("deviations", "squashed", "directions")
#: Fewest rows of a language and source with estimates of their own, five for each coordinate: smaller groups of one language are pooled, and these again.
LEAST = 5 * P
#: Of a chi-squared variable with P = 6 degrees of freedom: its 75 % and 97.5 % points; E(x; x within 75 %) / (0.75 * 6).
CHI_75, CHI_975, WITHIN_75 = 7.841, 14.449, 0.674
#: Bins for each unit of a coordinate, and for each doubling of a distance.
FINE, DISTANCE_FINE = 128, 32


def repeated_words(words: list[str], window: int = 5) -> int:
    """Words in windows that stand twice or more in the text, each word once."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, n)
    if len(numbers) == n:
        return 0
    m = n - window + 1
    keys = np.zeros(m, np.uint64)
    for k in range(window):
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[k : k + m]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(m, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    first: dict[tuple, int] = {}
    covered = np.zeros(n + 1, np.int64)
    for i in np.flatnonzero(hit).tolist():  # equal keys are compared word by word
        j = first.setdefault(tuple(ids[i : i + window].tolist()), i)
        if j != i:
            for at in (i, j):
                covered[at] += 1
                covered[at + window] -= 1
    # j was marked once for each repetition; what counts is whether it was marked
    return int((np.cumsum(covered[:n]) > 0).sum())


def statistics(text: str) -> tuple:
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeats = repeated_words(words)
    duplicates = len(lines) - len(set(lines))
    capitals = len(text.encode().translate(None, _NOT_UPPER))
    vector = (np.log1p(n), np.log((chars + 1) / (n + 1)), np.log1p(20 * symbols / (n + 1)), duplicates / max(1, len(lines)), repeats / max(1, n), capitals / max(1, chars))
    return n, chars, symbols, duplicates, repeats, n < 10 or 100 * repeats > 20 * n, *map(float, vector)


def _measured(docs: DataFrame, id_col: str, text_col: str, keys: list[str]) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(f"v{i}" for i in range(P))]

    @F.pandas_udf(", ".join(f"{x} {'boolean' if x == 'base_failed' else 'double' if x[0] == 'v' else 'bigint'}" for x in names))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([statistics(x) for x in texts], columns=names)

    group = F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]))
    language = F.to_json(F.struct(F.col(keys[0]).cast("string").alias("k0")))
    return docs.select(F.col(id_col), group.alias("__group"), language.alias("__language"), run(text_of(text_col)).alias("__s")).select(id_col, "__group", "__language", "__s.*")


def pooled(rows: DataFrame, least: int = LEAST, many: int = MANY) -> DataFrame:
    """rows with the group whose estimates hold for them: their own, or the pool of their language's small groups, or of all small pools; null if that is small too."""
    counts = rows.groupBy("__group", "__language").agg(F.count("*").alias("n"))
    named = counts.withColumn("g1", F.when(F.col("n") >= least, F.col("__group")).otherwise(F.concat(F.lit("pool of "), "__language")))
    second = named.groupBy("g1").agg(F.sum("n").alias("n")).withColumn("g2", F.when(F.col("n") >= least, F.col("g1")).otherwise("pool of all"))
    third = second.groupBy("g2").agg(F.sum("n").alias("n")).withColumn("g", F.when(F.col("n") >= least, F.col("g2")))
    small = stored(named.drop("n").join(second.drop("n"), "g1").join(third, "g2").select("__group", "g"))
    return attached(rows, small, "__group", many)


def _middle(counts: DataFrame, keys: list[str], bin_: str, share: float, name: str) -> DataFrame:
    """For each key the least bin at or below which at least `share` of its rows lie."""
    w = Window.partitionBy(*keys).orderBy(bin_)
    total = Window.partitionBy(*keys)
    return counts.withColumn("__below", F.sum("n").over(w)).withColumn("__all", F.sum("n").over(total)).filter(F.col("__below") >= F.ceil(F.col("__all") * share)).groupBy(*keys).agg(F.min(bin_).alias(name))


def _start(rows: DataFrame) -> DataFrame:
    """g, mean, scale: coordinatewise medians and scaled median deviations."""
    cells = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(f"v{i}") * FINE).alias("bin")) for i in range(P)])).alias("c"))
    counts = cells.groupBy("g", "c.i", "c.bin").agg(F.count("*").alias("n"))
    counts = stored(counts)
    median = _middle(counts, ["g", "i"], "bin", 0.5, "median")
    away = counts.join(median, ["g", "i"]).groupBy("g", "i", F.abs(F.col("bin") - F.col("median")).alias("off"), "median").agg(F.sum("n").alias("n"))
    deviation = _middle(away, ["g", "i"], "off", 0.5, "off")
    floors = F.element_at(F.array(*map(F.lit, COORDINATES.values())), F.col("i") + 1)
    both = median.join(deviation, ["g", "i"]).select("g", "i", ((F.col("median") + 0.5) / FINE).alias("m"), F.greatest(F.col("off") * 1.4826 / FINE, floors).alias("s"))
    wide = both.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(P) for c in "ms"])
    return wide.select("g", F.array(*[F.col(f"m{i}") for i in range(P)]).alias("mean"), F.array(*[F.col(f"s{i}") for i in range(P)]).alias("scale"))


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_ESTIMATE = "key string, g string, mean array<double>, inverse array<double>, logdet double"


def _moments(rows: DataFrame, keys: list[str], values: list[Column]) -> DataFrame:
    named = rows.select(*dict.fromkeys([*keys, "g"]), *[v.alias(f"__v{i}") for i, v in enumerate(values)])
    return named.groupBy(*dict.fromkeys([*keys, "g"])).agg(*[F.avg(f"__v{i}").alias(f"m{i}") for i in range(P)], *[F.avg(F.col(f"__v{i}") * F.col(f"__v{j}")).alias(f"m{i}_{j}") for i, j in PAIRS])


def _square(row: dict) -> np.ndarray:
    out = np.zeros((P, P))
    for i, j in PAIRS:
        out[i, j] = out[j, i] = row[f"m{i}_{j}"]
    return out


def _kept_off_zero(scatter: np.ndarray) -> np.ndarray:
    return scatter + np.diag(np.array(list(COORDINATES.values())) ** 2)


def _starts(rows: DataFrame, middle: DataFrame, many: int) -> DataFrame:
    """key, g, mean, inverse, logdet (null) of each start of each group; key names both. middle: medians and scaled median deviations of each group."""
    met = attached(rows, middle, "g", many)
    z = [(F.col(f"v{i}") - F.col("mean")[i]) / F.col("scale")[i] for i in range(P)]
    norm = F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0]))
    e = F.exp(F.lit(2.0))  # tanh by exponentials of bounded arguments
    squashed = [F.when(F.abs(x) > 20, F.signum(x)).otherwise((F.pow(e, x) - 1) / (F.pow(e, x) + 1)) for x in z]
    directions = [F.when(norm > 0, x / norm).otherwise(F.lit(0.0)) for x in z]
    shapes = _moments(met, ["g"], squashed).withColumn("start", F.lit(STARTS[1])).unionByName(_moments(met, ["g"], directions).withColumn("start", F.lit(STARTS[2])))

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                spread = np.asarray(row["scale"], float)
                shape = np.eye(P)
                if row["start"] != STARTS[0]:
                    shape = _square(row)
                    size = np.sqrt(np.maximum(np.diag(shape), 1e-12))
                    shape = 0.999 * shape / np.outer(size, size) + 0.001 * np.eye(P)
                    np.fill_diagonal(shape, 1.0)
                scatter = shape * np.outer(spread, spread)
                out.append((f"{row['start']}|{row['g']}", row["g"], list(row["mean"]), np.linalg.inv(scatter).ravel().tolist(), None))
            yield pd.DataFrame(out, columns=["key", "g", "mean", "inverse", "logdet"]).astype({"logdet": float})

    plain = middle.select("g", F.lit(STARTS[0]).alias("start"), "mean", "scale")
    full = plain.unionByName(shapes.join(middle, "g"), allowMissingColumns=True)
    return full.mapInPandas(made, _ESTIMATE)


def _distance() -> Column:
    off = [F.col(f"v{i}") - F.col("mean")[i] for i in range(P)]
    terms = [off[i] * off[j] * F.col("inverse")[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)]
    total = terms[0]
    for x in terms[1:]:
        total = total + x
    return F.greatest(total, F.lit(0.0))


def _estimate(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """key (the first of keys), g, mean, inverse, logdet from the rows given."""

    def invert(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                mean = np.array([row[f"m{i}"] for i in range(P)])
                scatter = _kept_off_zero((_square(row) - np.outer(mean, mean)) / scale)
                out.append((row[keys[0]], row["g"], mean.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])))
            yield pd.DataFrame(out, columns=["key", "g", "mean", "inverse", "logdet"])

    return _moments(rows, keys, [F.col(f"v{i}") for i in range(P)]).mapInPandas(invert, _ESTIMATE)


def concentrated(good: DataFrame, many: int = MANY, steps: int = STEPS) -> DataFrame:
    """g, mean, inverse, logdet (stored): of each group (g, v0, v1, ...) the estimate of least determinant that concentration ends at."""
    now = stored(_starts(good, stored(_start(good)), many))
    rows = good.withColumn("key", F.explode(F.array(*[F.concat(F.lit(f"{x}|"), "g") for x in STARTS])))
    place = F.floor(F.log2(_distance() + 1e-9) * DISTANCE_FINE)
    for _ in range(steps):
        far = attached(rows, now.drop("g"), "key", many).withColumn("bin", place)
        near = _middle(far.groupBy("key", "bin").agg(F.count("*").alias("n")), ["key"], "bin", SHARE, "most")
        limits = stored(now.drop("g").join(near, "key"))
        new = stored(_estimate(attached(rows, limits, "key", many).filter(place <= F.col("most")), ["key", "g"], WITHIN_75))
        fall = new.join(now.select("key", F.col("logdet").alias("before")), "key").agg(F.max(F.coalesce(F.col("before") - F.col("logdet"), F.lit(1e9)))).first()[0]
        dropped(now)
        dropped(limits)
        now = new
        if fall is None or fall < SETTLED:
            break
    best = stored(now.groupBy("g").agg(F.min(F.struct("logdet", "key", "mean", "inverse")).alias("b")).select("g", "b.mean", "b.inverse", "b.logdet"))
    dropped(now)
    return best


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF, least: int = LEAST, many: int = MANY) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (squared; null without estimates).

    One row for each row of docs, repeated ones included. Null texts are empty: no words, so the base rules reject them. Null
    languages and sources are a group like any other. Rows of groups too small for estimates are judged by the base rules
    alone. An empty table gives no rows; other columns are ignored.
    """
    rows = stored(_measured(docs, id_col, text_col, list(keys)))
    rows = stored(pooled(rows, least, many).drop("__group", "__language"))
    # Texts that the base rules reject don't shape the estimates.
    good = rows.filter(F.col("g").isNotNull() & ~F.col("base_failed"))
    best = concentrated(good, many)
    inner = attached(good, best, "g", many).filter(_distance() <= CHI_975)
    now = stored(_estimate(inner.select("g", *[f"v{i}" for i in range(P)]), ["g"], 1.0).drop("key"))
    out = attached(rows, now, "g", many).withColumn("distance", _distance())
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"), "distance")


def query(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents"))
