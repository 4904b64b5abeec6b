"""Document fingerprints by Order MinHash (operator 2), in DataFrame operations alone.

A text's k-mers (of k tokens) are numbered by occurrence, so that they are a set. For each of `width` hash functions the two
k-mers of least hash are taken, put in the order in which they stand in the text, and the pair is hashed to one coordinate. Two
texts agree in a coordinate only if they share both k-mers and their order, which makes the share of equal coordinates
follow edit distance.

A k-mer's hash and its place are packed into one bigint, so that the two least are minima of numbers. All of it is worked out
inside a row by functions on arrays: no k-mer is shuffled, and memory is that of one text's arrays. Occurrence numbers come
from sorting a text's own k-mers. A text moves once, to be met by its successor's beginning.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tools import dropped, stored, table, text_of

#: Tokens in a k-mer, coordinates of a fingerprint. A token is a word, or as many characters of a longer one.
K, WIDTH, TOKEN = 3, 16, 12
#: Low bits hold a place, high bits a hash.
PLACE_BITS = 31
LOW = (1 << PLACE_BITS) - 1
#: Coordinates that are worked out at a time; what tells the hash functions apart (the bits of places are left alone).
GROUP = 4
_RNG = random.Random(31)
_CONSTANTS = [(_RNG.getrandbits(63) >> PLACE_BITS << PLACE_BITS) - (j % 2 << 63) for j in range(256)]


def _packed(hash_: Column, place: Column) -> Column:
    return hash_.bitwiseAND(F.lit(~LOW)).bitwiseOR(place.cast("bigint"))


def elements(texts: DataFrame, text_col: str, out: str) -> DataFrame:
    """texts with the array of packed occurrence-numbered k-mers of a text column. Each step is a column of its own: an array that a lambda reads must not be computed in it."""
    step = lambda n: f"__{out}{n}"
    tokens = F.regexp_extract_all(text_col, F.lit(rf"[^\x20\x09-\x0D]{{1,{TOKEN}}}"), F.lit(0))
    texts = texts.withColumn(step(0), F.transform(tokens, lambda t: F.xxhash64(t)))
    n = F.size(step(0))
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - K, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    grams = F.transform(places, lambda i: _packed(F.xxhash64(*[F.get(F.col(step(0)), i + k) for k in range(K)]), i))
    texts = texts.withColumn(step(1), F.sort_array(grams))
    sorted_ = F.col(step(1))
    count = F.size(sorted_)
    kind = lambda i: F.shiftright(F.get(sorted_, i), PLACE_BITS)
    all_ = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    texts = texts.withColumn(step(2), F.filter(all_, lambda i: (i == 0) | (kind(i) != kind(i - 1))))
    heads = F.col(step(2))
    numbered = lambda at, r: F.transform(
        F.slice(sorted_, at + 1, F.coalesce(F.get(heads, r + 1), count) - at),
        lambda x, j: _packed(F.xxhash64(F.shiftright(x, PLACE_BITS), j), x.bitwiseAND(F.lit(LOW))))
    return texts.withColumn(out, F.flatten(F.transform(heads, numbered))).drop(*map(step, range(3)))


def fingerprinted(texts: DataFrame, text_col: str, out: str, width: int = WIDTH) -> DataFrame:
    """texts with the fingerprint of a text column: 8 hexadecimal digits for each coordinate. Texts without tokens all have the same one.

    The hash functions are one hash of a k-mer combined by XOR with a constant for each coordinate: under each every order of a set's
    k-mers is equally likely. GROUP coordinates are worked out at a time, so that generated methods stay small enough to be compiled.
    """
    e, digits = f"__{out}e", []
    place = lambda x: x.bitwiseAND(F.lit(LOW))
    name = lambda x: F.shiftright(x, PLACE_BITS)
    turned = lambda c: lambda x: x.bitwiseXOR(F.lit(c))
    texts = elements(texts, text_col, e)
    for start in range(0, width, GROUP):
        names = [f"__{out}{j}" for j in range(start, min(width, start + GROUP))]
        texts = texts.withColumns({h: F.transform(e, turned(_CONSTANTS[start + k])) for k, h in enumerate(names)})
        texts = texts.withColumns({f"{h}a": F.array_min(h) for h in names})
        texts = texts.withColumns({f"{h}b": F.coalesce(F.array_min(F.array_remove(h, F.col(f"{h}a"))), F.col(f"{h}a")) for h in names})
        pairs = [(F.col(f"{h}a"), F.col(f"{h}b")) for h in names]
        pairs = [F.when(place(a) <= place(b), F.xxhash64(name(a), name(b))).otherwise(F.xxhash64(name(b), name(a))) for a, b in pairs]
        digits.append(f"__{out}d{start}")
        texts = texts.withColumn(digits[-1], F.concat(*[F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0") for x in pairs]))
        texts = texts.drop(*names, *(f"{h}{x}" for h in names for x in "ab"))
    return texts.withColumn(out, F.concat(*digits)).drop(e, *digits)


def likeness(a: Column, b: Column, width: int = WIDTH) -> Column:
    """Share of equal coordinates of two fingerprints."""
    digits = lambda x, j: F.substring(x, 8 * j + F.lit(1), F.lit(8))
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: digits(a, j) == digits(b, j))) / F.lit(float(width))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2, text: k1 and k2 are never null and name a row by its id and its text."""
    text = text_of(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("k1"), F.xxhash64(F.col(id_col).isNull(), text).alias("k2"), text.alias("text"), F.col(id_col).alias("id"))


def neighbours(keyed: DataFrame) -> DataFrame:
    """k1, k2, id, n (characters), times (rows that repeat it), n1, n2 (the keys of the next one), stored; after the last comes the first.

    Rows are sorted by id (those without one last), and of one id by a hash of the text, in ranges. What a range doesn't know is the first row of the next one.
    """
    rows = keyed.groupBy("k1", "k2", "id").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("times"))
    order = [F.col("id").isNull(), F.col("id"), F.col("k2")]
    ranged = stored(rows.withColumn("lacks", F.col("id").isNull()).repartitionByRange("lacks", "id", "k2").withColumn("range", F.spark_partition_id()))
    firsts = ranged.groupBy("range").agg(F.min(F.struct("lacks", "id", "k2", "k1")).alias("first"))
    follow = Window.orderBy("range")  # as many rows as partitions
    ends = firsts.select("range", F.coalesce(F.lead("first").over(follow), F.min("first").over(Window.partitionBy())).alias("after"))
    inside = Window.partitionBy("range").orderBy(*order)
    near = ranged.withColumn("inner", F.lead(F.struct("lacks", "id", "k2", "k1")).over(inside)).join(F.broadcast(ends), "range").withColumn("next", F.coalesce("inner", "after"))
    out = stored(near.select("k1", "k2", "id", "n", "times", F.col("next.k1").alias("n1"), F.col("next.k2").alias("n2")))
    dropped(ranged)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, fingerprint of each row. Null texts are empty; all texts without tokens have one fingerprint; other columns are ignored."""
    rows = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    return fingerprinted(rows, "__text", "fingerprint", width).select(id_col, "fingerprint")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next row's text.
    One row for each row of docs. Rows that repeat an id and its text are one document here (it isn't its own next), with as many
    rows in the result; different texts of one id follow each other by a hash of the text; rows without an id come last. One document alone is its
    own next. Null texts are empty. An empty table gives no rows; other columns are ignored.
    """
    keyed = _keyed(docs, id_col, text_col)
    near = neighbours(keyed)
    # Both joins read this one exchange of texts.
    texts = keyed.select("k1", "k2", "text").repartition("k1", "k2")
    if not near.filter("times > 1").isEmpty():
        texts = texts.dropDuplicates(["k1", "k2"])
    owners = near.select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.expr("n div 4").alias("most"))
    parts = texts.join(owners.hint("shuffle_hash"), ["k1", "k2"]).select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), F.expr("left(text, int(most))").alias("part"))
    rows = texts.join(parts.hint("shuffle_hash"), ["k1", "k2"]).withColumn("quarter", F.expr("int(char_length(text) div 4)"))
    rows = rows.select("k1", "k2", "text", F.expr("concat(left(text, char_length(text) - quarter), left(part, quarter))").alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    prints = fingerprinted(fingerprinted(rows, "text", "fingerprint", width).drop("text"), "edited", "edited_fingerprint", width)
    made = stored(prints.select("k1", "k2", "edited_sha256", "fingerprint", "edited_fingerprint"))
    following = near.select("k1", "k2", "n1", "n2").join(made.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("fingerprint").alias("next_fingerprint")).hint("shuffle_hash"), ["n1", "n2"]).select("k1", "k2", "next_fingerprint")
    out = near.join(made.hint("shuffle_hash"), ["k1", "k2"]).join(following.hint("shuffle_hash"), ["k1", "k2"])
    out = out.withColumn("__copy", F.explode(F.expr("sequence(1, int(times))")))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), width).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint"), width).alias("near_next"))


def query(spark, sf_dir):
    return edited(table(spark, sf_dir, "documents"))
