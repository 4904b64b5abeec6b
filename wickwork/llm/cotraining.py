"""Quality classifier by co-training (operator 1).

Two views of a document, each with a naive Bayes classifier whose training data are sums: its text content (hashed
byte trigrams) and its page metadata (language, source and layout: length, lines, line length, shares of capitals, digits,
marks and spaces, each in bins: a page's markup isn't in the table, its layout stands for it. The text view doesn't see
these figures, nor the metadata view any word). Both start from a bounded sample of labelled rows. In each round both score every
document; where one view is confident, its verdict becomes a training label of the other. The sums of a round have a fixed
size and are added up within each partition first. Views are calibrated (Platt) on labelled rows
that are never trained on, and combined there by a logistic regression that scores all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tools import table, text_bytes, text_of

#: Labelled rows used (those whose id has the least hash; a third calibrates); rounds; confidence of a pseudo-label; least probability that is kept.
LABELLED, ROUNDS, CONFIDENT, KEEP = 3000, 2, 0.98, 0.3
TRIGRAMS = 4096
#: After the trigrams, one feature of this many tells how varied a text of its length is.
VARIETY = 16 * 16
#: Bins of the metadata view: language, source, length, lines, line length, capitals, digits, marks, spaces.
BINS = (32, 256, 24, 16, 16, 12, 12, 12, 12)
STARTS = np.concatenate([[0], np.cumsum(BINS)]).astype(np.int64)
#: Shares of a text's trigrams are counted in these units, so that sums are whole numbers and don't depend on their order.
UNITS = 10_000
SHARES = np.array([0, 0.001, 0.003, 0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.4, 0.6])
_LUT = np.zeros(256, np.int8)  # 1 capital, 2 digit, 3 mark, 4 blank
for _chars, _kind in ((range(65, 91), 1), (range(48, 58), 2), ([x for x in range(33, 127) if not chr(x).isalnum()], 3), ((32, *range(9, 14)), 4)):
    _LUT[list(_chars)] = _kind


def views(texts: list[str], langs: list, sources: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each part of the texts: where it starts, text view (rows x features, in UNITS), metadata view (rows x features: bin numbers)."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and stop - start < 256 and (stop == start or size + len(texts[stop]) <= 1_000_000):
            size += len(texts[stop])
            stop += 1
        raw, at = text_bytes(pa.array(texts[start:stop], pa.string()))
        n, long = stop - start, np.diff(at)
        owner = np.repeat(np.arange(n), long)
        wide = raw.astype(np.uint32)
        counts = np.zeros((n, TRIGRAMS), np.int64)
        if len(raw) > 2:
            code = ((wide[:-2] * np.uint32(65536) + wide[1:-1] * np.uint32(256) + wide[2:]) * np.uint32(2654435761)) >> np.uint32(20)
            inside = owner[:-2] == owner[2:]
            counts = np.bincount(owner[:-2][inside] * TRIGRAMS + code[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        total = counts.sum(1)
        text = np.zeros((n, TRIGRAMS + VARIETY), np.int64)
        text[:, :TRIGRAMS] = counts * UNITS // np.maximum(1, total[:, None])
        differ = (counts > 0).sum(1) * 15 // np.maximum(1, np.minimum(total, TRIGRAMS))
        text[np.arange(n), TRIGRAMS + differ * 16 + np.minimum(np.log2(total + 1), 15).astype(np.int64)] = UNITS
        kinds = np.bincount(owner * 5 + _LUT[raw], minlength=n * 5).reshape(n, 5)
        lines = 1 + np.bincount(owner, weights=raw == 10, minlength=n)
        whole = np.maximum(1, long)
        columns = [
            [zlib.crc32(str(x).encode()) % BINS[0] for x in langs[start:stop]], [zlib.crc32(str(x).encode()) % BINS[1] for x in sources[start:stop]],
            np.minimum(np.log2(whole), BINS[2] - 1), np.minimum(np.log2(lines), BINS[3] - 1), np.minimum(np.log2(np.maximum(1, whole / lines)), BINS[4] - 1),
            *(np.searchsorted(SHARES, kinds[:, k] / whole, side="right") for k in range(1, 5)),
        ]
        yield start, text, np.stack([np.asarray(c).astype(np.int64) for c in columns], 1) + STARTS[:-1]
        start = stop


def _sums(view: str, features: np.ndarray) -> np.ndarray:
    return features.sum(0) if view == "text" else np.bincount(features.ravel(), minlength=STARTS[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression with a constant, by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class View:
    """Scores are log odds (of the text view: of trigrams on average, and of variety); slope and offset calibrate them."""

    name: str
    odds: np.ndarray
    slope: np.ndarray | None = None

    @classmethod
    def fitted(cls, name: str, sums: np.ndarray) -> View:
        """sums: for each class (bad, good) what its documents' features add up to."""
        if name == "text":
            blocks = [(0, TRIGRAMS, UNITS * 0.02), (TRIGRAMS, TRIGRAMS + VARIETY, UNITS * 0.5)]
        else:  # each feature's bins are a distribution of their own
            blocks = [(a, b, 1.0) for a, b in zip(STARTS, STARTS[1:], strict=False)]
        share = np.concatenate([(sums[:, a:b] + x) / (sums[:, a:b] + x).sum(1, keepdims=True) for a, b, x in blocks], 1)
        return cls(name, np.log(share[1]) - np.log(share[0]))

    def raw(self, features: np.ndarray) -> np.ndarray:
        if self.name == "text":
            scaled = features / UNITS
            return np.column_stack([scaled[:, :TRIGRAMS] @ self.odds[:TRIGRAMS] * 20, scaled[:, TRIGRAMS:] @ self.odds[TRIGRAMS:]])
        return self.odds[features].sum(1)[:, None]

    def calibrate(self, features: np.ndarray, good: np.ndarray) -> None:
        self.slope = logistic(self.raw(features), good)

    def logit(self, features: np.ndarray) -> np.ndarray:
        return np.clip(self.raw(features) @ self.slope[:-1] + self.slope[-1], -15, 15)


@dataclass
class Model:
    text: View
    page: View
    weights: np.ndarray  # of the logits of both views, and a constant

    def logits(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        return np.column_stack([self.text.logit(text), self.page.logit(page)])

    def good(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(logits @ self.weights[:2] + self.weights[2])))


def _inputs(docs: DataFrame, id_col: str) -> DataFrame:
    optional = [F.col(c).cast("string").alias(f"__{c}") if c in docs.columns else F.lit(None).cast("string").alias(f"__{c}") for c in ("lang", "source")]
    return docs.select(F.col(id_col).cast("string").alias("__id"), text_of().alias("__text"), *optional)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, most: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Ids, text views, metadata views and labels (1: good) of at most `most` labelled documents. Rows that contradict each other are no labels."""
    clear = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col(id_col).cast("string").alias("__id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high and __id is not null")
    there = clear.join(docs.select(F.col(id_col).cast("string").alias("__id")).distinct(), "__id", "left_semi")
    picked = there.orderBy(F.xxhash64("__id"), "__id").limit(most).select("__id", F.col("low").alias("__good"))

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start, text, page in views(part["__text"].tolist(), part["__lang"].tolist(), part["__source"].tolist()):
                rows = part.iloc[start : start + len(text)]
                yield pd.DataFrame({"id": rows["__id"].to_numpy(), "good": rows["__good"].to_numpy(), "text": [x.astype("<u2").tobytes() for x in text], "page": [x.astype("<u2").tobytes() for x in page]})

    rows = _inputs(docs, id_col).join(F.broadcast(picked), "__id").mapInPandas(measure, "id string, good int, text binary, page binary").collect()  # `most` rows of fixed size
    rows = sorted({r.id: r for r in sorted(rows, key=lambda r: r.text)}.values(), key=lambda r: zlib.crc32(r.id.encode()))
    load = lambda x: np.array([np.frombuffer(v, "<u2") for v in x], np.int64)
    return [r.id for r in rows], load([r.text for r in rows]).reshape(len(rows), TRIGRAMS + VARIETY), load([r.page for r in rows]).reshape(len(rows), len(BINS)), np.array([r.good for r in rows], np.int64)


def _both(name: str, features: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.stack([_sums(name, features[good == k]) for k in (0, 1)]).astype(float)


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", most: int = LABELLED, rounds: int = ROUNDS, confident: float = CONFIDENT) -> Model | None:
    """None where the labels lack a class."""
    ids, text, page, good = labelled(docs, labels, id_col, most)
    held = np.arange(len(ids)) % 3 == 0
    if min(len(set(good[held])), len(set(good[~held]))) < 2:
        return None
    own = {"text": text, "page": page}
    seeds = {name: _both(name, x[~held], good[~held]) for name, x in own.items()}

    def fitted(sums: dict[str, np.ndarray]) -> Model:
        parts = {name: View.fitted(name, sums[name]) for name in sums}
        for name, view in parts.items():
            view.calibrate(own[name][held], good[held])
        model = Model(parts["text"], parts["page"], np.zeros(3))
        model.weights = logistic(model.logits(text[held], page[held]), good[held], ridge=1.0)
        return model

    model = fitted(seeds)
    limit, known = np.log(confident / (1 - confident)), frozenset(ids)
    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((model, known))  # of fixed size

        def add(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            now, seeds_ = sent.value
            sums = {"text": np.zeros((2, TRIGRAMS + VARIETY), np.int64), "page": np.zeros((2, STARTS[-1]), np.int64)}
            for part in parts:
                ids_ = part["__id"].tolist()
                for start, t, p in views(part["__text"].tolist(), part["__lang"].tolist(), part["__source"].tolist()):
                    new = np.array([x not in seeds_ for x in ids_[start : start + len(t)]])
                    logits = now.logits(t, p)
                    for teacher, name, features in ((1, "text", t), (0, "page", p)):  # each view learns from the other
                        for k, sure in ((0, logits[:, teacher] <= -limit), (1, logits[:, teacher] >= limit)):
                            sums[name][k] += _sums(name, features[sure & new])
            for name, both in sums.items():
                for k in (0, 1):
                    hit = np.flatnonzero(both[k])
                    yield pd.DataFrame({"view": name, "k": k, "f": hit, "n": both[k][hit]})

        total = {name: x.copy() for name, x in seeds.items()}
        for r in _inputs(docs, id_col).mapInPandas(add, "view string, k int, f int, n bigint").groupBy("view", "k", "f").agg(F.sum("n").alias("n")).collect():  # of fixed size
            total[r.view][r.k, r.f] += r.n
        model = fitted(total)
    return model


def _scores(docs: DataFrame, model: Model | None):
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("p_text double, p_page double, p_good double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        now = sent.value
        for texts, langs, sources in parts:
            out = [np.zeros((0, 3))]
            if now is None:
                out.append(np.full((len(texts), 3), np.nan))
            else:
                for _, t, p in views(texts.tolist(), langs.tolist(), sources.tolist()):
                    logits = now.logits(t, p)
                    out.append(np.column_stack([1 / (1 + np.exp(-logits)), now.good(logits)]))
            yield pd.DataFrame(np.round(np.concatenate(out), 9), columns=["p_text", "p_page", "p_good"])

    optional = [F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")]
    return run(text_of(), *optional)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep: float = KEEP, **settings) -> DataFrame:
    """id, p_text, p_page, p_good, kept for each row of docs, repeated ones included.

    Null texts are empty, null languages and sources values of their own. Labels other than 0 and 1, of unknown documents,
    or contradicting ones don't count; without labels of both classes there is no model: the scores are null and all is kept.
    An empty table gives no rows; other columns are ignored, texts are read whole.
    """
    model = trained(docs, labels, id_col, **settings)
    out = docs.select(id_col, _scores(docs, model).alias("__s")).select(id_col, "__s.*")
    out = out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("p_text", "p_page", "p_good")})
    return out.withColumn("kept", F.coalesce(F.col("p_good") >= keep, F.lit(True)))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep: float = KEEP, **settings) -> DataFrame:
    """The rows of docs that are kept, with docs' columns; as in `scored`, each row by itself, and all of them where there is no model."""
    model = trained(docs, labels, id_col, **settings)
    if model is None:
        return docs
    return docs.withColumn("__s", _scores(docs, model)).filter(F.col("__s.p_good") >= keep).select(*docs.columns)


def query(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
