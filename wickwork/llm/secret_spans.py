"""Secret scans by a linear-chain conditional random field (operator 8).

Three patterns find secrets of known forms ("base" spans). The random field adds what they miss: it tags each token as
the begin, the inside or the outside of a secret from the token's shape, its neighbours and features of the whole
text. It is trained here, by maximum likelihood, on windows around base spans of a bounded sample of documents
(the patterns are the labels), windows without any, and generated lines with other forms and with
look-alikes. Decoding is Viterbi's, exact over whole texts: a token whose outside score exceeds the others by more than
two transitions can ever give back is outside on every best path, so the chain is cut there, and only the
stretches between such tokens are walked.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tools import inverse_powers, prefix_sums, span_hashes, table, text_bytes, text_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "crf")
#: Documents sampled for training, windows of each sort among them, generated lines.
SAMPLE, WINDOWS, GENERATED = 3000, 250, 400
OUTSIDE, BEGIN, INSIDE = range(3)
HASHED = 4096


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _classes() -> tuple[np.ndarray, ...]:
    kind, bits, lower = np.full(256, 2, np.uint8), np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    for group, bit in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 4), (b"+/_.-", 8), (range(128, 256), 16)):
        kind[list(group)], bits[list(group)] = 1, bit
    kind[[32, *range(9, 14)]] = 0
    lower[65:91] += 32
    nonhex = np.ones(256, np.uint8)
    nonhex[[*range(48, 58), *range(97, 103), 32, *range(9, 14)]] = 0
    return kind, bits, lower, nonhex


KIND, BITS, LOWER, NONHEX = _classes()
#: Features of a token: own shape, hashes of two tokens before and one after, shapes of both neighbours, the text's features with the own length.
SIZES = (4096, HASHED + 1, HASHED + 1, HASHED + 1, 4097, 4097, 128)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and text of each token, and its feature numbers (tokens x len(SIZES))."""
    kind = KIND[raw]
    first = kind > 0
    first[1:] &= kind[1:] != kind[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = kind[heads] > 0
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((0, len(SIZES)), np.int64)
    size = np.add.reduceat((kind > 0).astype(np.int64), starts)
    text = np.searchsorted(at, starts, side="right") - 1
    ends = starts + size
    bits = np.bitwise_or.reduceat(BITS[raw], starts).astype(np.int64)
    hexed = np.add.reduceat(NONHEX[raw].astype(np.int64), starts) == 0
    digit = (BITS[raw] == 4).astype(np.int8)
    turns = np.zeros(len(raw), np.int64)
    turns[1:] = digit[1:] != digit[:-1]
    turns[first] = 0
    turns[kind == 0] = 0
    turns = np.add.reduceat(turns, starts)
    length = np.minimum(np.searchsorted([3, 5, 8, 12, 16, 20, 28, 40, 64], size, side="right"), 9)
    shape = ((bits * 10 + length) * 3 + np.minimum((turns + 1) // 2, 2)) * 2 + hexed
    shape += 2048 * (kind[starts] == 2)
    shape = np.minimum(shape, 4095)
    low = LOWER[raw]
    own = (span_hashes(prefix_sums(low), starts, ends, inverse_powers(len(low) + 1)) % np.uint64(HASHED)).astype(np.int64)
    marks = np.bincount(text, weights=kind[starts] == 2, minlength=len(at) - 1) / np.maximum(1, np.bincount(text, minlength=len(at) - 1))
    digits = np.bincount(text, weights=(bits & 4) > 0, minlength=len(at) - 1) / np.maximum(1, np.bincount(text, minlength=len(at) - 1))
    whole = np.searchsorted([0.02, 0.1, 0.3], marks) * 3 + np.searchsorted([0.02, 0.2], digits)

    def near(values: np.ndarray, by: int, none: int) -> np.ndarray:
        out = np.full(len(values), none, np.int64)
        if len(values) > abs(by):
            if by < 0:
                same = text[-by:] == text[:by]
                out[-by:][same] = values[:by][same]
            else:
                same = text[:-by] == text[by:]
                out[:-by][same] = values[by:][same]
        return out

    columns = (shape, near(own, -1, HASHED), near(own, -2, HASHED), near(own, 1, HASHED), near(shape, -1, 4096), near(shape, 1, 4096), whole[text] * 10 + length)
    return starts, ends, text, np.stack(columns, 1) + OFFSETS[:-1]


class Field:
    """weights: features x 3; moves[a, b]: from tag a to b; begin: scores of the first tag."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, begin: np.ndarray):
        self.weights, self.moves, self.begin = weights, moves, begin
        self.bound = 2 * float(max(moves.max(), begin.max()) - min(moves.min(), begin.min()))

    def scores(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros((len(numbers), 3), np.float32)
        for k in range(numbers.shape[1]):
            out += self.weights[numbers[:, k]]
        return out

    def viterbi(self, scores: np.ndarray, before: int | None, after: int | None) -> list[int]:
        """The best tags of a stretch between a tag before it (None: it starts a text) and one after it."""
        best = scores[0] + (self.begin if before is None else self.moves[before])
        back = []
        for row in scores[1:]:
            through = best[:, None] + self.moves
            back.append(through.argmax(0))
            best = through.max(0) + row
        if after is not None:
            best = best + self.moves[:, after]
        tags = [int(best.argmax())]
        for row in reversed(back):
            tags.append(int(row[tags[-1]]))
        return tags[::-1]

    def decode(self, scores: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Tags of all tokens, each text a chain of its own."""
        tags = np.zeros(len(scores), np.int64)
        open_ = np.flatnonzero(scores[:, OUTSIDE] - scores[:, 1:].max(1) <= self.bound)
        if len(open_):
            parts = np.split(open_, np.flatnonzero((np.diff(open_) > 1) | (np.diff(text[open_]) > 0)) + 1)
            for part in parts:
                a, b = part[0], part[-1]
                before = OUTSIDE if a > 0 and text[a - 1] == text[a] else None
                after = OUTSIDE if b + 1 < len(text) and text[b + 1] == text[b] else None
                tags[a : b + 1] = self.viterbi(scores[a : b + 1], before, after)
        return tags


def fit(texts: list[str], secrets: list[list[tuple[int, int]]], rounds: int = 50, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by AdaGrad over all windows at once; secrets: spans of each text, in code points."""
    weights, moves, begin = np.zeros((OFFSETS[-1], 3)), np.zeros((3, 3)), np.zeros(3)
    data = pa.array(texts, pa.string())
    raw, at = text_bytes(data)
    starts, ends, text, numbers = features(raw, at)
    point = np.cumsum((raw & 0xC0) != 0x80) - 1  # code point of each byte, from the first text on
    head = np.zeros(len(texts) + 1, np.int64)
    head[1:] = np.cumsum([len(x) for x in texts])
    gold = np.zeros(len(starts), np.int64)
    for k, spans in enumerate(secrets):
        own = np.flatnonzero(text == k)
        for a, b in spans:
            hit = own[(point[starts[own]] - head[k] < b) & (point[ends[own] - 1] - head[k] >= a)]
            if len(hit):
                gold[hit] = INSIDE
                gold[hit[0]] = BEGIN
    count = np.bincount(text, minlength=len(texts))
    keep = np.flatnonzero(count)
    n, longest = len(keep), int(count.max(initial=0))
    if not n:
        weights[:, OUTSIDE] = 1
        return Field(weights.astype(np.float32), moves, begin)
    row, column = np.searchsorted(keep, text), np.arange(len(text)) - np.concatenate([[0], np.cumsum(count)])[text]
    there = np.zeros((n, longest), bool)
    there[row, column] = True
    tags = np.zeros((n, longest), np.int64)
    tags[row, column] = gold
    seen_w, seen_m, seen_b = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6), np.full_like(begin, 1e-6)
    gold_one = np.eye(3)[gold]
    pairs = there[:, 1:]
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
    gold_begin = np.bincount(tags[:, 0], minlength=3).astype(float)
    for _ in range(rounds):
        score = np.zeros((n, longest, 3))
        score[row, column] = weights[numbers].sum(1)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0] + begin
        for t in range(1, longest):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + score[:, t]
            forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(there[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        share = np.exp(forward + backward - total[:, None, None])
        both = np.exp(forward[:, :-1, :, None] + moves + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        grad_m = gold_moves - both[pairs].sum(0) - ridge * moves * n
        grad_b = gold_begin - share[:, 0].sum(0) - ridge * begin * n
        error = gold_one - share[row, column]
        grad_w = np.stack([np.bincount(numbers.ravel(), weights=np.repeat(error[:, k], numbers.shape[1]), minlength=len(weights)) for k in range(3)], 1) - ridge * weights * 10
        for value, grad, seen in ((weights, grad_w, seen_w), (moves, grad_m, seen_m), (begin, grad_b, seen_b)):
            seen += grad * grad
            value += 0.3 * grad / np.sqrt(seen)
    return Field(weights.astype(np.float32), moves, begin)


def generated(count: int = GENERATED, seed: int = 7) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Lines with secrets in forms that the patterns don't know, and lines with look-alikes that are none."""
    rng = random.Random(seed)
    syllables = "an er in on at re th en tion de la los que und der ein le les ment".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    plain = lambda k: " ".join(word() for _ in range(k))
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-")
    names = "password passwd pwd secret token api_key apikey access_key client_secret auth_token private_key credential bearer passphrase".split()
    texts, secrets = [], []
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for i in range(count):
        before, after = plain(rng.randint(1, 9)), plain(rng.randint(0, 6))
        if i % 2:
            value = "".join(rng.choice(rng.choice(alphabets)) for _ in range(1)) + "".join(rng.choices(alphabets[i // 2 % 4], k=rng.choice((12, 16, 20, 24, 32, 40, 48, 64))))
            head = f"{before} {rng.choice(names)}{rng.choice((' = ', '=', ': ', ':', ' is ', ' ', chr(34) + ': ' + chr(34), ' = ' + chr(39)))}"
            texts.append(f"{head}{value} {after}")
            secrets.append([(len(head), len(head) + len(value))])
        else:
            other = rng.choice((
                lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: digits(rng.choice((4, 8, 16))), lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
                lambda: f"{word()}.{digits(2)}@{word()}.com", lambda: f"https://{word()}.org/{word()}/{digits(4)}", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}",
                lambda: plain(1).upper() + "!!", lambda: f"{word()}{rng.choice('$%#&*') * 3}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{rng.choice(names)} {word()}", lambda: f"{word()}-{word()}-{word()}/{word()}", lambda: word() * 6, lambda: f"{word()}_{word()}_{digits(2)}", lambda: plain(1).title() + ".", lambda: f"{rng.choice(names)}: {word()}",
            ))()
            texts.append(f"{before} {other} {after}")
            secrets.append([])
    return texts, secrets


def _windows(text: str, rng: random.Random) -> Iterator[tuple[bool, str, list[tuple[int, int]]]]:
    """Cuts around the secrets of base spans, and one cut elsewhere."""
    values = sorted({(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8} | {(a, b) for a, k, b in base_spans(text) if k})
    merged: list[tuple[int, int]] = []
    for a, b in values:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    for a, b in merged[:4]:
        low, high = max(0, a - 80), min(len(text), b + 60)
        yield True, text[low:high], [(x - low, y - low) for x, y in merged if low <= x and y <= high]
    low = rng.randrange(max(1, len(text) - 200))
    if not any(a < low + 200 and b > low for a, b in merged) and text:
        yield False, text[low : low + 200], []


def trained(docs: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> Field:
    """The field, from windows of at most `sample` documents (those of least hash) and generated lines."""
    ids = docs.select(F.col(id_col).alias("__id")).filter("__id is not null").distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample)
    picked = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).join(F.broadcast(ids), "__id")  # `sample` rows at most

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, text in zip(part["__id"], part["__text"], strict=True):
                rows += [(str(i), secret, x, [v for span in spans for v in span]) for secret, x, spans in _windows(text, random.Random(str(i)))]
            yield pd.DataFrame(rows, columns=["id", "secret", "x", "spans"])

    cuts = picked.mapInPandas(cut, "id string, secret boolean, x string, spans array<int>")
    rows = sorted((r.id, r.x, list(r.spans), r.secret) for r in cuts.collect())  # five windows of a few hundred characters for each document at most
    texts, secrets = generated()
    for wanted in (True, False):
        for _, x, spans, _ in [r for r in rows if r[3] == wanted][:WINDOWS]:
            texts.append(x)
            secrets.append(list(zip(spans[::2], spans[1::2], strict=True)))
    return fit(texts, secrets)


def scan(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: base ones, and the field's where none of them lies."""
    out = [base_spans(x) for x in texts]
    start = 0
    while start < len(texts):  # about a million characters at a time
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= 1_000_000):
            size += len(texts[stop])
            stop += 1
        raw, at = text_bytes(pa.array(texts[start:stop], pa.string()))
        starts, ends, text, numbers = features(raw, at)
        tags = field.decode(field.scores(numbers), text)
        hits = np.flatnonzero(tags)
        if len(hits):
            cuts = np.flatnonzero((np.diff(hits) > 1) | (np.diff(text[hits]) > 0) | (tags[hits[1:]] == BEGIN)) + 1
            for run in np.split(hits, cuts):
                k = int(text[run[0]])
                lead = raw[at[k] : ends[run[-1]]]
                points = (lead & 0xC0) != 0x80
                a, b = int(points[: starts[run[0]] - at[k]].sum()), int(points.sum())
                own = out[start + k]
                if not any(x < b and y > a for x, _, y in own):
                    own.append((a, 3, b))
        start = stop
    return [sorted(x) for x in out]


def spans(docs: DataFrame, id_col: str, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_crf for each row, repeated ones included.

    Null and empty texts have no spans; texts of any length are scanned whole; an empty table gives no rows (the field
    is then trained on generated lines alone); other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(field or trained(docs, id_col, text_col))  # of fixed size

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_crf bigint")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for found in scan(texts.tolist(), model.value):
                base = [x for x in found if x[1] < 3]
                kinds = [sum(k == kind for _, k, _ in found) for kind in range(4)]
                rows.append((*kinds[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), kinds[3]))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return docs.select(id_col, run(text_of(text_col)).alias("__found")).select(id_col, "__found.*")


def redacted(docs: DataFrame, id_col: str, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by a mark; the columns stay, the length column follows the text.

    Null texts stay null, empty ones empty; each row is cleaned by itself, repeated ones and those without an id too; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, id_col, text_col))

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            rows = texts.tolist()
            known = [x or "" for x in rows]
            out = []
            for text, whole, found in zip(rows, known, scan(known, model.value), strict=True):
                at, kept = 0, []
                for a, _, b in found:
                    if b > at:
                        if a >= at:
                            kept += [whole[at:a], mark]
                        at = b
                out.append(None if text is None else "".join([*kept, whole[at:]]))
            yield pd.Series(out, dtype=object)

    out = docs.withColumn(text_col, run(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(dict(docs.dtypes)[length_col]))
    return out.select(*docs.columns)


def query(spark, sf_dir):
    return spans(table(spark, sf_dir, "documents"), "doc_id")
