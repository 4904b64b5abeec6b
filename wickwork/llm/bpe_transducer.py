"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding (operator 4).

The merges are compiled as follows. For every prefix of a piece there is exactly one last token of its encoding: the
suffix token t for which the last token before it, u, and t stand side by side as a pair that no merge joins or
re-cuts ("stable" pair). Stability depends on u and t alone. A border inside the bytes read so far is open while what
follows it is the proper prefix of some token, so that a token may still start there. A state of the transducer has
the bytes since the oldest open border and, for each open border, the last token before it and the tokens on the path to it that
are not certain yet. On a byte, the one token that ends there is found among the open borders; what all
paths have in common is emitted. Lookahead is thus bounded by the longest token. States and their transitions
are made only when a text first takes them (lazy determinisation). At a piece's end the path to its end is flushed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tools import table, text_of

#: States and whole pieces that a worker keeps; beyond them it starts anew (results don't change, only speed).
STATES, PIECES = 250_000, 400_000
#: Marks that often end a word.
MARKS = ".,;:!?"
#: Fixed value: the splitting pattern of the public byte-level vocabularies.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        # A state: the bytes since the oldest open border; for each open border from the oldest, how many bytes follow it,
        # the last token before it (-1: none) and its uncertain path. The last one is the end itself.
        self.states: list[tuple[bytes, tuple[tuple[int, int, tuple[int, ...]], ...]]] = []
        self.known: dict[tuple, int] = {}
        self.moves: dict[int, int] = {}  # state * 256 + byte -> state
        self.emits: dict[int, tuple[int, ...]] = {}  # the same keys, where tokens become certain
        self._number((b"", ((0, -1, ()),)))

    def _number(self, state: tuple) -> int:
        at = self.known.get(state)
        if at is None:
            at = self.known[state] = len(self.states)
            self.states.append(state)
        return at

    def merge(self, data: bytes, until: int = 1) -> list[int]:
        """Plain BPE: joins the leftmost pair of least rank until none has a rank, or `until` parts are left. Only used on tokens, to compile."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            ranked = [(self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for one byte. A token that its own bytes don't merge to is never emitted: (-1, -1)."""
        found = self.split.get(token, 0)
        if found == 0:
            data = self.tokens[token]
            parts = self.merge(data, until=2)
            whole = len(parts) == 2 and self.ranks.get(self.tokens[parts[0]] + self.tokens[parts[1]]) == token
            found = self.split[token] = None if len(data) == 1 else (parts[0], parts[1]) if whole else (-1, -1)
        return found

    def stable(self, left: int, right: int) -> bool:
        """Whether two tokens, each the encoding of its own bytes, are also the encoding of both together.

        Merging is followed back in time from the end: the younger token that touches the border is cut into its halves, and a
        merge across the border must never have been due before the cut token was made. Of equal ranks the leftmost is due first.
        """
        found = self.pairs.get((left, right))
        if found is None:
            x, y, due = left, right, 1 << 60
            while True:
                if self.ranks.get(self.tokens[x] + self.tokens[y], 1 << 60) < due:
                    found = False
                    break
                a, b = self.halves(x), self.halves(y)
                if (-1, -1) in (a, b):
                    found = False
                    break
                if a is None and b is None:
                    found = True
                    break
                if b is None or (a is not None and x > y):
                    due, x = x, a[1]
                else:
                    due, y = y + 1, b[0]
            self.pairs[left, right] = found
        return found

    def step(self, state: int, byte: int) -> int:
        """Makes the transition of a state on a byte: the next state; emits has the tokens that became certain."""
        tail, borders = self.states[state]
        tail += bytes((byte,))
        end, still = None, []
        for length, last, path in borders:
            part = tail[len(tail) - length - 1 :]
            token = self.ranks.get(part)
            if end is None and token is not None and (self.stable(last, token) if last >= 0 else self.halves(token) != (-1, -1)):
                end = (0, token, (*path, token))
            if part in self.prefixes:
                still.append((length + 1, last, path))
        if end is None:
            raise ValueError("the ranks lack a single byte")
        still.append(end)
        shared = 0
        first, *others = [path for _, _, path in still]
        while shared < len(first) and all(len(x) > shared and x[shared] == first[shared] for x in others):
            shared += 1
        key = state << 8 | byte
        if shared:
            self.emits[key] = first[:shared]
            still = [(length, last, path[shared:]) for length, last, path in still]
        oldest = still[0][0]
        to = self.moves[key] = self._number((tail[len(tail) - oldest :], tuple(still)))
        return to

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > STATES:
            self._reset()
        state, out, moves, emits = 0, [], self.moves, self.emits
        for byte in piece:
            key = state << 8 | byte
            state = moves.get(key)
            if state is None:
                state = self.step(key >> 8, byte)
            if key in emits:
                out += emits[key]
        out += self.states[state][1][-1][2]
        return out


def packed(ids: list[int]) -> bytes:
    """ids as little-endian uint32."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Pieces(dict):
    """Piece -> its packed ids; the transducer runs on what isn't there."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = packed(self.transducer.encode(piece.encode()))
        if len(piece) <= 64:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


class _Chunks(dict):
    """What stands between two spaces, with the space before it -> its packed ids; the pattern splits what isn't there."""

    def __init__(self, pieces: _Pieces, split: regex.Pattern):
        super().__init__()
        self.pieces, self.split, self.transducer = pieces, split, pieces.transducer

    def __missing__(self, chunk: str) -> bytes:
        # Letters up to U+024F are the same in every version of Unicode: such a word is one piece, and so is a mark after it.
        word = chunk[:-1] if chunk[-1:] in MARKS and chunk else chunk
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            if word != chunk:
                return self[word] + self.pieces[chunk[-1]]
            ids = packed(self.transducer.encode(b" " + chunk.encode()))
        else:
            ids = b"".join(map(self.pieces.__getitem__, self.split.findall(" " + chunk)))
        if len(chunk) <= 64:
            if len(self) >= PIECES:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Encodes the matches of a pattern each by itself.

    With the pattern of the byte-level vocabularies no match holds a space after another character that isn't white space, so a
    text can be cut before such spaces and the parts encoded one by one. `by_chunks` says that a pattern has this property.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, by_chunks: bool):
        self.transducer, self.split, self.by_chunks = Transducer(ranks), regex.compile(pattern), by_chunks
        self.pieces = _Pieces(self.transducer)
        self.chunks = _Chunks(self.pieces, self.split)
        self.spaced = re.compile(r"\s ")

    def encode(self, text: str) -> np.ndarray:
        if not self.by_chunks or self.spaced.search(text):
            found = map(self.pieces.__getitem__, self.split.findall(text))
        else:
            head, *rest = text.split(" ")
            found = chain(map(self.pieces.__getitem__, self.split.findall(head)), map(self.chunks.__getitem__, rest))
        return np.frombuffer(b"".join(found), dtype="<u4")


class Utf8State:
    """Follows UTF-8 byte by byte over chunk ends: `need` continuation bytes are missing, the next one lies in low .. high."""

    def __init__(self):
        self.need, self.low, self.high = 0, 0x80, 0xBF

    def step(self, byte: int) -> bool:
        """False: the byte can't stand here; the state starts anew."""
        if self.need:
            if self.low <= byte <= self.high:
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                return True
            self.need, self.low, self.high = 0, 0x80, 0xBF
            return False
        if byte < 0x80:
            return True
        if 0xC2 <= byte <= 0xDF:
            self.need = 1
        elif 0xE0 <= byte <= 0xEF:
            self.need, self.low, self.high = 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        elif 0xF0 <= byte <= 0xF4:
            self.need, self.low, self.high = 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        else:
            return False
        return True


class Decoder:
    """Streaming: feed() takes ids and gives the text that is complete; bytes of an unfinished character wait for the next ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = np.empty(max(ranks.values()) + 1, dtype=object)
        for token, i in ranks.items():
            self.table[i] = token
        self.pending = b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.pending + b"".join(self.table[np.asarray(ids, dtype=np.int64)])
        # Only the last character can be unfinished: the state machine runs from the last byte that starts one.
        start = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] >= 0xC0:
                start = len(data) - back
                break
            if data[-back] < 0x80:
                break
        state, good = Utf8State(), True
        for byte in data[start:]:
            good = good and state.step(byte)
        cut = start if good and state.need else len(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", errors="replace")

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", errors="replace")


_MADE: dict[tuple[str, str], tuple[Encoder, dict[bytes, int]]] = {}


def tokenizer(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One encoder for each worker process; a decoder anew."""
    if (path, pattern) not in _MADE:
        ranks = read_ranks(path)
        _MADE[path, pattern] = (Encoder(ranks, pattern, pattern == BYTE_LEVEL), Decoder(ranks))
    return _MADE[path, pattern]


def decode_stream(ids: np.ndarray, decoder: Decoder, chunk: int = 4096) -> Iterator[str]:
    for i in range(0, len(ids), chunk):
        yield decoder.feed(ids[i : i + chunk])
    yield decoder.finish()


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the column ids_col: array of ids. Null counts as the empty text, whose array is empty."""

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder, _ = tokenizer(path, pattern)
        for texts in parts:
            yield pd.Series([encoder.encode(x).astype(np.int32) for x in texts], dtype=object)

    return docs.withColumn(ids_col, run(text_of(text_col)))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null counts as no ids, bytes that are no UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _, decoder = tokenizer(path, r"(?s).+")
        for ids in parts:
            yield pd.Series(["".join(decode_stream(np.asarray(x), decoder)) for x in ids], dtype=object)

    return rows.withColumn(text_col, run(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))


def digests(docs: DataFrame, id_col: str, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 for each row, repeated rows included; null is the empty text; an empty table gives none."""

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = tokenizer(path, pattern)
        for texts in parts:
            out = []
            for text in texts:
                ids = encoder.encode(text)
                decoded = hashlib.sha256()
                for part in decode_stream(ids, decoder):
                    decoded.update(part.encode())
                out.append((len(ids), hashlib.sha256(ids).hexdigest(), decoded.hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, run(text_of(text_col)).alias("__found")).select(id_col, "__found.*")


def query(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), "doc_id", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
