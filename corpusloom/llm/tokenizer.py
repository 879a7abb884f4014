"""Encoding with a public byte-level BPE vocabulary (problem 8).

Method: the merges are compiled into a finite-state transducer that is
determinised lazily.  A state is the longest suffix of the bytes read that may
still grow into a token, with the pending token chains of all positions inside
that suffix; a transition reads one symbol (a character, as its UTF-8 bytes),
extends every chain and emits the tokens on which all chains agree, so output
follows input after a lookahead bounded by the longest token.  Transitions are
kept as they are met, whole frequent pieces as arcs of their own.  Both tables
have a size at which they are emptied and begun anew; results don't depend on it.

That the chains are right follows from a property of BPE: a token sequence is
the encoding of its bytes exactly if each of its neighbouring pairs is the
encoding of theirs, so the last token of each prefix is the one suffix token
that makes a valid pair with the last token of the prefix before it.

Decoding is streaming as well: an incremental UTF-8 state machine turns the
bytes of one token after another into text, holding back incomplete characters
and replacing ill-formed ones by U+FFFD.

Defined results: empty and null texts give an empty list; text that spells a
special token is ordinary text; every text decodes to itself.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Kept transitions and whole pieces, per worker; past it a table is emptied.
MAX_ARCS = 400_000
MAX_PIECES = 200_000
#: Longest piece, in characters, that is kept whole.
PIECE_CHARS = 24


def default_path() -> str:
    """The vocabulary file of byte_bpe_50k as ranks."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _class(prop: str, last: int) -> str:
    """A character class body of the property, as ranges up to ``last``."""
    points = [ord(c) for c in regex.findall(prop, "".join(chr(i) for i in range(last + 1) if not 0xD800 <= i < 0xE000))]
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}" if j > i else f"\\U{points[i]:08x}")
        i = j + 1
    return "".join(out)


@lru_cache(maxsize=4)
def _splitter(last: int) -> re.Pattern:
    """The vocabulary's split into pieces, for texts without characters beyond ``last``.

    The same pieces as its published pattern; runs of letters are tried first as they are the most frequent,
    which changes nothing since no other alternative can begin with a letter or a blank before one.
    """
    letter, number = _class(r"\p{L}", last), _class(r"\p{N}", last)
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(
        f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


class Transducer:
    """The lazily determinised transducer of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(len(t) + 1)}
        self.valid: dict[tuple[int, int], bool] = {}
        self._reset_arcs()
        self.pieces = _Pieces(self)
        self.counts = _Counts(self)

    # The machine -------------------------------------------------------------------------------

    def _reset_arcs(self) -> None:
        self.state_ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.arcs: dict[tuple[int, str], tuple[int, tuple]] = {}
        self.start = self._state((b"", -1, ((),)))

    def _state(self, key: tuple) -> int:
        n = self.state_ids.get(key)
        if n is None:
            n = self.state_ids[key] = len(self.states)
            self.states.append(key)
        return n

    def _pair(self, a: int, b: int) -> bool:
        """Whether the tokens a, b (or b alone, for a < 0) are the encoding of their bytes."""
        ok = self.valid.get((a, b))
        if ok is None:
            if len(self.valid) > MAX_ARCS:
                self.valid.clear()
            want = [b] if a < 0 else [a, b]
            ok = self.valid[a, b] = self.merged(b"".join(self.tokens[x] for x in want)) == want
        return ok

    def merged(self, data: bytes) -> list[int]:
        """The encoding of few bytes by the merges themselves, lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            pair, out, i = parts[at] + parts[at + 1], [], 0
            left, right = parts[at], parts[at + 1]
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == left and parts[i + 1] == right:
                    out.append(pair)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ranks[p] for p in parts]

    def _step(self, key: tuple, byte: bytes) -> tuple[tuple, tuple]:
        """One byte: the next state and what it emits.

        ``key`` holds the live suffix, the last token emitted (-1: none) and, for each position in the suffix from the
        end back to its beginning, the pending tokens of the text up to there.
        """
        suffix, before, pending = key
        grown = suffix + byte
        while grown not in self.prefixes:
            grown = grown[1:]
        new = None
        for size in range(len(grown), 0, -1):
            t = self.ranks.get(grown[len(grown) - size :])
            if t is None:
                continue
            held = pending[size - 1]
            if self._pair(held[-1] if held else before, t):
                new = (*held, t)
                break
        assert new is not None, "every single byte is a token"
        live = (new, *pending[: len(grown)])
        shared = 0
        least = min(map(len, live))
        while shared < least and all(p[shared] == new[shared] for p in live):
            shared += 1
        if shared:
            return (grown, new[shared - 1], tuple(p[shared:] for p in live)), new[:shared]
        return (grown, before, live), ()

    def run(self, piece: str) -> list[int]:
        """The ids of one piece, character by character."""
        out: list[int] = []
        if len(self.arcs) > MAX_ARCS:
            self._reset_arcs()
        arcs, state = self.arcs, self.start
        for c in piece:
            arc = arcs.get((state, c))
            if arc is None:
                key, said = self.states[state], ()
                for b in c.encode():
                    key, more = self._step(key, bytes((b,)))
                    said += more
                arc = arcs[state, c] = (self._state(key), said)
            state, said = arc
            if said:
                out += said
        out += self.states[state][2][0]
        return out

    # Texts -------------------------------------------------------------------------------------

    @staticmethod
    def split(text: str) -> list[str]:
        return _splitter(0xFFFF if text.isascii() or max(text) <= "\uffff" else 0x3FFFF).findall(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(self.counts.__getitem__, self.split(text))) if text else 0

    def decode(self, ids: Iterable[int]) -> str:
        machine = Utf8Machine()
        return "".join(machine.feed(self.tokens[i]) for i in ids) + machine.end()


class _Pieces(dict):
    """Whole pieces and their ids; a missing one runs through the machine."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.machine.run(piece))
        if len(piece) <= PIECE_CHARS:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class _Counts(_Pieces):
    def __missing__(self, piece: str) -> int:
        n = len(self.machine.run(piece))
        if len(piece) <= PIECE_CHARS:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = n
        return n


class Utf8Machine:
    """An incremental UTF-8 state machine: bytes in, complete characters out.

    Its state is the bytes of a character begun and the range its next byte must lie in.
    """

    def __init__(self) -> None:
        self.point = self.need = 0
        self.low, self.high = 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.need and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.point = self.point << 6 | b & 0x3F
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.point))
                    continue
                out.append("\ufffd")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.point = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.point = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.point = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("\ufffd")
        return "".join(out)

    def end(self) -> str:
        """What an incomplete character at the end becomes."""
        left, self.need = self.need, 0
        return "\ufffd" if left else ""


@lru_cache(maxsize=4)
def transducer(vocabulary: bytes) -> Transducer:
    """The machine of a vocabulary file's content, one per worker process."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return Transducer(ranks)


def load_vocabulary(path: str | None = None) -> bytes:
    with open(path or default_path(), "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row; no shuffle.  The vocabulary file (under 1 MB, fixed) is sent to each executor once."""
    shared = _share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shared.value)
        get, split = machine.pieces.__getitem__, machine.split
        for batch in batches:
            flat, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                if text:
                    flat.extend(chain.from_iterable(map(get, split(text))))
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.array([], dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens) of each row."""
    shared = _share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shared.value)
        for batch in batches:
            n = pa.array([machine.count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["doc_id", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, tokens bigint")


def decode_ids(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of each list of ids, decoded as a stream; null for null."""
    shared = _share(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shared.value)
        for batch in batches:
            texts = pa.array([None if x is None else machine.decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string")


def _share(spark: SparkSession, path: str | None):  # noqa: ANN202
    return spark.sparkContext.broadcast(load_vocabulary(path))
