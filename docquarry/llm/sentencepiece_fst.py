"""SentencePiece encoding and decoding with weighted finite-state transducers.

A model file is compiled into three machines:

* the normaliser, a one-state transducer that rewrites spaces to the space mark
  and puts one mark in front of the text;
* the pieces, a transducer from characters to ids with one path a piece; the
  arcs carry minus the piece's score;
* the byte fallback, which reads a character no piece has and writes the ids of
  its UTF-8 bytes.

Each input is composed with them, and the shortest path in the tropical
semiring (least sum of weights) is the encoding.  For a unigram model that is
all.  A byte-pair model is not a sum of scores: its encoding is the only segmentation in
which every two neighbours are what merging their joined text gives.
So it has a fourth machine, an acceptor of piece pairs whose arcs weigh 0 where the
pair is such a pair and infinity elsewhere; pairs are decided when composition first meets
them.  A prefix then has at most one path of finite weight, and the search keeps
one state a position.

No piece goes on after a space mark inside it or holds a line feed, so an input is
composed in stretches between those, and the paths of common stretches are kept (a bounded memory
of the task, without effect on results).

Limits: the normaliser must be the identity rule (the charsmap of other rules is
refused), and control or user-defined pieces are never written.

Defined cases: NULL stays NULL in every result column; the empty text has no ids;
a space mark in the text decodes to a space, so ``round_trip`` is false there, as
for every text that does not come back unchanged.  Input columns named like a result are replaced.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import attach

MARK = "▁"
# Bounds of what a worker process remembers; most stretches of a corpus are rare.
REMEMBERED_STRETCHES = 300_000
REMEMBERED_PAIRS = 600_000
# Texts that are Python objects at once; a batch of Arrow rows may hold ten thousand whole documents.
SLICE_ROWS = 256
# A position of the text that no path has come to.
UNREACHED = -2
RESULT = "ids array<int>, decoded string, round_trip boolean"
FIELDS = ["ids", "decoded", "round_trip"]

# Fixed values of the model file format: field numbers and piece types.
PIECE_FIELD, TRAINER_FIELD, NORMALIZER_FIELD = 1, 2, 3
TEXT_FIELD, SCORE_FIELD, TYPE_FIELD = 1, 2, 3
MODEL_TYPE_FIELD = 3
CHARSMAP_FIELD, DUMMY_PREFIX_FIELD, TRIM_FIELD, ESCAPE_FIELD = 2, 3, 4, 5
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a serialised message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ((4 if kind == 5 else 8), at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PairAcceptor:
    """Which pieces may follow each other in a byte-pair encoding."""

    def __init__(self, scores: dict[str, float], texts: dict[int, str]):
        self.scores = scores
        self.texts = texts
        self.known: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored neighbours merge first, left ones on ties."""
        parts = list(text)
        while True:
            best, where = -math.inf, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, where = score, i
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def allows(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        answer = self.known.get(pair)
        if answer is None:
            if len(self.known) >= REMEMBERED_PAIRS:
                self.known.clear()
            texts = [self.texts[left], self.texts[right]]
            answer = self.known[pair] = self.merged(texts[0] + texts[1]) == texts
        return answer


class Transducer:
    """A compiled model."""

    def __init__(self, data: bytes):
        self.pieces: list[bytes] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.unknown = 0
        kind, normaliser = UNIGRAM, {}
        for number, value in _fields(data):
            if number == PIECE_FIELD:
                self._add(dict(_fields(value)))
            elif number == TRAINER_FIELD:
                kind = dict(_fields(value)).get(MODEL_TYPE_FIELD, UNIGRAM)
            elif number == NORMALIZER_FIELD:
                normaliser = dict(_fields(value))
        if normaliser.get(CHARSMAP_FIELD) or normaliser.get(TRIM_FIELD, 1):
            raise ValueError("only the identity normaliser is compiled")
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are compiled")
        self.prefix = MARK if normaliser.get(DUMMY_PREFIX_FIELD, 1) else ""
        self.escape = bool(normaliser.get(ESCAPE_FIELD, 1))
        self.has_bytes = any(self.byte_ids)
        self.worst = 10.0 - min(self.scores.values(), default=0.0)
        self.costs = {i: -self.scores[p] for p, i in self.ids.items()}
        self.pairs = None
        if kind == BPE:
            self.pairs = PairAcceptor(self.scores, {i: p for p, i in self.ids.items()})
        # From a character to the piece that ends there (UNREACHED for none) and the arcs after it.
        self.arcs: dict[str, list] = {}
        for text, number in self.ids.items():
            # A piece that merging never yields is on no byte-pair path.
            if self.pairs is None or self.pairs.merged(text) == [text]:
                node = self.arcs
                for char in text:
                    step = node.setdefault(char, [UNREACHED, {}])
                    node = step[1]
                step[0] = number
        inner = any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids)
        self.stretch = re.compile(
            ".+" if inner else f"\n|[^{MARK}\n]+|{MARK}+[^{MARK}\n]*", re.DOTALL
        )
        self.paths = _Paths(self)

    def _add(self, piece: dict) -> None:
        text, kind = piece[TEXT_FIELD].decode("utf-8"), piece.get(TYPE_FIELD, NORMAL)
        number = len(self.pieces)
        written = b""
        if kind == NORMAL:
            self.ids[text] = number
            self.scores[text] = struct.unpack("<f", piece[SCORE_FIELD])[0] if SCORE_FIELD in piece else 0.0
            written = text.replace(MARK, " ").encode("utf-8")
        elif kind == BYTE:
            value = int(text[3:-1], 16)
            self.byte_ids[value] = number
            written = bytes([value])
        elif kind == UNKNOWN:
            self.unknown = number
            written = " ⁇ ".encode("utf-8")
        self.pieces.append(written)

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        return (self.prefix + text).replace(" ", MARK) if self.escape else self.prefix + text

    def fallback(self, char: str) -> tuple[int, ...]:
        """Ids of a character that no piece has."""
        if not self.has_bytes:
            return (self.unknown,)
        return tuple(self.byte_ids[b] for b in char.encode("utf-8"))

    def shortest_path(self, text: str) -> tuple[int, ...]:
        """Ids on the path of least weight through ``text`` composed with the machines."""
        if self.pairs is not None:
            return self._merging_path(text)
        # Best state of each position: weight, id of the last piece (-1 for none or
        # for a fallback, which anything may follow) and where that piece starts.
        size = len(text)
        weights: list[float | None] = [0.0] + [None] * size
        lasts, starts = [-1] * (size + 1), [0] * (size + 1)
        costs = self.costs
        for start in range(size):
            weight = weights[start]
            if weight is None:
                continue
            node, end = self.arcs, start
            while end < size:
                step = node.get(text[end])
                if step is None:
                    break
                end += 1
                piece, node = step
                if piece >= 0 and (weights[end] is None or weight + costs[piece] < weights[end]):
                    weights[end], lasts[end], starts[end] = weight + costs[piece], piece, start
            if text[start] not in self.ids:
                passed = weight + self.worst
                if weights[start + 1] is None or passed < weights[start + 1]:
                    weights[start + 1], lasts[start + 1], starts[start + 1] = passed, -1, start
        return self._ids(text, lasts, starts)

    def _merging_path(self, text: str) -> tuple[int, ...]:
        """The path whose neighbours all merge; it is the only one, so the first to reach the end is it."""
        size = len(text)
        lasts, starts = [-1] + [UNREACHED] * size, [0] * (size + 1)
        known, allows = self.pairs.known, self.pairs.allows
        for start in range(size):
            last = lasts[start]
            if last == UNREACHED:
                continue
            node, end = self.arcs, start
            while end < size:
                step = node.get(text[end])
                if step is None:
                    break
                end += 1
                piece, node = step
                if piece >= 0 and lasts[end] == UNREACHED:
                    if last >= 0:
                        fits = known.get(last << 32 | piece)
                        if fits is None:
                            fits = allows(last, piece)
                        if not fits:
                            continue
                    lasts[end], starts[end] = piece, start
            if lasts[start + 1] == UNREACHED and text[start] not in self.ids:
                lasts[start + 1], starts[start + 1] = -1, start
            if lasts[size] != UNREACHED:
                break
        return self._ids(text, lasts, starts)

    def _ids(self, text: str, lasts: list[int], starts: list[int]) -> tuple[int, ...]:
        """The ids along the path that ends the text."""
        ids: list[int] = []
        at = len(text)
        while at > 0:
            found = lasts[at]
            at, end = starts[at], at
            ids.extend((found,) if found >= 0 else reversed(self.fallback(text[at:end])))
        return tuple(reversed(ids))

    def coded(self, text: str) -> tuple[bytes, bytes]:
        """The ids of a text as 32-bit numbers, and what they write."""
        # Ids and written bytes of a text are those of its stretches, one after the other.
        found = list(map(self.paths.__getitem__, self.stretch.findall(self.normalised(text))))
        return b"".join([ids for ids, _ in found]), b"".join([written for _, written in found])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.coded(text)[0], np.int32).tolist()

    def text_of(self, written: bytes) -> str:
        """The text of written bytes; bytes that are not UTF-8 become the replacement character."""
        if self.prefix and written[:1] == b" ":
            written = written[1:]
        return written.decode("utf-8", errors="replace")

    def decode(self, ids: list[int]) -> str:
        pieces = self.pieces
        return self.text_of(b"".join([pieces[i] for i in ids]))


class _Paths(dict):
    """(ids, written bytes) of stretches; short ones are remembered, up to a bound.

    When half of the bound is reached, the other half is forgotten, so stretches that come again stay.
    """

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine
        self.earlier: dict[str, tuple[bytes, bytes]] = {}

    def __missing__(self, stretch: str) -> tuple[bytes, bytes]:
        found = self.earlier.get(stretch)
        if found is None:
            ids = self.machine.shortest_path(stretch)
            found = array("i", ids).tobytes(), b"".join([self.machine.pieces[i] for i in ids])
        if len(stretch) <= 64:
            if len(self) >= REMEMBERED_STRETCHES // 2:
                self.earlier = dict(self)
                self.clear()
            self[stretch] = found
        return found


_COMPILED: dict[int, Transducer] = {}


def compiled(data: bytes) -> Transducer:
    """The compiled model; one is kept per worker process."""
    key = hash(data)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(data)
    return _COMPILED[key]


def load_model(path: str) -> bytes:
    """The model file's bytes, read on the driver; models are at most a few MB."""
    with open(path, "rb") as file:
        return file.read()


def coded_slices(machine: Transducer, columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``RESULT`` of the texts, an array for each slice of them."""
    for column in columns:
        for at in range(0, len(column), SLICE_ROWS):
            texts = column.slice(at, SLICE_ROWS).to_pylist()
            coded = [None if text is None else machine.coded(text) for text in texts]
            decoded = [None if c is None else machine.text_of(c[1]) for c in coded]
            same = [None if text is None else back == text for text, back in zip(texts, decoded)]
            lists = _list_array([None if c is None else c[0] for c in coded])
            yield pa.StructArray.from_arrays(
                [lists, pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], names=FIELDS
            )


def encode_documents(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``decoded`` and ``round_trip`` (decoded equals the text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def code(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from coded_slices(compiled(sent.value), columns)

    return attach(docs, F.arrow_udf(_typed(code), RESULT)(F.col(f"`{text_col}`")), FIELDS)


def _typed(code):
    """The function with the hints that mark it as an iterator UDF."""
    code.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return code


def _list_array(rows: list[bytes | None]) -> pa.Array:
    """Lists of packed 32-bit numbers as one array."""
    ends = np.cumsum([0] + [len(row or b"") // 4 for row in rows])
    missing = np.array([row is None for row in rows] + [False])
    values = pa.array(np.frombuffer(b"".join([row for row in rows if row]), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=missing), values)
