"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is normaliser, then pieces with byte fallback: an arc reads a piece and writes its id (or reads
a character without a piece and writes its bytes). Composed with an input it is a lattice, and the encoding is
the path of least weight in the tropical semiring. In a unigram model an arc weighs minus the piece's score.
In a byte-pair model scores are merge ranks, not costs; there an arc weighs 0 if merging the previous piece
and this one together gives back exactly these two, and is infinite (left out) otherwise. A sequence is the
result of the merges just when all its neighbours pass that test, so a single path of weight 0 is left.
"""
from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import sliced

SPACE = "▁"
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: Encoded segments and tested neighbours a worker keeps, half of them in an older generation: what is met
#: again moves to the younger one, what is not goes when that one is full.
CACHE, FITS = 150_000, 400_000


def _fields(data: bytes):
    """Field number and value of a protocol buffer message; messages stay bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at:at + size]
        at += size


@dataclass(frozen=True)
class PieceModel:
    """What a model file holds; small enough to go to every task (a vocabulary)."""
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    add_dummy_prefix: bool
    remove_extra_whitespaces: bool
    digest: str

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, scores, types, trainer, normalizer = [], [], [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                types.append(piece.get(3, _NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2):
            raise ValueError("only the identity normaliser is supported, this model has a character map")
        if trainer.get(3, _UNIGRAM) not in (_UNIGRAM, _BPE) or 4 in types:
            raise ValueError("only unigram and byte-pair models without user-defined pieces are supported")
        return cls(pieces, scores, types, trainer.get(3, _UNIGRAM), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)),
                   hashlib.sha256(data).hexdigest())

    def transducer(self) -> Transducer:
        """One transducer for each worker process, so its caches outlive a task."""
        if self.digest not in _COMPILED:
            _COMPILED.clear()
            _COMPILED[self.digest] = Transducer(self)
        return _COMPILED[self.digest]


def _linked(pieces) -> list[list[str]]:
    """Sets of characters that stand side by side in a piece, directly or through others, the largest first."""
    beside: dict[str, set[str]] = {}
    for p in pieces:
        for x, y in zip(p, p[1:]):
            beside.setdefault(x, set()).add(y)
            beside.setdefault(y, set()).add(x)
    sets, seen = [], set()
    for c in sorted(beside):
        if c not in seen:
            seen.add(c)
            found = [c]
            for x in found:
                found += sorted(beside[x] - seen)
                seen |= beside[x]
            sets.append(found)
    return sorted(sets, key=len, reverse=True)


#: More than any id and, below zero, any code point: makes one key of two ids.
_PAIR = 1 << 22


class Transducer(dict):
    """Encoded segments by segment (ids as 32-bit integers), found on first use."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model
        self.ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == _NORMAL}
        self.ranks = {p: model.scores[i] for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == _BYTE}
        #: Reads every piece of an input in one pass, by end and then longest first.
        self.reader = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.reader.add_word(piece, (len(piece), i))
        self.reader.make_automaton()
        self.single = frozenset(p for p in self.ids if len(p) == 1)
        self._merges: dict[int, tuple] = {}
        self._fits: dict[int, bool] = {}
        self._older: dict[str, bytes] = {}
        self._older_fits: dict[int, bool] = {}
        self.segments = self._splitter()

    def _splitter(self) -> re.Pattern:
        """Cuts a normalised text where no piece reaches across: before space marks, around ASCII characters
        that only stand alone, and between scripts, which are the large sets of characters that pieces link by
        holding them side by side (letters of one alphabet, marks of punctuation)."""
        longer = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            return re.compile(".+", re.S)
        joined = {c for p in longer for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        scripts = [re.escape("".join(x)) for x in _linked(p.lstrip(SPACE) for p in longer) if len(x) > 8]
        runs = "|".join([f"[{x}]+" for x in scripts] + [f"[^{SPACE}{alone}{''.join(scripts)}]+"])
        only = f"[{alone}]|" if alone else ""
        return re.compile(f"{only}{SPACE}*(?:{runs})|{SPACE}+")

    def normalized(self, text: str) -> str:
        if self.model.remove_extra_whitespaces:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.model.add_dummy_prefix else "") + text.replace(" ", SPACE)

    def __missing__(self, segment: str) -> bytes:
        if len(self) >= CACHE // 2:
            self._older = dict(self)
            self.clear()
        ids = self._older.get(segment)
        if ids is not None:
            self[segment] = ids
            return ids
        path = self.shortest_path(segment)
        out = []
        for code in path:
            if code >= 0:
                out.append(code)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in chr(-2 - code).encode()]
            else:
                out.append(self.model.types.index(_UNKNOWN))
        self[segment] = ids = np.array(out, "<i4").tobytes()
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        found = self.segments.findall(self.normalized(text or ""))
        return np.frombuffer(b"".join(map(self.__getitem__, found)), "<i4")

    def lattice(self, s: str):
        """The transducer composed with an input: its arcs as last character, (length, id), by end and then
        longest first. A character that is no piece is an arc of its own, numbered -2 minus its code point."""
        if self.single.issuperset(s):
            return self.reader.iter(s)
        strange = [(i, (1, -2 - ord(c))) for i, c in enumerate(s) if c not in self.single]
        return sorted([*self.reader.iter(s), *strange], key=lambda arc: (arc[0], -arc[1][0]))

    def shortest_path(self, s: str) -> list[int]:
        """Ids along the path of least weight; of equal weights the one with the longest last piece."""
        n = len(s)
        last, lengths = [-1] * (n + 1), [0] * (n + 1)
        if self.model.kind == _UNIGRAM:
            scores, unknown = self.model.scores, 10.0 - min(self.model.scores)
            weight = [0.0] + [float("inf")] * n
            for end, (length, t) in self.lattice(s):
                new = weight[end + 1 - length] + (unknown if t < 0 else -scores[t])
                if new < weight[end + 1]:
                    weight[end + 1], last[end + 1], lengths[end + 1] = new, t, length
        else:  # weights are 0 or infinite, and one arc into each place has weight 0
            fits = self._fits
            done = -1
            for end, (length, t) in self.lattice(s):
                if end != done:
                    u = last[end + 1 - length]
                    fit = fits.get(u * _PAIR + t)
                    if self.fit(u, t) if fit is None else fit:
                        last[end + 1], lengths[end + 1], done = t, length, end
        path = []
        while n:
            path.append(last[n])
            n -= lengths[n]
        path.reverse()
        return path

    def _string(self, code: int) -> str:
        return self.model.pieces[code] if code >= 0 else chr(-2 - code) if code < -1 else ""

    def fit(self, u: int, t: int) -> bool:
        """Whether merging the text of the two gives these two; ``u`` is -1 at the start."""
        key = u * _PAIR + t
        fit = self._older_fits.get(key)
        if fit is None:
            fit = self._stay_apart(u, t)
        if len(self._fits) >= FITS // 2:
            self._older_fits = dict(self._fits)
            self._fits.clear()
        self._fits[key] = fit
        return fit

    def _stay_apart(self, u: int, t: int) -> bool:
        """Plays the merges of the two pieces against each other: the better score goes first, of equals the one
        further left. They stay two unless the pair across the border comes first at some time."""
        whole, right, _, rights = self._history(t)
        if u == -1 or not whole:
            return whole
        whole, _, left, lefts = self._history(u)
        if not whole:
            return False
        rank, never = self.ranks.get, float("-inf")
        end = ((never, "", ""),)
        lefts, rights = lefts + end, rights + end
        i = k = 0
        while True:
            across = rank(left + right, never)
            a, b = lefts[i][0], rights[k][0]
            if a >= across and a >= b and a > never:
                left = lefts[i][2]
                i += 1
            elif across >= b:
                return across == never
            else:
                right = rights[k][1]
                k += 1

    def _history(self, code: int) -> tuple:
        """Whether merging the text of a piece gives it back; its first and last character; its merges, each as
        score, first part and last part after it. Kept for each piece of the vocabulary."""
        found = self._merges.get(code)
        if found is None:
            text, steps = self._string(code), []
            found = (self.merged(text, steps) == [text], text[0], text[-1], tuple(steps))
            if code >= 0:
                self._merges[code] = found
        return found

    def merged(self, s: str, steps: list | None = None) -> list[str]:
        """Merges of a short string in order of score, the leftmost first; ``steps`` takes each score and state."""
        parts, ranks = list(s), self.ranks
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max((r for r in pairs if r is not None), default=None)
            if best is None:
                break
            at = pairs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if steps is not None:
                steps.append((best, parts[0], parts[-1]))
        return parts

    @cached_property
    def _output(self) -> list[bytes]:
        """What each id writes when read backwards; the piece for unknown text is set apart by spaces."""
        made = {_CONTROL: lambda p: b"", _UNKNOWN: lambda p: " ⁇ ".encode(), _BYTE: lambda p: bytes([int(p[3:5], 16)])}
        return [made.get(t, lambda p: p.replace(SPACE, " ").encode())(p) for p, t in zip(self.model.pieces, self.model.types)]

    def decode(self, ids) -> str:
        """Text of ids: the transducer read backwards, without the space that the normaliser put in front."""
        joined = b"".join(map(self._output.__getitem__, ids))
        text = joined.decode("utf-8", "replace")
        return text[1:] if self.model.add_dummy_prefix and text.startswith(" ") else text


_COMPILED: dict[str, Transducer] = {}


def load_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel.parse(f.read())


def encode(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, n_tokens, decoded)`` of every row: its ids, their number, and the text the ids stand for.

    ``decoded`` is the text after the normaliser, so with an identity normaliser the text itself. Null and
    empty texts have no ids and decode to an empty text. Null and repeated ids are kept as they are; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        machine = shared.value.transducer()
        for b in sliced(batches):
            found = [machine.encode(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), ids, pa.array(np.diff(ends).astype(np.int64)), pa.array([machine.decode(x.tolist()) for x in found], pa.string())],
                names=["id", "ids", "n_tokens", "decoded"])

    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of every row of ids; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        machine = shared.value.transducer()
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([machine.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    schema = T.StructType([T.StructField("id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
