"""Byte-pair encoding by segment trees over the ranks of adjacent pairs, and decoding.

A word starts as one symbol per byte. Leaf ``i`` of its tree holds ``rank << bits | i`` of the pair that starts at
symbol ``i``, so the root names the lowest rank and, among equal ones, the leftmost pair. A merge changes three
leaves (the pair, its right neighbour's and its left neighbour's) and the nodes above them, ``3 log n`` in all;
encoding ends when the root holds no pair. New words of a slice of documents go through their trees together, one
row of an array each; a long word walks its own tree.
"""
from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import sliced, text_bytes

#: Words one generation of a worker's cache holds.
GENERATION = 100_000
#: Words of more bytes than this walk their tree alone; entries of the arrays that a batch of words takes.
LONG_WORD, BATCH = 256, 1 << 17
NONE = np.int64(1) << 62
#: The id that stands for a line end between pieces; no vocabulary reaches it.
MARK = b"\xff\xff\xff\xff"
#: Characters on whose classes, case and composition Python and the tokenizers library agree one by one.
_PLAIN = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
#: Pattern of a byte-level splitter that brings none of its own (fixed value).
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is one, else the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in own)}
    return [chr(rest.get(b, b)) for b in range(256)]


class BpeModel:
    """Vocabulary, merges and splitting rules of a definition in the JSON form of the tokenizers library.

    Reads byte-level models that split by one pattern, with or without a mark at word ends, with lower-casing and
    composition as the only normalisers; other definitions raise. The object is small and goes to the workers.
    """

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, self.definition = spec["model"], definition
        vocabulary = model["vocab"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain byte-pair models are read")
        rules = spec["normalizer"]["normalizers"] if spec.get("normalizer") and spec["normalizer"]["type"] == "Sequence" else [spec.get("normalizer")]
        if not {r["type"] for r in rules if r} <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalisers not known: {rules}")
        self.lower = any(r and r["type"] == "Lowercase" for r in rules)
        cutters = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        split = next((c for c in cutters if c["type"] == "Split"), None)
        if not any(c["type"] == "ByteLevel" and not c["add_prefix_space"] for c in cutters) or (split and not (split["invert"] and split["behavior"] == "Removed")):
            raise ValueError("only byte-level models without a prefix space are read")
        self.pattern = split["pattern"]["Regex"] if split else _BYTE_LEVEL
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.joins_bytes = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        letters, end = byte_letters(), model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocabulary[x] for x in letters], np.int64)
        self.last = np.array([vocabulary[x + end] for x in letters], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([[vocabulary[a], vocabulary[b], vocabulary[a + b]] for a, b in merges], np.int64).reshape(-1, 3)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), pairs[order, 2]
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.pieces: list[bytes | None] = [None] * size
        known = {x: bytes([b]) for b, x in enumerate(letters)}
        for piece, i in vocabulary.items():
            self.pieces[i] = b"".join(known.get(c, c.encode()) for c in piece) if self.joins_bytes else piece.encode()
        for content, i in self.special.items():
            self.pieces[i] = content.encode()

    # -- splitting

    @cached_property
    def _find(self) -> Callable[[str], list[str]]:
        return regex.compile(self.pattern).findall

    @cached_property
    def _ascii_pattern(self) -> str:
        """The same pattern for ASCII texts, whose letters, numbers and spaces the standard library knows too."""
        out, inside, i = [], False, 0
        while i < len(self.pattern):
            two, one = self.pattern[i:i + 5], self.pattern[i]
            if two in (r"\p{L}", r"\p{N}"):
                plain = "A-Za-z" if two == r"\p{L}" else "0-9"
                out.append(plain if inside else f"[{plain}]")
                i += 5
                continue
            step = 2 if one == "\\" else 1
            inside = True if one == "[" else False if one == "]" else inside
            out.append(self.pattern[i:i + step])
            i += step
        return "".join(out)

    @cached_property
    def _find_ascii(self) -> Callable[[str], list[str]]:
        return re.compile(self._ascii_pattern, re.ASCII).findall

    @cached_property
    def _find_lines(self) -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
        """Words and line ends, of texts with other characters and of ASCII texts."""
        return regex.compile(f"{self.pattern}|\n").findall, re.compile(f"{self._ascii_pattern}|\n", re.ASCII).findall

    @cached_property
    def _cut(self) -> re.Pattern | None:
        return re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    @cached_property
    def library(self):
        """The tokenizers library's reading of the definition, for texts whose characters it may class differently."""
        from tokenizers import Tokenizer
        return Tokenizer.from_str(self.definition)

    @cached_property
    def drops_spaces(self) -> bool:
        """Does white space only separate words?"""
        return not any(c.isspace() for w in self._find(" a  b\t\n1 .\r\v\f'! ") for c in w)

    def words(self, text: str) -> list[str]:
        """Words of one text; a special token is a word of its own."""
        if self._cut is not None and "<" in text and self._cut.search(text):
            return [w for part in self._cut.split(text) for w in ([part] if part in self.special else self.words(part))]
        if text.isascii():
            return self._find_ascii(text.lower() if self.lower else text)
        if not _PLAIN.search(text):
            return self._find(text.lower() if self.lower else text)
        library, back = self.library, {x: b for b, x in enumerate(byte_letters())}
        normal = library.normalizer.normalize_str(text) if library.normalizer else text
        return [bytes(back[c] for c in w).decode() for w, _ in library.pre_tokenizer.pre_tokenize_str(normal)]

    def words_of_lines(self, lines: list[bytes]) -> list[str] | None:
        """Words of texts without white space, a line end after those of each, for a model whose words hold none.

        None if the texts hold a special token or characters that the library has to split.
        """
        text = b"\n".join([*lines, b""]).decode()
        if "<" in text and self._cut is not None and self._cut.search(text) or not text.isascii() and _PLAIN.search(text):
            return None
        return self._find_lines[text.isascii()](text.lower() if self.lower else text)

    # -- merging

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` where the two never merge) and merged symbol of pairs."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def _symbols(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, np.uint8)
        return np.concatenate((self.inner[raw[:-1]], self.last[raw[-1:]]))

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of words of at most ``2 ** k`` bytes, all trees in one array; the longest gives ``k``."""
        if not len(self.keys):
            return [self._symbols(w).astype("<u4").tobytes() for w in words]
        lengths = np.array([len(w) for w in words])
        bits = max(1, int(lengths.max() - 1).bit_length())
        size, n = 1 << bits, len(words)
        symbols = np.zeros((n, size + 2), np.int64)  # column size: no symbol; column size + 1 takes what nobody reads
        inside = np.arange(size) < lengths[:, None]
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols[:, :size][inside] = self.inner[raw]
        rows = np.arange(n)
        symbols[rows, lengths - 1] = self.last[raw[np.cumsum(lengths) - 1]]
        place = np.arange(size + 2)
        after = np.where(place[None, :] + 1 < lengths[:, None], place + 1, size)
        before = np.broadcast_to(np.where(place > 0, place - 1, size + 1), (n, size + 2)).copy()
        tree = np.full((n, 2 * size), NONE)
        r, k = np.nonzero(inside[:, 1:])
        rank, _ = self._rank(symbols[r, k], symbols[r, k + 1])
        tree[r, size + k] = np.where(rank < NONE, rank << bits | k, NONE)
        for level in range(bits - 1, -1, -1):
            nodes = np.arange(1 << level, 2 << level)
            tree[:, nodes] = np.minimum(tree[:, 2 * nodes], tree[:, 2 * nodes + 1])
        alive = inside
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            i = tree[rows, 1] & (size - 1)
            j, left = after[rows, i], before[rows, i]
            symbols[rows, i] = self._rank(symbols[rows, i], symbols[rows, j])[1]
            beyond = after[rows, j]
            after[rows, i], before[rows, beyond] = beyond, i
            alive[rows, j] = False
            # the leaves of the pair, of its left neighbour and of the symbol that is gone; then all above them
            rank, _ = self._rank(symbols[rows, i], symbols[rows, beyond])
            tree[rows, size + i] = np.where((beyond < size) & (rank < NONE), rank << bits | i, NONE)
            tree[rows, size + j] = NONE
            some = np.flatnonzero(left < size)
            rank, _ = self._rank(symbols[rows[some], left[some]], symbols[rows[some], i[some]])
            tree[rows[some], size + left[some]] = np.where(rank < NONE, rank << bits | left[some], NONE)
            nodes = np.stack((i, j, np.where(left < size, left, i))) + size
            for _ in range(bits):
                nodes >>= 1
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
            rows = rows[tree[rows, 1] < NONE]
        flat, ends = symbols[:, :size][alive].astype("<u4").tobytes(), (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    @cached_property
    def _pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))

    def merge_long_word(self, word: bytes) -> np.ndarray:
        """Ids of one word of any length by its own tree."""
        symbols, n, pairs, none = self._symbols(word).tolist(), len(word), self._pairs, int(NONE)
        bits = max(1, (n - 1).bit_length())
        size = 1 << bits
        after, before, tree = list(range(1, n + 1)), list(range(-1, n - 1)), [none] * (2 * size)

        def leaf(i: int) -> None:
            j = after[i]
            known = pairs.get(symbols[i] << 32 | symbols[j]) if j < n else None
            tree[size + i] = known[0] << bits | i if known else none

        def climb(i: int) -> None:
            node = (size + i) >> 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
                node >>= 1

        for i in range(n):
            leaf(i)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            i = tree[1] & (size - 1)
            j = after[i]
            symbols[i] = pairs[symbols[i] << 32 | symbols[j]][1]
            symbols[j], after[i], tree[size + j] = -1, after[j], none
            if after[i] < n:
                before[after[i]] = i
            leaf(i)
            climb(j)
            climb(i)
            if before[i] >= 0:
                leaf(before[i])
                climb(before[i])
        return np.array([s for s in symbols if s >= 0], np.int64)

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of words as little-endian 32-bit integers, words of like length together."""
        out: list[bytes] = [b""] * len(words)
        raw = [w.encode() for w in words]
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if w in self.special:
                out[k] = np.array([self.special[w]], "<u4").tobytes()
            elif len(raw[k]) > LONG_WORD:
                out[k] = self.merge_long_word(raw[k]).astype("<u4").tobytes()
            else:
                by_size.setdefault(max(3, (len(raw[k]) - 1).bit_length()), []).append(k)
        for bits, members in by_size.items():
            step = BATCH >> bits
            for at in range(0, len(members), step):
                some = members[at:at + step]
                for k, ids in zip(some, self.merge_words([raw[k] for k in some])):
                    out[k] = ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes joined (broken ones replaced) or pieces joined by a space; unknown ids count as none."""
        kept = [p for i in ids if 0 <= i < len(self.pieces) and (p := self.pieces[i]) is not None]
        return b"".join(kept).decode("utf-8", "replace") if self.joins_bytes else b" ".join(kept).decode()


class Cache:
    """Values of keys a worker has met, in two generations: when one is full, it becomes the older and that one goes."""

    def __init__(self, learn: Callable[[list], list[bytes]], most: int = GENERATION):
        self.learn, self.most = learn, most
        self.young: dict = {}
        self.old: dict = {}

    def join(self, lists: list[list]) -> list[bytes]:
        """The values of each list of keys, joined; keys not met yet are learnt together."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = set().union(*lists).difference(young)
        fresh = missing.difference(old)
        young.update([(k, old[k]) for k in missing - fresh])
        new = list(fresh)
        young.update(zip(new, self.learn(new)))
        get = young.__getitem__
        return [b"".join(map(get, keys)) for keys in lists]


class TextEncoder:
    """Ids of texts as little-endian 32-bit integers, through ``learn``, which gives the ids of new words.

    Where no word holds white space, a text is cut at ASCII spaces first and such a piece is split into words only
    when it is new; capitals of ASCII make no difference to a model in lower case, but for its special tokens.
    """

    def __init__(self, model: BpeModel, learn: Callable[[list[str]], list[bytes]]):
        self.model, self.learn = model, learn
        self.words = Cache(self._learn_words if model.drops_spaces else learn)
        self.pieces = Cache(self._learn_pieces)

    def _learn_words(self, words: list[str]) -> list[bytes]:
        if "\n" not in words:
            return self.learn(words)
        at = words.index("\n")
        ids = self.learn(words[:at] + words[at + 1:])
        return [*ids[:at], MARK, *ids[at:]]

    def _learn_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """New pieces of a kind are split in one call; where that cannot be, each one by itself."""
        known: dict[bytes, bytes] = {}
        for some in ([p for p in pieces if p.isascii()], [p for p in pieces if not p.isascii()]):
            words = self.model.words_of_lines(some)
            if words is None:
                apart = [self.model.words_of_lines([p]) is None for p in some]
                alone = [p for p, x in zip(some, apart) if x]
                known.update(zip(alone, self.words.join([self.model.words(p.decode()) for p in alone])))
                some = [p for p, x in zip(some, apart) if not x]
                words = self.model.words_of_lines(some)
            flat = self.words.join([words])[0]
            ends = (4 * np.flatnonzero(np.frombuffer(flat, "<u4") == 0xFFFFFFFF)).tolist()
            known.update(zip(some, [flat[a:b] for a, b in zip([0, *[x + 4 for x in ends]], ends)]))
        return [known[p] for p in pieces]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.model.drops_spaces:
            return self.words.join([self.model.words(t.decode()) for t in texts])
        fold = self.model.lower
        return self.pieces.join([(t.lower() if fold and b"<" not in t else t).split() for t in texts])


_WORKERS: dict[tuple, TextEncoder] = {}


def worker_encoder(definition: str, learner: Callable[[BpeModel], Callable[[list[str]], list[bytes]]] | None = None) -> TextEncoder:
    """The encoder of this worker process; ``learner`` makes the function that gives ids, by default the segment trees."""
    key = (hash(definition), learner)
    if key not in _WORKERS:
        _WORKERS.clear()
        model = BpeModel(definition)
        _WORKERS[key] = TextEncoder(model, learner(model) if learner else model.ids_of)
    return _WORKERS[key]


def id_lists(flat: list[bytes]) -> pa.ListArray:
    """Ids of documents as an Arrow list column, from their little-endian 32-bit integers."""
    ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in flat]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), "<i4")))


def encode_bpe(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, n_tokens, decoded)`` of each document; ``decoded`` is the text its ids stand for.

    No row moves: each partition encodes its own documents, and its worker keeps the ids of words it met. Null
    and empty texts have no ids and an empty decoded text; repeated rows and null ids stay rows; other columns
    are not read; an empty table gives no rows. Texts are encoded whole, however long a word is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        encoder = worker_encoder(shared.value)
        model = encoder.model
        for b in sliced(batches, 400):
            flat = encoder.encode(text_bytes(b.column(1)))
            ids = id_lists(flat)
            decoded = [model.decode(np.frombuffer(x, "<i4").tolist()) for x in flat]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), ids, pa.array([len(x) // 4 for x in flat], pa.int64()), pa.array(decoded, pa.string())], names=[id_col, "ids", "n_tokens", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens long, decoded string")


def decode_bpe(encoded: DataFrame, definition: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, decoded)`` of rows of ids; null ids and an empty list give an empty text, ids beyond the vocabulary nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(definition)
    kind = dict(encoded.dtypes)[id_col]

    def run(batches):
        model = worker_encoder(shared.value).model
        for b in sliced(batches, 100):
            texts = [model.decode([i for i in x or [] if i is not None]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded string")
