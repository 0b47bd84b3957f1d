"""Repeated word sequences across documents, by prefix-partitioned suffix trees.

The suffixes of all texts are cut to ``min_words`` words: removal only asks for nodes at that depth. A suffix is
a string of one-byte word symbols, eight at most, and a 64-bit fingerprint of all its words for the path below
them. Symbol strings are split into ranges, so that every range of prefixes (of whatever length it takes) fits a task; a task reads its range in order,
which is the subtree laid out by depth, and the common prefix of neighbours gives the internal nodes. A node
as deep as ``min_words`` holds the documents that share a sequence.

Two steps keep the tree small. Each window of words has a sampled anchor (the least hash of its 5-word
sequences); a window can only be repeated where its anchor occurs in another document, so suffixes without such
an anchor are left out. And what a block of documents can settle among its own documents, it settles before the
shuffle: a passage found in a third of all documents reaches the tree once for each block.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import sliced, sorted_groups, text_bytes

#: Words of an anchor, and entries a block of documents gathers before it settles what it can.
ANCHOR, BLOCK = 5, 400_000
_SYMBOLS = 8
_MULT = np.random.default_rng(2).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ASK, _TOLD, _KNOWN = 0, 1, 2


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sequence_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of the ``length`` words from each position on, as signed longs."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total += (hashes[k:k + n] ^ _MULT[-1 - k // 64 % 64]) * _MULT[k % 64]
    total ^= total >> np.uint64(31)
    return (total * _MULT[63]).view(np.int64)


def window_anchors(hashes: np.ndarray, min_words: int) -> np.ndarray:
    """The least anchor hash of each window of ``min_words`` words."""
    grams = sequence_hashes(hashes, min(ANCHOR, min_words))
    span = min_words - min(ANCHOR, min_words) + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    for k in range(1, span):
        np.minimum(least, grams[k:k + n], out=least)
    return least


def _settled(values: list[np.ndarray], docs: list[tuple[int, int]], smallest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What one block asks and knows: ``(value, doc, kind)``, from distinct values of each document.

    A value of one document is asked. A value of several goes out once, for its smallest document, and is known
    for the others; the smallest one asks too if ``smallest`` (is there a smaller one elsewhere?), else it is known.
    """
    value = np.concatenate(values)
    doc = np.repeat(np.array([d for d, _ in docs], np.int64), [n for _, n in docs])
    order = np.lexsort((doc, value))
    value, doc = value[order], doc[order]
    first = np.concatenate(([True], value[1:] != value[:-1]))
    alone = first & np.concatenate((first[1:], [True]))
    if smallest:
        # an id may occur twice: rows of the smallest document itself are not known to be repeated
        least = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
        keep = first | (doc > least)
        return value[keep], doc[keep], np.where(first[keep], _ASK, _KNOWN).astype(np.int8)
    told = first & ~alone
    kind = np.where(alone, _ASK, _KNOWN).astype(np.int8)
    return (np.concatenate((value, value[told])), np.concatenate((doc, doc[told])), np.concatenate((kind, np.full(told.sum(), _TOLD, np.int8))))


def _blocks(batches, each, smallest: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    values, docs, size = [], [], 0
    for b in sliced(batches):
        for doc, found in each(b):
            if len(found):
                values.append(found)
                docs.append((doc, len(found)))
                size += len(found)
            if size >= BLOCK:
                yield _settled(values, docs, smallest)
                values, docs, size = [], [], 0
    if size:
        yield _settled(values, docs, smallest)


def _shared_anchors(texts: DataFrame, min_words: int) -> DataFrame:
    """``(doc, value)``: anchors of each document that occur in another one too."""
    def anchors(b):
        for doc, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
            yield doc, np.unique(window_anchors(word_hashes(text.split()), min_words))

    def emit(batches):
        for value, doc, kind in _blocks(batches, anchors, False):
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(doc), pa.array(kind)], names=["value", "doc", "kind"])

    def judge(batches):
        for bounds, value, doc, kind in sorted_groups(batches, ["value"], ["value", "doc", "kind"]):
            starts = bounds[:-1]
            shared = (np.add.reduceat((kind != _KNOWN).astype(np.int64), starts) > 1) | np.add.reduceat((kind == _TOLD).astype(np.int64), starts).astype(bool)
            out = (np.repeat(shared, np.diff(bounds)) & (kind == _ASK)) | (kind == _KNOWN)
            yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(value[out])], names=["doc", "value"])

    rows = texts.mapInArrow(emit, "value long, doc long, kind byte")
    # what is known needs no meeting place: it is spread
    place = F.when(F.col("kind") == _KNOWN, F.xxhash64("value", "doc")).otherwise(F.col("value"))
    return rows.repartition(place).sortWithinPartitions("value").mapInArrow(judge, "doc long, value long")


def path_symbols(hashes: np.ndarray, length: int) -> np.ndarray:
    """The first symbols of each sequence of ``length`` words, packed in order into a signed long."""
    n = len(hashes) - length + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(min(length, _SYMBOLS) if n > 0 else 0):
        total |= (hashes[k:k + n] >> np.uint64(56)) << np.uint64(56 - 8 * k)
    return total.view(np.int64)


def node_depths(symbols: np.ndarray, prints: np.ndarray, min_words: int) -> np.ndarray:
    """Depth in words of the common prefix of each suffix with the one before it, both sorted.

    Equal fingerprints are the full depth; else the symbols in common, at most one less than that.
    """
    differ = (symbols[1:] ^ symbols[:-1]).view(np.uint64)
    common = np.full(len(differ), _SYMBOLS)
    for k in range(_SYMBOLS - 1, -1, -1):
        common[(differ >> np.uint64(56 - 8 * k)) & np.uint64(255) != 0] = k
    return np.where((differ == 0) & (prints[1:] == prints[:-1]), min_words, np.minimum(common, min_words - 1))


def _repeats(texts: DataFrame, min_words: int) -> DataFrame:
    """``(doc, value)``: fingerprints of windows of ``texts(doc, text, shared)`` that start in a smaller document too."""
    def emit(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # distinct windows of a document, until its block is settled

        def windows(b):
            for doc, text, shared in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist()):
                hashes = word_hashes(text.split())
                live = np.flatnonzero(np.isin(window_anchors(hashes, min_words), np.array(shared, np.int64)))
                prints, first = np.unique(sequence_hashes(hashes, min_words)[live], return_index=True)
                held.append((prints, path_symbols(hashes, min_words)[live][first]))
                yield doc, prints

        for value, doc, kind in _blocks(batches, windows, True):
            prints, symbols = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(prints, kind="stable")
            symbols = symbols[order][np.searchsorted(prints[order], value)]
            # what is known needs no place in the tree: it is spread by fingerprint and document
            symbols = np.where(kind == _KNOWN, ((value.view(np.uint64) ^ doc.view(np.uint64)) * _MULT[5]).view(np.int64), symbols)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(symbols), pa.array(value), pa.array(doc), pa.array(kind)], names=["symbols", "value", "doc", "kind"])

    def subtree(batches):
        for bounds, symbols, value, doc, kind in sorted_groups(batches, ["symbols", "value"], ["symbols", "value", "doc", "kind"]):
            known = kind == _KNOWN
            out_doc, out_value = [doc[known]], [value[known]]
            leaves = np.flatnonzero(~known)
            if len(leaves):
                v, d = value[leaves], doc[leaves]
                new = np.concatenate(([True], node_depths(symbols[leaves], v, min_words) < min_words))  # else a leaf of the node before
                node = np.cumsum(new) - 1
                least = np.minimum.reduceat(d, np.flatnonzero(new))
                later = d > least[node]
                out_doc.append(d[later])
                out_value.append(v[later])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_value))], names=["doc", "value"])

    rows = texts.mapInArrow(emit, "symbols long, value long, doc long, kind byte")
    return rows.repartitionByRange("symbols", "value").sortWithinPartitions("symbols", "value").mapInArrow(subtree, "doc long, value long")


def covered(hashes: np.ndarray, repeated: np.ndarray, min_words: int) -> np.ndarray:
    """Which words lie in a window whose fingerprint is among ``repeated``."""
    mark = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(np.isin(sequence_hashes(hashes, min_words), repeated))
    np.add.at(mark, at, 1)
    np.add.at(mark, at + min_words, -1)
    return np.cumsum(mark[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` of each row: its words less those in a window repeated from a smaller id.

    Words are what ASCII white space separates. A window is ``min_words`` successive words; it counts as
    repeated if the same words start anywhere in a document with a smaller id, judged on the input. ``kept`` has
    the other words joined by one space. Texts equal to one with a smaller id are settled by their digest and
    stay out of the trees. Null and empty texts have no words; texts shorter than a window lose none; rows with
    a null id are left out; rows of one id are no repeats of each other; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    # every join below takes these same rows by id, so the texts are shuffled once
    digests = rows.where("text <> ''").select(F.sha2("text", 256).alias("digest"), "id")
    first = digests.groupBy("digest").agg(F.min("id").alias("first"))
    copies = digests.join(first, "digest").where("id > first").groupBy("id").agg(F.collect_set("digest").alias("copies"))
    marked = rows.join(copies, "id", "left")
    single = marked.where("copies is null or not array_contains(copies, sha2(text, 256))").select("id", "text")
    anchors = _shared_anchors(single, min_words).groupBy("doc").agg(F.collect_set("value").alias("shared"))
    likely = rows.join(anchors, rows.id == anchors.doc).select("id", "text", "shared")
    repeats = _repeats(likely, min_words).groupBy("doc").agg(F.collect_set("value").alias("repeated"))

    def run(batches):
        for b in sliced(batches):
            out = []
            for text, copy, repeated in zip(text_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = text.split()
                kept = words
                if copy and len(words) >= min_words:
                    kept = []
                elif repeated:
                    gone = covered(word_hashes(words), np.array(repeated, np.int64), min_words)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
            n, removed, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "n_removed", "kept"])

    copied = F.coalesce(F.expr("array_contains(copies, sha2(text, 256))"), F.lit(False)).alias("copy")
    joined = marked.join(repeats, marked.id == repeats.doc, "left").select("id", "text", copied, "repeated")
    return joined.mapInArrow(run, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)
