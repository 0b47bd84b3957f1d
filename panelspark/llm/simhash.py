"""Near-duplicate texts by SimHash fingerprints, found on pigeonhole blocks."""
from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import sliced, sorted_groups, stored, text_bytes
from .components import connected_components

SEED = 42
#: Most fingerprints of one block key that a task compares; larger groups are split by further blocks.
GROUP = 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLANE = (np.arange(8) * 256)[None, :]


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0] + [e + 1 for e in ends[: max(0, len(words) - shingle)]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1:])], dtype="<u8")
    planes = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLANE).ravel(), minlength=2048).reshape(8, 256)
    votes = (planes @ _BITS).ravel()  # of bit 0 to 63
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp)`` of every row, the fingerprint as a signed long with the same bits. Null text: fingerprint zero."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in sliced(batches):
            fp = np.array([fingerprint(t, shingle) for t in text_bytes(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def block_bounds(low: int, high: int, blocks: int) -> list[tuple[int, int]]:
    cuts = [low + (high - low) * k // blocks for k in range(blocks + 1)]
    return list(zip(cuts, cuts[1:]))


def _cut(bits: list[int], blocks: int) -> list[list[int]]:
    return [bits[a:b] for a, b in block_bounds(0, len(bits), blocks)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def block_masks(seen: int, distance: int, blocks: int) -> list[int]:
    """Masks of the bit blocks that are equal for some choice when two values differ in ``distance`` bits at most.

    ``seen`` has the bits known to be equal; the other bits are cut into ``blocks`` pieces, of which at least
    ``blocks - distance`` are equal. The masks contain ``seen``.
    """
    free = [b for b in range(64) if not (seen >> b) & 1]
    pieces = [p for p in _cut(free, blocks) if p]
    return [_mask([b for p in some for b in p]) | seen for some in combinations(pieces, max(0, len(pieces) - distance))]


def _spanning(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (first found, other) that join what is connected by steps of ``distance`` bits at most."""
    out, rest = [], values
    while len(rest):
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for k in range(0, len(front), 64):
                near |= (np.bitwise_count(front[k:k + 64, None] ^ rest[None, :]) <= distance).any(axis=0)
            front, rest = rest[near], rest[~near]
            out += [(int(root), int(x)) for x in front]
    return out


def _links(keyed: DataFrame, distance: int) -> DataFrame:
    def run(batches):
        for bounds, fp in sorted_groups(batches, ["mask", "block"], ["fp"]):
            starts, sizes, values = bounds[:-1], np.diff(bounds), fp.view(np.uint64)
            two = starts[sizes == 2]
            near = two[np.bitwise_count(values[two] ^ values[two + 1]) <= distance]
            found = [(fp[near], fp[near + 1])]
            for a, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                pairs = np.array(_spanning(values[a:a + n], distance), dtype=np.uint64).reshape(-1, 2).view(np.int64)
                found.append((pairs[:, 0], pairs[:, 1]))
            a, b = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    together = keyed.repartition("mask", "block").sortWithinPartitions("mask", "block")
    return together.mapInArrow(run, "a long, b long")


def near_links(fps: DataFrame, distance: int = 4, blocks: int = 6, group: int = GROUP) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of distinct ``fp`` at ``distance`` bits or fewer.

    Values that close agree on ``blocks - distance`` of the blocks at least, so each value goes to one key per
    choice of that many blocks. A key with more than ``group`` values is split by cutting the bits its values
    may still differ in once more; each level fixes a third of them, so no key stays large: at the last level
    a key leaves fewer than log2(group) bits free. ``group`` must hold the values of ``distance`` free bits.
    """
    if group < 1 << distance:
        raise ValueError(f"a group of {group} cannot hold {1 << distance} values")
    level = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in block_masks(0, distance, blocks)])).alias("mask"))
    level = level.withColumn("block", F.col("fp").bitwiseAND(F.col("mask")))
    found = None
    while True:
        large = stored(level.groupBy("mask", "block").count().where(F.col("count") > group).drop("count"), "large-blocks")
        whole = large.isEmpty()
        links = _links(level if whole else level.join(large, ["mask", "block"], "left_anti"), distance)
        found = links if found is None else found.unionByName(links)
        if whole:
            return found
        masks = [r.mask for r in large.select("mask").distinct().collect()]  # a fixed number for each level
        finer = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(k) for k in block_masks(m, distance, blocks)]))])
        level = level.join(large, ["mask", "block"], "left_semi").select("fp", F.explode(finer[F.col("mask")]).alias("mask")).distinct()
        level = stored(level.withColumn("block", F.col("fp").bitwiseAND(F.col("mask"))), "finer-blocks")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row with an id: near-duplicate classes of whole texts.

    Texts with the same fingerprint collapse before anything is joined, so a group of copies counts as one
    value however large it is. Null and empty texts share fingerprint zero. Rows with a null id give no row;
    repeated ids give one row for each distinct fingerprint; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle).where("id is not null").distinct(), "fingerprints")
    values = prints.groupBy("fp").agg(F.min("id").alias("least"))
    classes = connected_components(near_links(values.select("fp"), distance))
    named = values.join(classes, values.fp == classes.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # a fingerprint may hold a third of the rows: the join is a plain one, which is split at run time
    member = named.join(smallest, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(member, "fp").select(F.col("id").alias(id_col), hexed, "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns kept, of one document of each near-duplicate class: the smallest id.

    Rows of one id are one document and go or stay together, by the smallest class of their fingerprints;
    rows with a null id stay.
    """
    classes = simhash_components(docs, id_col, text_col, shingle, distance)
    gone = classes.groupBy(id_col).agg(F.min("component_id").alias("_first")).where(F.col("_first") < F.col(id_col)).select(F.col(id_col).alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
