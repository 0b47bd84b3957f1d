"""Centroid clustering over a vector-approximation file.

A block of vectors is one row: ids, squared norms, a cell of few bits per vector and dimension, the smallest and
largest value of each cell, and the full vectors. Squared distances are ``|x|^2 + |c|^2 - 2 c.x``: norms are exact,
and a table per centroid, dimension and cell bounds the last term, so 64 lookups give the distance an interval. A
centroid whose interval starts above the end of another one is out; full vectors are fetched from the block, and
distances to the centroids left worked out, only where intervals overlap.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import sliced, stored

#: Bits of a cell, and vectors of one block.
BITS, BLOCK = 6, 4096
#: Integer components beyond this have squared distances that a 64-bit integer does not hold.
LARGEST = 1 << 27
_BLOCKS = "ids array<{id}>, norms binary, cells binary, low binary, high binary, vectors binary"


def whole_vectors(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors, and their components as ``floor(scale * x)`` in 64-bit integers."""
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dims)
    if not len(rows):
        return rows, np.zeros((0, dims), np.int64)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    values = np.floor(scale * flat.reshape(-1, dims))  # a null component is not a number here
    with np.errstate(invalid="ignore"):
        sound = (np.abs(values) <= LARGEST).all(axis=1)
    return rows[sound], values[sound].astype(np.int64)


def make_block(vectors: np.ndarray, bits: int) -> tuple[bytes, ...]:
    """Norms, packed cells, cell borders and full vectors; cells hold about equally many values each."""
    n, dims = vectors.shape
    ordered = np.sort(vectors, axis=0)
    starts = ordered[(np.arange(1, 1 << bits) * n) >> bits]  # first value of each cell but the lowest
    cells = np.empty((n, dims), np.uint8)
    low, high = np.zeros((dims, 1 << bits), np.int32), np.zeros((dims, 1 << bits), np.int32)
    for d in range(dims):
        cells[:, d] = np.searchsorted(starts[:, d], vectors[:, d], side="right")
        used, at = np.unique(np.searchsorted(starts[:, d], ordered[:, d], side="right"), return_index=True)
        low[d, used] = ordered[at, d]
        high[d, used] = ordered[np.append(at[1:], n) - 1, d]
    packed = np.packbits((cells[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1)
    return (vectors * vectors).sum(axis=1).tobytes(), packed.tobytes(), low.tobytes(), high.tobytes(), vectors.astype("<i4").tobytes()


def vector_blocks(vectors: DataFrame, dims: int = 64, scale: int = 1024, bits: int = BITS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The approximation file of a table: rows of up to 4,096 vectors, each task its own."""

    def run(batches):
        for b in sliced(batches, BLOCK):
            rows, values = whole_vectors(b.column(1), dims, scale)
            if len(rows):
                parts = [pa.array([x], pa.binary()) for x in make_block(values, bits)]
                ids = b.column(0).take(pa.array(rows))
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([listed, *parts], names=["ids", "norms", "cells", "low", "high", "vectors"])

    return vectors.select(id_col, vector_col).mapInArrow(run, _BLOCKS.format(id=dict(vectors.dtypes)[id_col]))


class Block:
    """One row of the file; cells and full vectors stay packed until they are asked for."""

    def __init__(self, batch: pa.RecordBatch, row: int, dims: int, bits: int):
        self.ids = batch.column(0)[row].values
        data = [batch.column(i)[row].as_buffer() for i in range(1, 6)]
        self.dims, self.bits = dims, bits
        self.norms = np.frombuffer(data[0], np.int64)
        self.packed = np.frombuffer(data[1], np.uint8)
        self.low, self.high = (np.frombuffer(x, np.int32).reshape(dims, 1 << bits).astype(np.int64) for x in data[2:4])
        self.full = np.frombuffer(data[4], "<i4").reshape(-1, dims)

    def fetch(self, rows: np.ndarray) -> np.ndarray:
        return self.full[rows].astype(np.int64)

    def intervals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance of every vector to every centroid that its cells allow."""
        n, width = len(self.norms), 1 << self.bits
        bits = np.unpackbits(self.packed, count=n * self.dims * self.bits).reshape(n, self.dims, self.bits)
        cells = (bits << np.arange(self.bits, dtype=np.uint8)).sum(axis=2, dtype=np.int64)
        place = cells + np.arange(self.dims) * width
        least, most = np.empty((n, len(centroids)), np.int64), np.empty((n, len(centroids)), np.int64)
        for k, c in enumerate(centroids):
            a, b = -2 * c[:, None] * self.low, -2 * c[:, None] * self.high
            base = self.norms + (c * c).sum()
            least[:, k] = base + np.minimum(a, b).ravel()[place].sum(axis=1)
            most[:, k] = base + np.maximum(a, b).ravel()[place].sum(axis=1)
        return least, most

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, int]:
        """Number of the nearest centroid (of equal ones the smallest), and how many vectors had to be fetched."""
        least, most = self.intervals(centroids)
        possible = least <= most.min(axis=1)[:, None]
        found = possible.argmax(axis=1)
        open_rows = np.flatnonzero(possible.sum(axis=1) > 1)
        if len(open_rows):
            vectors = self.fetch(open_rows)
            exact = np.full((len(open_rows), len(centroids)), np.iinfo(np.int64).max)
            for k, c in enumerate(centroids):
                some = np.flatnonzero(possible[open_rows, k])
                gap = vectors[some] - c
                exact[some, k] = (gap * gap).sum(axis=1)
            found[open_rows] = exact.argmin(axis=1)
        return found, len(open_rows)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, bits: int) -> Iterator[Block]:
    for b in batches:
        for row in range(b.num_rows):
            yield Block(b, row, dims, bits)


def _cluster_sums(blocks: DataFrame, centroids: np.ndarray, bits: int) -> dict[int, list[int]]:
    """Count and componentwise sum of the vectors nearest to each centroid: at most ``k (dims + 1)`` numbers arrive."""
    k, dims = centroids.shape

    def run(batches):
        total = np.zeros((k, dims + 1), np.int64)
        for block in _blocks(batches, dims, bits):
            found, _ = block.nearest(centroids)
            for c in np.unique(found):
                rows = np.flatnonzero(found == c)
                total[c, 0] += len(rows)
                total[c, 1:] += block.full[rows].sum(axis=0, dtype=np.int64)
        used = np.flatnonzero(total[:, 0])
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used, dims + 1).astype(np.int32)), pa.array(np.tile(np.arange(dims + 1), len(used)).astype(np.int32)), pa.array(total[used].ravel())],
                names=["cluster", "place", "value"])

    sums: dict[int, list[int]] = {}
    rows = blocks.mapInArrow(run, "cluster int, place int, value long").groupBy("cluster", "place").agg(F.sum("value").alias("value"))
    for row in rows.collect():
        sums.setdefault(row.cluster, [0] * (dims + 1))[row.place] = row.value
    return sums


def first_centroids(vectors: DataFrame, k: int, seed: int, dims: int, scale: int, id_col: str, vector_col: str) -> np.ndarray:
    """The usable vectors with the ``k`` smallest SHA-256 of ``seed:id``; equal ids go by their components."""
    usable = vectors.where((F.size(vector_col) == dims) & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * scale > LARGEST)))
    keyed = usable.where(F.col(id_col).isNotNull()).select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).alias("h"), F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
    rows = keyed.orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, dims)


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, bits: int = BITS,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every usable vector, in whole numbers.

    A vector is usable with exactly ``dims`` components, none null or non-finite (or so large that its squared
    distances leave the 64-bit range: ``scale * |x|`` beyond 2^27); others give no row. Rounds move every centroid
    to the rounded-down mean of its vectors; one without vectors stays. Equal distances go to the smaller number.
    Vectors with a null id are clustered but start no centroid; repeated ids are separate vectors; fewer usable
    ids than ``k`` give fewer centroids; none give no rows. Each round is one pass over the stored blocks, and only
    counts and sums of ``k`` clusters leave it. The rounds add whole vectors and the last pass measures them all,
    so what the cells save is distance work, not reading.
    """
    centroids = first_centroids(vectors, k, seed, dims, scale, id_col, vector_col)
    kind = dict(vectors.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, cluster int, distance long"
    if not len(centroids):
        out = vectors.sparkSession.createDataFrame([], schema)
        return out.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    blocks = stored(vector_blocks(vectors, dims, scale, bits, id_col, vector_col), "blocks")
    for _ in range(rounds):
        for c, (count, *sums) in _cluster_sums(blocks, centroids, bits).items():
            centroids[c] = [s // count for s in sums]

    def run(batches):
        for block in _blocks(batches, dims, bits):
            found, _ = block.nearest(centroids)
            gap = block.full.astype(np.int64) - centroids[found]
            yield pa.RecordBatch.from_arrays(
                [block.ids, pa.array(found.astype(np.int32)), pa.array((gap * gap).sum(axis=1))], names=[id_col, "cluster", "distance"])

    rows = stored(blocks.mapInArrow(run, schema), "clustered")
    inertia = {r.cluster: r.inertia for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    table = [(c, inertia.get(c, 0), sum(inertia.values()), sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    of_cluster = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of_cluster), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
