"""Near-duplicate vectors by exact comparison in tiles."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import sorted_groups, stored
from .components import connected_components

#: Vectors of a tile in a small label, tiles a label has before they grow to ``TILES`` times that, and rows compared at once.
TILE, TILES, WINDOW = 1024, 16, 256


def _matrix(column: pa.Array | np.ndarray, dim: int) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(values)).reshape(-1, dim)


def _unit_vectors(vectors: DataFrame) -> DataFrame:
    """``(rep, label, copies, dim, unit)``: distinct usable vectors at length one, as doubles."""
    def run(batches):
        for b in batches:
            rows = [np.array(v, float) for v in b.column("v").to_pylist()]
            scaled = [v / np.abs(v).max() for v in rows]  # squares neither overflow nor vanish
            unit = [(v / np.sqrt(v @ v)).tobytes() for v in scaled]
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), b.column("label"), b.column("copies"), pa.array([len(v) for v in rows], pa.int32()), pa.array(unit, pa.binary())],
                names=["rep", "label", "copies", "dim", "unit"])

    return vectors.mapInArrow(run, "rep long, label string, copies long, dim int, unit binary")


def spanning_links(near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of links enough to join what ``near`` joins, each row and column reached once."""
    rows, columns = near.any(axis=1), near.any(axis=0)
    for first in np.flatnonzero(rows):
        if not rows[first]:
            continue
        rows[first] = False
        reached = np.array([first])
        while len(reached):
            ahead = np.flatnonzero(near[reached].any(axis=0) & columns)
            columns[ahead] = False
            yield reached[near[np.ix_(reached, ahead)].argmax(axis=0)], ahead
            reached = np.flatnonzero(near[:, ahead].any(axis=1) & rows)
            rows[reached] = False
            yield reached, ahead[near[np.ix_(reached, ahead)].argmax(axis=1)] if len(reached) else reached


def _compared(units: DataFrame, cosine: float, window: int, tile: int) -> DataFrame:
    """``(a, b, n)``: spanning links of every two tiles of a label, and with null ``b`` the linked vectors of ``a`` in them, copies counted."""
    tiles = F.greatest(F.ceil(F.count("*") / (TILES * tile)), F.least(F.ceil(F.count("*") / tile), F.lit(TILES))).cast("int")
    placed = units.join(units.groupBy("label", "dim").agg(tiles.alias("tiles")), ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "dim", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "copies", "unit")

    def run(batches):
        for bounds, d, x, y, own, rep, copies, unit in sorted_groups(batches, ["label", "dim", "x", "y"], ["dim", "x", "y", "own", "rep", "copies", "unit"]):
            for at, end in zip(bounds, bounds[1:]):
                u, r, n = _matrix(unit[at:end], int(d[at])), rep[at:end], copies[at:end]
                left = np.flatnonzero(own[at:end] == x[at])
                same = x[at] == y[at]
                right = left if same else np.flatnonzero(own[at:end] == y[at])
                counts = np.zeros(len(r), np.int64)
                other = u[right]
                for k in range(0, len(left), window):
                    rows = left[k:k + window]
                    near = u[rows] @ other.T >= cosine
                    if same:
                        near[np.arange(len(rows)), k + np.arange(len(rows))] = False
                    if not near.any():
                        continue
                    counts[rows] += near @ n[right]
                    if not same:
                        counts[right] += near.T @ n[rows]
                    i, j = (np.concatenate(c) for c in zip(*spanning_links(near)))
                    yield pa.RecordBatch.from_arrays([pa.array(r[rows[i]]), pa.array(r[right[j]]), pa.nulls(len(i), pa.int64())], names=["a", "b", "n"])
                some = counts > 0
                yield pa.RecordBatch.from_arrays([pa.array(r[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(counts[some])], names=["a", "b", "n"])

    order = ["label", "dim", "x", "y"]
    return pairs.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long, n long")


def vector_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                      cosine: float = 0.98, window: int = WINDOW, tile: int = TILE) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every vector with an id; links join equal labels at ``cosine`` or more.

    Equal vectors of one label collapse first. The distinct ones of a label are dealt to tiles, and every two
    tiles are compared in a task of their own, ``window`` rows at a time, so no link is missed however crowded a
    label is. The price is the square of the label: a vector is sent once per tile (at most ``TILES`` times up to
    ``TILES ** 2 * tile`` vectors, then once per ``TILES * tile``), and multiplied with all others of its label.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers, and null labels, link with nothing;
    so do vectors of different lengths. Rows with a null id give no row; of a repeated id each row counts as a
    vector. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label")).where("id is not null")
    usable = F.expr("label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    fit = rows.where(F.coalesce(usable, F.lit(False)))
    classes = stored(fit.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    units = stored(_unit_vectors(classes), "unit-vectors")
    compared = stored(_compared(units, cosine, window, tile), "compared-vectors")
    components = connected_components(compared.where("b is not null").select("a", "b"))
    others = compared.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    described = (
        classes.join(components.withColumnRenamed("node", "rep"), "rep", "left").join(others, "rep", "left")
        .select("label", "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = fit.join(described, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
