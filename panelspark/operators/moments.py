"""Counts, means and centred co-moments of many columns in one pass, merged pair by pair.

A partition turns every Arrow batch into one matrix product of columns less the batch's means; two states are
merged by their counts and the gap between their means. Raw sums of squares never occur, so columns whose mean
is far larger than their deviation keep their digits. A mean is kept as a place (``origin``) and a small rest.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
_FIELDS = ("origin", "n", "mean", "co", "var")
_SCHEMA = "segment long, " + ", ".join(f"{f} array<double>" for f in _FIELDS)


@dataclass
class CoMoments:
    """Moments of every pair of K columns over the rows where both are known; all but ``origin`` are K x K.

    ``mean[i, j]`` and ``var[i, j]`` (summed squares) belong to column i over the rows of the pair (i, j); means
    are relative to ``origin[i]``.
    """

    origin: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    co: np.ndarray
    var: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> CoMoments:
        """Moments of the rows of ``x``; NaN is unknown."""
        known = ~np.isnan(x)
        count = known.sum(axis=0)
        origin = np.where(known, x, 0.0).sum(axis=0) / np.maximum(count, 1)
        z = np.where(known, x - origin, 0.0)
        m = known.astype(float)
        n = m.T @ m
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(n > 0, (z.T @ m) / n, 0.0)
        return cls(origin, n, mean, z.T @ z - n * mean * mean.T, (z * z).T @ m - n * mean * mean)

    def merge(self, other: CoMoments) -> CoMoments:
        n = self.n + other.n
        gap = other.mean - self.mean + (other.origin - self.origin)[:, None]
        gap = np.where(other.n > 0, gap, 0.0)
        both = np.divide(self.n * other.n, n, out=np.zeros_like(n), where=n > 0)
        share = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        return CoMoments(self.origin, n, self.mean + gap * share, self.co + other.co + gap * gap.T * both, self.var + other.var + gap * gap * both)

    def corr(self) -> np.ndarray:
        """Pearson correlations; NaN for under two common rows or no deviation."""
        scale = np.sqrt(self.var) * np.sqrt(self.var.T)
        out = np.divide(self.co, scale, out=np.full_like(self.co, np.nan), where=(self.n > 1) & (scale > 0))
        return np.clip(out, -1.0, 1.0)


def co_moments(panel: DataFrame, columns: Sequence[str], segment: str | None = None) -> DataFrame:
    """One row per segment: ``(segment, origin, n, mean, co, var)``, matrices flattened row by row.

    Tasks merge their batches to one state a segment, so a hot segment sends as little as any other; the states
    of a segment stream through one merging task, which holds one state at a time. Null segments form none.
    """
    k = len(columns)

    def state(row) -> CoMoments:
        origin, *rest = (np.array(x, float) for x in row)
        return CoMoments(origin, *[x.reshape(k, k) for x in rest])

    def rows(states: dict[int, CoMoments]) -> Iterator[pa.RecordBatch]:
        for s, m in states.items():
            arrays = [pa.array([getattr(m, f).ravel().tolist()], pa.list_(pa.float64())) for f in _FIELDS]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), *arrays], names=["segment", *_FIELDS])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, CoMoments] = {}
        for b in batches:
            if not b.num_rows:
                continue
            seg = b.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([col.to_numpy(zero_copy_only=False) for col in b.columns[1:]])
            for s in np.unique(seg).tolist():
                m = CoMoments.of(x[seg == s])
                states[s] = states[s].merge(m) if s in states else m
        yield from rows(states)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, CoMoments] = {}
        for b in batches:
            for i in range(b.num_rows):
                s, *row = (col[i].as_py() for col in b.columns)
                m = state(row)
                states[s] = states[s].merge(m) if s in states else m
        yield from rows(states)

    key = c(segment).cast("long") if segment else F.lit(0).cast("long")
    source = panel.select(key.alias("_s"), *[c(x).cast("double").alias(f"_{i}") for i, x in enumerate(columns)]).where("_s IS NOT NULL")
    return source.mapInArrow(partial, _SCHEMA).repartition("segment").mapInArrow(merged, _SCHEMA)


def collect_co_moments(panel: DataFrame, columns: Sequence[str], segment: str | None = None) -> dict[int, CoMoments]:
    """States of all segments on the driver: (segments) x 4 K^2 numbers, fixed by folds and columns."""
    k, out = len(columns), {}
    for row in co_moments(panel, columns, segment).toLocalIterator():
        origin, *rest = (np.array(row[f], float) for f in _FIELDS)
        out[row.segment] = CoMoments(origin, *[x.reshape(k, k) for x in rest])
    return out


def greedy_prune(corr: np.ndarray, features: Sequence[str], threshold: float = 0.9) -> list[str]:
    """Keep a feature when no feature kept before it is closer than the threshold; an undefined one is too close."""
    kept: list[int] = []
    for j in range(len(features)):
        if all(abs(corr[j, k]) <= threshold for k in kept):
            kept.append(j)
    return [features[j] for j in kept]
