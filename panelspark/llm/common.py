"""Helpers the operators of this folder share: shared folders, checkpoints, groups in sorted streams."""
from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.session import shared_folder


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, which is never copied here; ``TOKENIZERS_DIR`` names another folder of them."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers
    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one written intermediate table, below the folder the cluster shares."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once below the shared folder and read again: lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(id_col: str) -> Column:
    """True for the quarter of the ids that models never learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces: only a piece at a time becomes Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; a null text is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Column arrays of successive key runs, some whole groups at a time, from batches sorted by ``keys``.

    Yields ``(bounds, *columns)``; group ``i`` is ``[bounds[i], bounds[i + 1])``, and the last bound is the end. A run that crosses a batch
    border is held back until it ends, so a group is never cut; the caller bounds the group size.
    """
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys + columns]
        if kept is not None:
            now = [np.concatenate(x) for x in zip(kept, now)]
        change = np.zeros(len(now[0]) - 1, bool)
        for k in range(len(keys)):
            change |= now[k][1:] != now[k][:-1]
        starts = np.flatnonzero(change) + 1
        last = int(starts[-1]) if len(starts) else 0
        kept = [x[last:] for x in now]
        if last:
            yield (np.concatenate(([0], starts)), *[x[:last] for x in now[len(keys):]])
    if kept is not None and len(kept[0]):
        yield (np.array([0, len(kept[0])]), *kept[len(keys):])
