"""User functions over windows, dates and tickers, for what built-ins cannot express."""
from __future__ import annotations

from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from .scan import key_of, key_starts


def rolling_apply(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], x: str, n: int, out: str, keys: Sequence[str] = ("ticker",),
                  order: Sequence[str] = ("date",)) -> DataFrame:
    """``f`` on all windows of n values at once: ``f(matrix)`` takes one row per window and returns one value each.

    Series stream in order; the last ``n - 1`` values of a batch go on to the next, so a window may cross batches
    and memory is a batch. Null before n values and where a window holds an unknown value; ``f`` never sees those.
    """
    keys, names = list(keys), df.columns
    at = names.index(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, edge = None, np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(at).to_numpy(zero_copy_only=False).astype(float)
            starts, result = key_starts(batch, keys), np.full(batch.num_rows, np.nan)
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
                now = key_of(batch, keys, lo)
                line = np.concatenate((edge if now == key else np.zeros(0), values[lo:hi]))
                if len(line) >= n:
                    windows = sliding_window_view(line, n)
                    known = ~np.isnan(windows).any(axis=1)
                    got = np.full(len(windows), np.nan)
                    if known.any():
                        got[known] = f(windows[known])
                    tail = min(len(got), hi - lo)
                    result[hi - tail:hi] = got[-tail:]
                key, edge = now, line[-(n - 1):] if n > 1 else line[:0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result, mask=np.isnan(result))], names=[*names, out])

    schema = ", ".join([*[f"`{k}` {t}" for k, t in df.dtypes], f"`{out}` double"])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def per_date(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` on the cross-section of each date; a group is one date's names."""
    return df.groupBy("date").applyInPandas(f, schema)


def per_ticker(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` on each ticker's history in date order; a group is at most one row per trading day."""
    return df.groupBy("ticker").applyInPandas(lambda pdf: f(pdf.sort_values("date")), schema)
