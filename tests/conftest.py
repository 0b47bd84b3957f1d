import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from panelspark.session import local_session
    return local_session(8, 4)


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture(scope="session")
def toy_bars(spark):
    """Four random walks of 420 business days, one starting late, with a flat stretch."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(5)
    days = pd.bdate_range("2020-01-01", periods=420)
    frames = []
    for k, name in enumerate("ABCD"):
        start = 60 if name == "D" else 0
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, len(days))))
        close[200:205] = close[199]
        spread = np.abs(rng.normal(0, 0.5, len(days))) + 0.1
        frames.append(pd.DataFrame({
            "date": days.date, "pos": np.arange(len(days)), "ticker": name, "open": close - spread / 3, "high": close + spread,
            "low": close - spread, "close": close, "volume": rng.integers(1, 100, len(days)).astype(float)}).iloc[start:])
    pdf = pd.concat(frames)
    return pdf, spark.createDataFrame(pdf).cache()
