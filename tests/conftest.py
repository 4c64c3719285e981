import datetime as dt
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from candlespan.session import build_session  # noqa: E402

START = dt.date(2020, 1, 1)


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def frame(close, high=None, low=None, open_=None, volume=100_000, symbol="S", start=START):
    close = np.asarray(close, dtype=float)
    n = len(close)
    return pd.DataFrame({
        "symbol": symbol, "date": [start + dt.timedelta(days=i) for i in range(n)],
        "open": close if open_ is None else np.asarray(open_, float), "high": close * 1.005 if high is None else np.asarray(high, float),
        "low": close * 0.995 if low is None else np.asarray(low, float), "close": close,
        "volume": np.broadcast_to(np.asarray(volume, dtype=np.int64), n).copy(),
    })


def bars(spark, *frames):
    return spark.createDataFrame(pd.concat(frames), "symbol string, date date, open double, high double, low double, close double, volume long")


def legs(points, steps):
    out = []
    for a, b in zip(points, points[1:]):
        out.extend(np.linspace(a, b, steps, endpoint=False))
    return np.array([*out, points[-1]])


def walk(seed, n, symbol="S"):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    high, low = close + rng.uniform(0.1, 1, n), close - rng.uniform(0.1, 1, n)
    return frame(close, high, low, volume=rng.integers(1_000, 9_000, n), symbol=symbol)
