import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_bars(spark):
    """Bars from per-symbol lists of (open, high, low, close[, volume])."""

    def build(series, start=dt.date(2020, 1, 1)):
        from tidemark.operators.series import number_bars

        rows = []
        for symbol, bars in series.items():
            for i, b in enumerate(bars):
                o, h, l, c = (float(x) for x in b[:4])
                v = float(b[4]) if len(b) > 4 and b[4] is not None else (None if len(b) > 4 else 1000.0)
                day = start + dt.timedelta(days=i)
                rows.append((symbol, day, o, h, l, c, v, c * (1.0 if v is None else v), False, dt.datetime.combine(day, dt.time(15))))
        schema = "symbol string, session date, open double, high double, low double, close double, volume double, amount double, is_st boolean, available_at timestamp"
        return number_bars(spark.createDataFrame(rows, schema))

    return build


@pytest.fixture(scope="session")
def walk():
    """A reproducible price path: (open, high, low, close, volume) tuples."""
    import numpy as np

    def build(n, seed=1, start=50.0):
        rng = np.random.default_rng(seed)
        close = start * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * np.exp(rng.normal(0, 0.01, n))
        high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.02, n))
        low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.02, n))
        return list(zip(open_.tolist(), high.tolist(), low.tolist(), close.tolist(), rng.integers(100, 5000, n).tolist()))

    return build
