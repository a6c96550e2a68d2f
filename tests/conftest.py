import os
import sys

# as in Spark's Python workers; many threads on small matrices only wait for each other
os.environ["OMP_NUM_THREADS"] = os.environ["OPENBLAS_NUM_THREADS"] = "1"

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", **{"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"})


@pytest.fixture()
def rng():
    return np.random.default_rng(7)


def series_frame(spark, values: dict, start="2020-01-01", freq="D"):
    """Long table of several series from lists; None is NULL."""
    import pandas as pd

    parts = []
    for key, y in values.items():
        ts = pd.date_range(start, periods=len(y), freq=freq)
        parts.append(pd.DataFrame({"series_id": key, "ts": ts, "t": range(len(y)), "y": y}))
    rows = [
        (r.series_id, r.ts.to_pydatetime(), int(r.t), None if r.y is None or r.y != r.y else float(r.y))
        for r in pd.concat(parts).sample(frac=1, random_state=1).itertuples()
    ]
    return spark.createDataFrame(rows, "series_id string, ts timestamp, t long, y double")


def by_series(df, *columns):
    """``{series: {column: values in order of t}}``."""
    rows = sorted(df.collect(), key=lambda r: (r.series_id, r.t))
    out = {}
    for row in rows:
        slot = out.setdefault(row.series_id, {c: [] for c in columns})
        for c in columns:
            slot[c].append(row[c])
    return out


def close(a, b, tolerance=1e-9):
    """Equal up to rounding, with None and NaN taken as the same."""
    a = np.array([np.nan if v is None else v for v in a], dtype=float)
    b = np.array([np.nan if v is None else v for v in b], dtype=float)
    return len(a) == len(b) and np.allclose(a, b, rtol=tolerance, atol=tolerance, equal_nan=True)
