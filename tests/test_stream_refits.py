"""Refits of the stream side by side: fewer fits in a row, the same rows, also where refits fail."""

import numpy as np
import pandas as pd
import pytest

from tidemark import GPSpec, OnlineSpec, SeriesSpec
from tidemark.functions import gp as numerics
from tidemark.streaming import online

SPEC = SeriesSpec(keys=("series_id",), season=12, step="month")
GP = GPSpec(kernel=(("constant", "periodic"), ("white",)), period=12, alpha=1e-3)


SEED = 4


class Held:
    exists = False

    def update(self, value):
        self.get, self.exists = value, True


def outputs(rng, cuts=(83,)):
    y = 1e5 * (1 + 0.3 * np.sin(np.arange(83) / 6 * np.pi)) + rng.normal(0, 3e4, 83)
    y[50:] *= 1.5
    rows = pd.DataFrame({"series_id": "a", "t": np.arange(83), "y": y, "x": [[float(i)] for i in range(83)]})
    step, state = online._stepper(SPEC, OnlineSpec(cf_thr_perc=70).resolved(12), GP, 48, 1, 0, None), Held()
    return pd.concat([out for a, b in zip((0, *cuts), cuts) for out in step(("a",), iter([rows[a:b]]), state)], ignore_index=True)


@pytest.mark.parametrize("failing", [(), (0,), (1, 3)])
def test_refits_side_by_side_equal_those_one_by_one(monkeypatch, failing):
    plain, calls = numerics.fit_starts, []
    alone = outputs(np.random.default_rng(SEED), tuple(range(48, 84)))
    sizes = alone.loc[alone["triggered"], "t"].to_numpy()[list(failing)] + 1

    def counted(kernel, sets, *rest):
        calls.append(len(sets))
        if any(len(y) in sizes for _, y in sets):
            raise ValueError("no fit")
        return plain(kernel, sets, *rest)

    monkeypatch.setattr(numerics, "fit_starts", counted)
    alone = outputs(np.random.default_rng(SEED), tuple(range(48, 84)))  # a row at a time
    calls.clear()
    together = outputs(np.random.default_rng(SEED))
    assert np.allclose(alone.pop("score"), together.pop("score"), equal_nan=True)  # of a row and of many: equal to rounding
    pd.testing.assert_frame_equal(alone, together, check_exact=True)
    assert together["triggered"].sum() > 3
    if not failing:
        assert calls == [1, together["triggered"].sum()]
