"""Runs of equal keys inside sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd


def map_sorted_groups(
    batches: Iterator[pd.DataFrame], keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame]
) -> Iterator[pd.DataFrame]:
    """Apply ``fn`` to each run of equal keys of a sorted partition; runs may cross batch borders."""
    parts: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        cuts = _starts(batch, keys)
        if parts and _same(parts[-1], batch, keys):
            head = cuts[1] if len(cuts) > 1 else len(batch)
            parts.append(batch.iloc[:head])
            cuts = cuts[1:]
            if not len(cuts):
                continue
        done = [pd.concat(parts)] if parts else []
        done += [batch.iloc[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        parts = [batch.iloc[cuts[-1] :]]
        out = [fn(g) for g in done]
        if out:
            yield pd.concat(out, ignore_index=True)
    if parts:
        yield fn(pd.concat(parts)).reset_index(drop=True)


def _starts(batch: pd.DataFrame, keys: list[str]) -> np.ndarray:
    changed = np.zeros(len(batch), dtype=bool)
    changed[0] = True
    for k in keys:
        v = batch[k].to_numpy()
        changed[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(changed)


def _same(before: pd.DataFrame, batch: pd.DataFrame, keys: list[str]) -> bool:
    return all(before[k].iloc[-1] == batch[k].iloc[0] for k in keys)
