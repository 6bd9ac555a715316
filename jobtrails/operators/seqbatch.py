"""Arrow-batched per-sequence processing for the iterative models.

``by_sequence`` lays a long ``(seq, pos, ...)`` table out so that every
sequence sits whole and contiguous inside one partition (hash partitioning
on the key, then a sort within partitions).  ``whole_sequences`` re-cuts the
Arrow batches that ``mapInPandas`` hands over into complete sequences,
carrying a sequence that straddles two batches over to the next one -- so a
task never holds more than one batch plus one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def by_sequence(df: DataFrame, seq: str, pos: str, partitions: int | None = None) -> DataFrame:
    d = df.repartition(partitions, seq) if partitions else df.repartition(seq)
    return d.sortWithinPartitions(seq, pos)


def whole_sequences(batches: Iterator[pd.DataFrame], seq: str) -> Iterator[pd.DataFrame]:
    """Yield one DataFrame per complete sequence."""
    carry: pd.DataFrame | None = None
    for pdf in batches:
        if carry is not None and len(carry):
            pdf = pd.concat([carry, pdf], ignore_index=True)
        if not len(pdf):
            continue
        cut = _tail_start(pdf[seq].to_numpy())
        body, carry = pdf.iloc[:cut], pdf.iloc[cut:]
        for _, g in body.groupby(seq, sort=False):
            yield g
    if carry is not None and len(carry):
        for _, g in carry.groupby(seq, sort=False):
            yield g


def _tail_start(keys: np.ndarray) -> int:
    """Index where the run of the last key starts (keys are contiguous)."""
    other = np.flatnonzero(keys != keys[-1])
    return int(other[-1]) + 1 if len(other) else 0


def seeded_rng(*parts: int) -> np.random.Generator:
    """A generator determined by (seed, iteration, sequence id, ...): results
    do not depend on how sequences are spread over partitions."""
    return np.random.default_rng([int(p) & 0xFFFFFFFF for p in parts])


# ---------------------------------------------------------------- log-gamma
_HALF_LOG_2PI = 0.5 * np.log(2.0 * np.pi)


def lgamma(x) -> np.ndarray:
    """Vectorised ln Gamma(x) for x > 0: shift up to >= 15 with the
    recurrence, then the Stirling series (error < 1e-15 relative)."""
    y = np.array(x, dtype=float, copy=True)
    acc = np.zeros_like(y)
    small = y < 15.0
    while small.any():
        acc[small] += np.log(y[small])
        y[small] += 1.0
        small = y < 15.0
    inv = 1.0 / y
    inv2 = inv * inv
    series = inv * (1.0 / 12 - inv2 * (1.0 / 360 - inv2 * (1.0 / 1260 - inv2 * (1.0 / 1680 - inv2 / 1188))))
    return (y - 0.5) * np.log(y) - y + _HALF_LOG_2PI + series - acc
