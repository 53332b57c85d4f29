"""Control charts over a stream of distances, with state per key.

A micro-batch is put in order of its sequence number inside each key; a point
that comes after a later one was charted is late, and is returned as skipped,
not charted and not dropped.  State per key: four numbers and the last sequence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUT = "key string, seq long, x double, i long, z double, c_plus double, c_minus double, beyond boolean, signal boolean, skipped boolean"
STATE = "i long, z double, c_plus double, c_minus double, last long"


def step(state: tuple, x: float, mu0: float, sigma0: float, lam: float, width: float, k: float, h: float) -> tuple[tuple, tuple]:
    """(next state, chart values) after one point."""
    i, z, up, down, _ = state
    z = lam * x + (1 - lam) * z
    s = (x - mu0) / sigma0
    up, down = max(0.0, up + s - k), max(0.0, down - s - k)
    half = width * sigma0 * math.sqrt(lam / (2 - lam) * (1 - (1 - lam) ** (2 * (i + 1))))
    return (i + 1, z, up, down, 0), (i, z, up, down, abs(z - mu0) > half, up > h or down > h)


def chart(stream: DataFrame, mu0: float, sigma0: float, lam: float = 0.2, width: float = 3.0, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """stream: key string, seq long, x double (streaming or not)."""
    if not sigma0 > 0:
        raise ValueError("a null without spread can't calibrate a chart")

    def run(key: tuple, parts: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        state = tuple(kept.get) if kept.exists else (0, mu0, 0.0, 0.0, -(2**62))
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        out = []
        for seq, x in zip(rows["seq"].tolist(), rows["x"].tolist(), strict=True):
            if seq <= state[4] or x is None or not math.isfinite(x):
                out.append((key[0], seq, x, None, None, None, None, None, None, True))
                continue
            nxt, values = step(state, x, mu0, sigma0, lam, width, k, h)
            state = (*nxt[:4], seq)
            out.append((key[0], seq, x, *values, False))
        kept.update(state)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        yield frame.astype({"i": "Int64", "beyond": "boolean", "signal": "boolean"})

    return stream.select("key", "seq", "x").groupBy("key").applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")
