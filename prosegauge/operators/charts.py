"""Control charts over streams of any length, in blocks.

A block of a stream maps the state before it to the state after it: the EWMA by
z -> a * z + b, each CUSUM side by c -> max(c + s, e).  So blocks are summed up
each for itself, the maps are applied in order (a few numbers per block), and
every block is charted from the state before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

BLOCK = 65_536
LAMBDA = 0.2
SLACK = 0.5
_OUT = "rid long, lang string, i long, doc_id long, x double, mu0 double, sigma0 double, z double, c_plus double, c_minus double"


def _steps(part: pd.DataFrame) -> np.ndarray:
    x, mu, sigma = (part[c].to_numpy(np.float64) for c in ("x", "mu0", "sigma0"))
    return np.divide(x - mu, sigma, out=np.zeros_like(x), where=sigma > 0)


def _walk(x: np.ndarray, s: np.ndarray, z: float, up: float, down: float) -> np.ndarray:
    out = np.empty((len(x), 3))
    for k, (v, u) in enumerate(zip(x.tolist(), s.tolist(), strict=True)):
        z = LAMBDA * v + (1 - LAMBDA) * z
        up, down = max(0.0, up + u - SLACK), max(0.0, down - u - SLACK)
        out[k] = z, up, down
    return out


def charted(stream: DataFrame, block: int = BLOCK) -> DataFrame:
    """stream (rid, lang, i, doc_id, x, mu0, sigma0; i is the place, from 0 without gaps) with z, c_plus, c_minus.  A stream without spread has no steps."""
    rows = written(stream.withColumn("block", F.floor(F.col("i") / block)), "stream")

    def sum_up(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        s, n = _steps(part), len(part)
        end = _walk(part["x"].to_numpy(), s, 0.0, 0.0, 0.0)[-1]
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "block": [part["block"].iloc[0]], "mu0": [part["mu0"].iloc[0]], "a": [(1 - LAMBDA) ** n], "b": [end[0]], "s_up": [s.sum() - SLACK * n], "e_up": [end[1]], "s_down": [-s.sum() - SLACK * n], "e_down": [end[2]]})

    def carry(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        z, up, down, out = blocks["mu0"].iloc[0], 0.0, 0.0, []
        for r in blocks.itertuples(index=False):
            out.append((r.lang, r.block, z, up, down))
            z, up, down = r.a * z + r.b, max(up + r.s_up, r.e_up), max(down + r.s_down, r.e_down)
        return pd.DataFrame(out, columns=["lang", "block", "z0", "up0", "down0"])

    def chart(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        got = _walk(part["x"].to_numpy(), _steps(part), part["z0"].iloc[0], part["up0"].iloc[0], part["down0"].iloc[0])
        return part[["rid", "lang", "i", "doc_id", "x", "mu0", "sigma0"]].assign(z=got[:, 0], c_plus=got[:, 1], c_minus=got[:, 2])

    sums = rows.groupBy("lang", "block").applyInPandas(sum_up, "lang string, block long, mu0 double, a double, b double, s_up double, e_up double, s_down double, e_down double")
    states = written(sums.groupBy("lang").applyInPandas(carry, "lang string, block long, z0 double, up0 double, down0 double"), "states")
    states = states.select(F.col("lang").alias("g"), F.col("block").alias("at"), "z0", "up0", "down0")
    both = rows.join(states, F.col("lang").eqNullSafe(F.col("g")) & (F.col("block") == F.col("at"))).drop("g", "at")
    return both.groupBy("lang", "block").applyInPandas(chart, _OUT)
