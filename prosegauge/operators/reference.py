"""Reference distributions: fit in one aggregate pass, project, measure, route.

Moments and the feature covariance come from one aggregate over the corpus;
only that matrix (features squared) reaches the driver, where its eigenvectors
are taken.  A reference is a small dictionary, so measuring against several is a
row expression with literals and shuffles nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(df: DataFrame, features: list[str], name: str, components: int = 4) -> dict:
    """Reference of the rows whose features are all finite; features without spread are screened out."""
    ok = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(F.col(f)) for f in features])
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features]).where(ok)
    moments = rows.agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m{k}") for k, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{k}") for k, f in enumerate(features)]).first()
    if moments["n"] < 2:
        raise ValueError(f"{name}: fewer than two measurable documents")
    pairs = _pairs(features)
    cov = rows.agg(*[F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return _reference(moments.asDict() | cov.asDict(), features, name, components)


def fit_groups(df: DataFrame, features: list[str], by: str, components: int = 4) -> list[dict]:
    """A reference of each value of a column; null values and groups of fewer than two measurable rows or without spread get none.

    One aggregate gives the moments.  Products of standardised features are then
    summed up per group inside every Arrow batch, so what is shuffled is one
    matrix per group and partition, and what the driver gets one per group.
    """
    ok = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(F.col(f)) for f in features])
    rows = df.where(F.col(by).isNotNull()).select(F.col(by).cast("string").alias("g"), *[F.col(f).cast("double").alias(f) for f in features]).where(ok)
    moments = [c for k, f in enumerate(features) for c in (F.avg(f).alias(f"m{k}"), F.stddev_pop(f).alias(f"s{k}"))]
    found = {r["g"]: r.asDict() for r in rows.groupBy("g").agg(F.count("*").alias("n"), *moments).where("n >= 2").collect()}
    found = {g: r for g, r in found.items() if any(r[f"s{k}"] > 0 for k in range(len(features)))}
    centre = {g: (np.array([r[f"m{k}"] for k in range(len(features))]), np.array([r[f"s{k}"] or 1.0 for k in range(len(features))])) for g, r in found.items()}
    size = len(features)

    def products(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            x = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(size)], 1)
            names = np.array(batch.column(0).to_pylist(), object)
            for g in set(names.tolist()) & set(centre):
                z = (x[names == g] - centre[g][0]) / centre[g][1]
                total[g] = total.get(g, 0) + z.T @ z
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([total[g].ravel().tolist() for g in keys], pa.list_(pa.float64()))], names=["g", "p"])

    parts = rows.mapInArrow(products, "g string, p array<double>").select("g", F.posexplode("p").alias("at", "v"))
    summed = parts.groupBy("g", "at").agg(F.sum("v").alias("v")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("p"))
    for row in summed.select("g", "p.v").collect():
        r, spread = found[row["g"]], centre[row["g"]][1]
        cov = np.array(row["v"]).reshape(size, size) / r["n"] * np.outer(spread, spread)
        r |= {f"c{i}_{j}": cov[i, j] for i, j in _pairs(features)}
    return [_reference(r, features, g, components) for g, r in sorted(found.items())]


def _pairs(features: list[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(features)) for j in range(i, len(features))]


def _reference(moments: dict, features: list[str], name: str, components: int) -> dict:
    n, cov = moments["n"], moments
    used = [k for k in range(len(features)) if moments[f"s{k}"] > 0]
    pairs = [(i, j) for a, i in enumerate(used) for j in used[a:]]
    std = np.array([moments[f"s{k}"] for k in used])
    c = np.zeros((len(used), len(used)))
    at = {k: a for a, k in enumerate(used)}
    for i, j in pairs:
        c[at[i], at[j]] = c[at[j], at[i]] = cov[f"c{i}_{j}"]
    value, vector = np.linalg.eigh(c / np.outer(std, std))
    top = np.argsort(-value, kind="stable")[: min(components, len(used), max(1, n - 1))]
    load = vector[:, top]
    load = load * np.where(load[np.abs(load).argmax(0), np.arange(load.shape[1])] < 0, -1, 1)
    return {"name": name, "n": n, "features": [features[k] for k in used], "mean": [moments[f"m{k}"] for k in used], "std": std.tolist(), "loadings": load.T.tolist(), "pc_std": np.sqrt(np.maximum(value[top], 0)).tolist(), "explained": (value[top] / value.sum()).tolist()}


def components(ref: dict) -> list[Column]:
    """Projections on the reference's axes; null as soon as one feature is."""
    z = [(F.col(f) - m) / s for f, m, s in zip(ref["features"], ref["mean"], ref["std"], strict=True)]
    return [reduce(lambda a, b: a + b, [w * x for w, x in zip(row, z, strict=True)]) for row in ref["loadings"]]


def distance(ref: dict) -> Column:
    """Root of the summed squares of components in units of their spread (the centroid of z-scores is zero)."""
    if any(s == 0 for s in ref["pc_std"]):
        return F.lit(None).cast("double")
    return F.sqrt(reduce(lambda a, b: a + b, [F.pow(c / s, F.lit(2.0)) for c, s in zip(components(ref), ref["pc_std"], strict=True)]))


def nearest(df: DataFrame, features: list[str], refs: list[dict], threshold: float = 3.0) -> DataFrame:
    """route() without the map of distances, for any number of references: adds cohort, distance, match.  One pass in Arrow batches."""
    usable = sorted((r for r in refs if all(s > 0 for s in r["pc_std"])), key=lambda r: r["name"])

    def run(it):
        for batch in it:
            x = {f: batch.column(f).cast("double").to_numpy(zero_copy_only=False) for f in features}
            best, cohort = np.full(batch.num_rows, np.inf), np.full(batch.num_rows, None, object)
            for r in usable:
                z = np.stack([(x[f] - m) / s for f, m, s in zip(r["features"], r["mean"], r["std"], strict=True)])
                d = np.sqrt((((np.array(r["loadings"]) @ z) / np.array(r["pc_std"])[:, None]) ** 2).sum(0))
                closer = d < best  # a null feature gives nan, which is never closer
                best[closer], cohort[closer] = d[closer], r["name"]
            far = np.isinf(best)
            match = np.where(far, "unprojectable", np.where(best <= threshold, "match", "none"))
            added = [pa.array(cohort, pa.string()), pa.array(best, pa.float64(), mask=far), pa.array(match.tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "cohort", "distance", "match"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{schema}, cohort string, distance double, match string")


def route(df: DataFrame, refs: list[dict], threshold: float = 3.0, hint: str | None = None) -> DataFrame:
    """Adds distances (map), cohort, distance, match.  The nearest reference wins, ties by name; a hint fixes the cohort."""
    names = sorted(r["name"] for r in refs)
    if hint is not None and hint not in names:
        raise ValueError(f"no reference {hint}")
    by = {r["name"]: distance(r) for r in refs}
    found = df.withColumns({f"__d{k}": by[n] for k, n in enumerate(names)})
    each = F.array(*[F.struct(F.col(f"__d{k}").alias("distance"), F.lit(n).alias("name")) for k, n in enumerate(names)])
    near = F.array_min(F.filter(each, lambda e: e["distance"].isNotNull() & (F.lit(hint is None) | (e["name"] == F.lit(hint or "")))))
    found = found.withColumn("distances", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"__d{k}") for k in range(len(names))]))).withColumn("__n", near)
    return found.withColumn("cohort", F.col("__n")["name"]).withColumn("distance", F.col("__n")["distance"]).withColumn("match", F.when(F.col("__n").isNull(), "unprojectable").when(F.col("distance") <= threshold, "match").otherwise("none")).drop("__n", *[f"__d{k}" for k in range(len(names))])
