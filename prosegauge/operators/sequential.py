"""Operators around the sequential kernels: Arrow functions over a text column."""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import batch as B, kernels as K, measure as M
from ..functions.lexicon import bit
from ..plans.base import cleaned
from .wide import lean

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
_SLICES = T.StructType([T.StructField("level", T.StringType()), T.StructField("slices", T.ArrayType(_SPAN))])


@F.pandas_udf(T.DoubleType())
def phrase_rate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(K.phrase_rate).astype("float64")


@F.pandas_udf(_SLICES)
def structural_slices(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        got = [K.structural_slices(t or "") for t in part]
        yield pd.DataFrame({"level": [g[0] for g in got], "slices": [[{"start": a, "stop": b} for a, b in g[1]] for g in got]})


def slices(docs: DataFrame) -> DataFrame:
    """doc_id, level, slice, start, stop: structural slices of the cleaned text."""
    got = cleaned(docs).select("doc_id", structural_slices("text").alias("s"))
    return got.select("doc_id", "s.level", F.posexplode("s.slices").alias("slice", "x")).select("doc_id", "level", "slice", "x.start", "x.stop")


def bootstrap(docs: DataFrame, b: int = 50, least: int = 8) -> DataFrame:
    """doc_id, replicates, point, low, high, se of the modal density under resampled sentences.

    Sentences are measured once; a replicate is a sum over drawn indices, so no
    text is rebuilt.  Fewer than `least` sentences give no row.
    """
    slim = lean(docs.select("doc_id", "text"))

    def run(batches):
        for batch in batches:
            kept, points, got = [], [], []
            for k, (clean, n, m) in enumerate(B.sentence_hits(batch.column(1).to_pylist(), bit("modal"))):
                if len(n) >= least:
                    total = int(n.sum())
                    kept.append(k)
                    points.append(100.0 * int(m.sum()) / total if total else 0.0)
                    got.append(K.resampled(n, m, hashlib.sha256(clean.encode()).hexdigest(), b))
            every = np.array(got, np.float64).reshape(-1, b)
            low, high = np.percentile(every, [2.5, 97.5], axis=1) if kept else (np.zeros(0), np.zeros(0))
            arrays = [batch.column(0).take(pa.array(kept, pa.int64())), pa.array([b] * len(kept), pa.int32()), pa.array(points, pa.float64()), pa.array(low), pa.array(high), pa.array(every.std(axis=1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "replicates", "point", "low", "high", "se"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, replicates int, point double, low double, high double, se double")


def perturbed(docs: DataFrame, grid: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """doc_id, kind, intensity, text: every perturbation of every document over a grid of intensities."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(e)).alias("intensity")) for k in K.PERTURBATIONS for e in grid]))

    @F.pandas_udf("string")
    def run(sents: pd.Series, kind: pd.Series, intensity: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([" ".join(K.perturb(k, list(s), e, d)) for s, k, e, d in zip(sents, kind, intensity, seed, strict=True)], dtype=object)

    spread = cleaned(docs, sents=True).select("doc_id", "sents", F.sha2("text", 256).alias("seed"), cells.alias("cell")).select("doc_id", "sents", "seed", "cell.*")
    return spread.select("doc_id", "kind", "intensity", run("sents", "kind", "intensity", "seed").alias("text"))


def perturbed_words(docs: DataFrame, grid: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """kind, intensity, n, words: documents and white-space words of perturbed(), summed up where the texts are read."""
    cells = [(k, float(e)) for k in K.PERTURBATIONS for e in grid]

    def run(batches):
        n, words = 0, [0] * len(cells)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                clean = M.unfenced(M.canonical(text))
                own = K.perturbed_words(M.sentences(clean), grid, hashlib.sha256(clean.encode()).hexdigest())
                n, words = n + 1, [a + b for a, b in zip(words, own, strict=True)]
        kinds, at = zip(*cells, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(at, pa.float64()), pa.array([n] * len(cells), pa.int64()), pa.array(words, pa.int64())], names=["kind", "intensity", "n", "words"])

    rows = lean(docs.select("text")).mapInArrow(run, "kind string, intensity double, n long, words long").where("n > 0")
    return rows.groupBy("kind", "intensity").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def record_hash(row: Column) -> Column:
    """SHA-256 of the canonical JSON of a struct: twelve digits, sorted keys, no NaN."""

    @F.pandas_udf("string")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([hashlib.sha256(K.canonical_json({k: None if pd.isna(v) else v for k, v in r.items()}).encode()).hexdigest() for r in rows.to_dict("records")], dtype=object)

    return run(row)
