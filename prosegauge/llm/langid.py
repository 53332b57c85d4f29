"""Language identification by bit-sliced Bloom filters of n-grams.

Each language has a Bloom filter of its typical character n-grams.  The filters
are sliced: one row of bits per hash position, bit k of which belongs to
language k.  AND-ing the rows of an n-gram's hash positions gives the bitmask
of all languages that may contain it, for all languages at once.  A language's
evidence is its popcount over the n-grams of a text, less what its filter's
false-positive rate explains of the n-grams not in it.

The filters are learned from at most SAMPLE rows per language outside the
held-out third (a parameter), and hold at most GRAMS n-grams per language and
length; both bound what the driver sees.  Prediction reads every whole text.

Defined results: `und` with score 0 if the text is null or has no letter; `und`
if no language was learned; ties go to the language that sorts first; repeated
rows are predicted alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise, small_batches

SAMPLE = 1_500
GRAMS = 3_000
LENGTHS = (1, 2, 3, 4)
BITS = 17
HASHES = 2
_MUL = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-case text; every run of non-letters is one 0, also at both ends."""
    if not text:
        return np.zeros(0, np.uint32)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_is_letter(code), code, 0).astype(np.uint32)
    keep = np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]
    code = code[keep]
    if not code.any():
        return np.zeros(0, np.uint32)
    return np.r_[code[:0] if code[0] == 0 else np.zeros(1, np.uint32), code, code[:0] if code[-1] == 0 else np.zeros(1, np.uint32)].astype(np.uint32)


_TABLE: np.ndarray | None = None


def _is_letter(code: np.ndarray) -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _TABLE[code]


def grams(code: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams of code points, n mixed in."""
    if len(code) < n:
        return np.zeros(0, np.uint64)
    h = code[: len(code) - n + 1].astype(np.uint64) + np.uint64(n << 40)
    for k in range(1, n):
        h = (h * _MUL) ^ code[k : len(code) - n + 1 + k]
    h *= _MUL
    return h ^ (h >> np.uint64(29))


class Filters:
    """rows: [words of 64 languages, 2**BITS] masks; names: the languages in bit order; fp: [lengths, languages] false-positive rates."""

    def __init__(self, sets: dict[str, dict[int, np.ndarray]]):
        self.names = sorted(sets)
        self.rows = np.zeros((len(LENGTHS), (len(self.names) + 63) // 64 or 1, 1 << BITS), np.uint64)
        self.fp = np.zeros((len(LENGTHS), len(self.names)))
        for k, name in enumerate(self.names):
            bit = np.uint64(1) << np.uint64(k % 64)
            for j, n in enumerate(LENGTHS):
                for at in self.places(sets[name].get(n, np.zeros(0, np.uint64))):
                    self.rows[j, k // 64, at] |= bit
                self.fp[j, k] = (np.count_nonzero(self.rows[j, k // 64] & bit) / (1 << BITS)) ** HASHES

    @staticmethod
    def places(h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(64 - BITS * (i + 1))) & np.uint64((1 << BITS) - 1)).astype(np.int64) for i in range(HASHES)]

    def evidence(self, code: np.ndarray) -> np.ndarray:
        """Per language, the share of n-grams in its filter beyond false positives, averaged over lengths."""
        total = np.zeros(len(self.names))
        for j, n in enumerate(LENGTHS):
            h = grams(code, n)
            if not len(h):
                continue
            at = self.places(h)
            for word in range(self.rows.shape[1]):
                rows = self.rows[j, word]
                mask = rows[at[0]]
                for more in at[1:]:
                    mask = mask & rows[more]
                names = range(word * 64, min(len(self.names), word * 64 + 64))
                few = names[-1] - names[0] < 12  # then equal masks are counted together
                kinds = np.bincount(mask.astype(np.int64), minlength=1 << len(names)) if few else None
                for k in names:
                    bit = k % 64
                    if few:
                        hits = kinds.reshape(-1, 2, 1 << bit)[:, 1].sum()
                    else:
                        hits = np.count_nonzero(mask & (np.uint64(1) << np.uint64(bit)))
                    rate = hits / len(h)
                    total[k] += max(0.0, (rate - self.fp[j, k]) / (1 - min(self.fp[j, k], 0.99)))
        return total / len(LENGTHS)

    def predict(self, text: str | None) -> tuple[str, float]:
        code = letters(text)
        if not len(code) or not self.names:
            return "und", 0.0
        e = self.evidence(code)
        best = int(np.argmax(e))
        z = np.exp(25 * (e - e[best]))
        return self.names[best], float(1 / z.sum())


def _sample(docs: DataFrame, limit: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, text of at most `limit` training rows per language, by hash, without a sort of any language.

    The share to keep follows from the language's count, and the hash is uniform
    over ids and texts; of rows that repeat both, one is used.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    rows = rows.where(~held_out(F.col("id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / float(1 << 20)
    some = rows.join(F.broadcast(counts), "lang").where(place < F.lit(float(limit)) / F.col("n"))
    return some.groupBy("lang", "id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Learn the filters: per language and length, the n-grams with the highest count, weighed against the other languages."""
    small_batches(docs.sparkSession)
    sample = materialise(_sample(docs, limit, id_col, text_col, lang_col), "lang-sample")

    def count(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for part in parts:
            for lang, own in part.groupby("lang"):
                codes = [letters(t) for t in own["text"]]
                for n in LENGTHS:
                    h = np.concatenate([np.unique(grams(c, n)) for c in codes] or [np.zeros(0, np.uint64)])
                    h, c = np.unique(h, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "n": n, "h": h.view(np.int64), "c": c})

    counts = sample.mapInPandas(count, "lang string, n int, h long, c long").groupBy("lang", "n", "h").agg(F.sum("c").alias("c"))
    from pyspark.sql.window import Window

    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "h"))).where(F.col("r") <= GRAMS)
    found = top.groupBy("lang", "n").agg(F.collect_list("h").alias("h")).collect()
    sets: dict[str, dict[int, np.ndarray]] = {}
    for row in found:
        sets.setdefault(row["lang"], {})[row["n"]] = np.array(row["h"], np.int64).view(np.uint64)
    return Filters(sets)


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(filters)  # lengths x 2**BITS masks: a fixed size per 64 languages

    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in parts:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    got = docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("p"))
    return got.select("doc_id", "p.lang_pred", "p.score")
