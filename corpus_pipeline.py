"""The corpus pipeline: quality, toxicity, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's docs.  All but the last return the
columns of documents, so a document that a stage drops is gone for good.

Defined results on odd rows: null and blank texts fail the quality rules; a row
is judged by its own id, language and text, so rows that share an id or have
none go or stay each for itself, and repeated rows go or stay together until
near-dedup, which keeps one; blank texts that reach it all stay, and the mix,
which counts words, takes none of them; a null source is mixed as a source of
its own; without labels the base rules alone decide and nothing counts as toxic;
an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import bpe, mixing, neardup, quality, toxicity
from prosegauge.llm.common import materialise, table
from prosegauge.llm.queries import tokenizer_path


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with __key, a hash of all besides the id that a verdict depends on; with the id it stands for the row."""
    return docs.withColumn("__key", F.xxhash64(F.col("lang").isNull(), "lang", F.coalesce("text", F.lit(""))))


def _without(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows that aren't rejected, by doc_id (null ids are matched too) and __key.  Only keys are shuffled where few are rejected."""
    rows = materialise(rejected.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__bad")).distinct(), "rejected")
    bounded = rows.limit(1_000_001).count() <= 1_000_000  # 16 MB of keys at most
    same = keyed["doc_id"].eqNullSafe(F.col("__id")) & (keyed["__key"] == F.col("__bad"))
    return keyed.join(F.broadcast(rows) if bounded else rows, same, "left_anti").drop("__key")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go; null and blank texts are rejected."""
    docs = _keyed(docs)
    return _without(docs, quality.quality(docs, table(spark, sf_dir, "labels"), keep=("__key",)).where("not kept"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; null and blank texts score 0 and stay."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    docs = _keyed(docs)
    return _without(docs, toxicity.score(docs, lexicon, keep=("__key",)).where("predicted = 1"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the least doc_id; blank texts are classes of their own."""
    return neardup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, at most three times; documents without words are never taken."""
    return mixing.mixed_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix."""
    return bpe.encode_digests(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: No SQL: hashes, the automaton, signatures and merges aren't expressible; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{k}")
    return docs
