"""Sources and sinks: folders of text files, line-wise JSON records, reference files."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_folder(spark: SparkSession, path: str, pattern: str = "*.{md,txt}") -> DataFrame:
    """path, text, input_sha256, valid: one row per file below a folder; bytes that aren't UTF-8 are marked and replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("input_sha256"), valid.alias("valid"))


def rejects(docs: DataFrame, most_words: int = 10_000, most_bytes: int = 80_000) -> DataFrame:
    """Adds reason: null for a document within the caps, else why it isn't measured."""
    from ..functions.text import blank_words

    size = F.octet_length("text")
    return docs.withColumn("reason", F.when(F.col("text").isNull() | (F.trim("text") == ""), "empty").when(size > most_bytes, "too many bytes").when(blank_words(F.col("text")) > most_words, "too many words"))


RECORD = T.StructType([T.StructField("register", T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("cohort", T.StringType())])), T.StructField("distances", T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("name", T.StringType()), ("version", T.StringType()), ("distance", T.DoubleType()))]))), T.StructField("_corrupt", T.StringType())])


def records(spark: SparkSession, path: str, name: str, version: str) -> DataFrame:
    """line, distance, skipped: distances of JSON lines to one reference; what can't be read is kept with its reason."""
    lines = spark.read.text(path, wholetext=False).select("value", F.monotonically_increasing_id().alias("line"))
    row = F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    got = lines.select("line", row.alias("r"))
    own = F.get(F.filter("r.distances", lambda d: (d["name"] == name) & (d["version"] == version)), F.lit(0))["distance"]
    value = F.coalesce(own, F.col("r.register.distance"))
    return got.select("line", value.alias("distance"), F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "malformed").when(value.isNull(), "no distance").alias("skipped"))


def write_reference(ref: dict, path: str) -> str:
    """Write a reference as sorted JSON; returns the SHA-256 of its bytes."""
    raw = (json.dumps(ref, sort_keys=True, indent=1) + "\n").encode()
    Path(path).write_bytes(raw)
    return hashlib.sha256(raw).hexdigest()


def read_reference(path: str) -> dict:
    ref = json.loads(Path(path).read_text(encoding="utf-8"))
    missing = {"name", "n", "features", "mean", "std", "loadings", "pc_std"} - set(ref)
    if missing:
        raise ValueError(f"{path}: not a reference, without {sorted(missing)}")
    return ref
