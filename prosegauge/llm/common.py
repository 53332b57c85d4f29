"""Shared pieces: words, durable intermediate tables, skew-safe lookups, splits."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = "\t\n\x0b\x0c\r"


def plain_blanks(text: Column) -> Column:
    """The text with every white-space character of WORD as U+0020; replace() scans bytes and is far cheaper than translate()."""
    flat = F.coalesce(text, F.lit(""))
    for c in _BLANKS:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return flat


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    """array<string> of the words of a text; a null or blank text has none.

    Splitting on a one-character pattern takes Java's fast path, several times
    cheaper than a regular expression.
    """
    return F.array_remove(F.split(plain_blanks(text), " "), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where none is named, a temporary folder is made and remembered for the
    session, but on a local master only: on a cluster every executor would
    write to a disk of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("prosegauge.shared.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="prosegauge-")
        spark.conf.set("prosegauge.shared.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and
    a lost executor costs nothing that was already computed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._written_at = path
    return kept


def discard(*tables: DataFrame | None) -> None:
    """Delete materialised tables that no later step reads."""
    for t in tables:
        at = getattr(t, "_written_at", None) if isinstance(t, DataFrame) else None
        if isinstance(at, str):
            jvm = t.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bound the Arrow batches of the session to `most` bytes (Spark's own bound is 64 MB), since whole texts are sent:
    a batch is held by the JVM and by its Python worker at the same time.  Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "67108864b").lower().rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, heavy: int = 20_000, most: int = 50_000) -> DataFrame:
    """Left join to a table with one row per key, safe for hot keys.

    `right` carries `weight`, the number of left rows of its key.  Keys of at
    least `heavy` rows are few by arithmetic (rows / heavy); they are counted,
    and only if there are at most `most` are they broadcast.  All other keys
    are joined by shuffle, where no key holds more than `heavy` rows.
    """
    value = [c for c in right.columns if c not in keys and c != weight]
    hot = right.where(F.col(weight) >= heavy).select(*keys, *value)
    n = hot.limit(most + 1).count()
    if n == 0 or n > most:  # beyond the bound adaptive skew handling splits what is hot
        return left.join(right.drop(weight), keys, "left")
    mark = hot.select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in value], F.lit(True).alias("__hot"))
    marked = left.join(F.broadcast(mark), keys, "left")
    done = marked.where("__hot").select(*left.columns, *[F.col(f"__hot_{c}").alias(c) for c in value])
    rest = marked.where("__hot is null").select(*left.columns)
    cold = right.where(F.col(weight) < heavy).drop(weight)
    return done.unionByName(rest.join(cold, keys, "left"))


def split_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; remainder 1 is held out.  A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return split_of(doc_id) == 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
