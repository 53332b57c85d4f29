"""One row of counts per document, or one per slice, from an Arrow pass over the texts.

A row is finished where its text was read: nothing is shuffled, and a feature
query reads the columns that it needs from one scan of the documents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batch as B, measure as M
from ..functions.kernels import phrase_rate

BASE = {n: "long" for n in "n_words n_sent n_chars semicolons commas quotes questions exclaims blank_words n_exist n_cop".split()} | {"has_end": "boolean", "odd_quotes": "boolean", "open_fence": "boolean"}
COLUMNS = {
    "counts": {n: "long" for n in ["n", "types", "letters", "hapax", "c2", "p1", "p2", "content", "content_types", "repeated_types", *(f"k{i}" for i in range(1, 7)), *(f"e{i}" for i in range(1, 7)), *M.HITS]},
    "len": {"len_m": "long", "len_s1": "long", "len_s2": "long", "sb_s": "double"},
    "cue": {"elaboration": "long", "contrast": "long", "markers": "long"},
    "rel": {n: "long" for n in [*(f"r{i}" for i in range(1, 10)), "rel_total", "pairs", "switches", "deep"]},
    "stems": {n: "long" for n in "st_n stems again chains span".split()},
    "spread": {"mattr_total": "long", "bg_s": "double", "half_pos": "long", "burst": "double"},
    "sub": {"sub_hits": "long"},
    "lz": {"lz": "double"},
    "letters": {"ch_n": "long", "ch_s": "double", "drift": "double"},
}
_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
#: Bytes of an Arrow batch, since whole texts are sent.
BATCH = 4 << 20


def lean(docs: DataFrame) -> DataFrame:
    """docs in at least as many partitions as there are cores: a table of fewer scan partitions is small, so moving it costs little; others stay as they are."""
    spark = docs.sparkSession
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "67108864b").lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH:
        spark.conf.set(key, str(BATCH))
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(4 * cores) if docs.rdd.getNumPartitions() < 2 * cores else docs


def wide(docs: DataFrame, parts: frozenset[str], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept columns, the counts of every document and those of the parts asked for."""
    kinds = BASE | {c: k for p in sorted(parts) for c, k in COLUMNS[p].items()}
    slim = lean(docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text")))

    def run(batches):
        for batch in batches:
            got = B.measure_all(batch.column(batch.num_columns - 1).to_pylist(), parts)
            arrays = [pa.array(got[c][0], _ARROW[k], mask=got[c][1]) if got else pa.array([], _ARROW[k]) for c, k in kinds.items()]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*names, *kinds])

    own = [f"`{n}` {t}" for n, t in slim.dtypes if n != "text"]
    return slim.mapInArrow(run, ", ".join([*own, *(f"{c} {k}" for c, k in kinds.items())]))


def compression(docs: DataFrame) -> DataFrame:
    """doc_id and the phrases per byte of the cleaned text."""
    slim = lean(docs.select("doc_id", "text"))

    def run(batches):
        for batch in batches:
            got = [phrase_rate(M.unfenced(M.canonical(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "compression_ratio"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, compression_ratio double")


def top_words(docs: DataFrame, most: int = 20, least: int = 3) -> DataFrame:
    """doc_id, word, c, place of each row's most frequent words."""
    slim = lean(docs.select("doc_id", "text"))

    def run(batches):
        for batch in batches:
            owner, words, counts, places = B.top_all(batch.column(1).to_pylist(), most, least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), words.cast(pa.string()), pa.array(counts), pa.array(places)], names=["doc_id", "word", "c", "place"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, word string, c long, place long")


_CURVE = {"slice": "long", "n_slices": "long", "words": "long", "first_word": "long", "last_word": "long", "novelty": "double", "variance": "double", "modal": "double", "negation": "double"}


_PLACED = _CURVE | {"level": "string", "start": "long", "stop": "long"}


def _slices(docs: DataFrame, kernel, columns: dict[str, str], id_col: str, text_col: str) -> DataFrame:
    slim = lean(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def run(batches):
        for batch in batches:
            got = kernel(batch.column(1).to_pylist())
            owner = pa.array([k for k, own in enumerate(got) for _ in own], pa.int64())
            flat = [row for own in got for row in own]
            arrays = [pa.array([row[j] for row in flat], _ARROW[k]) for j, k in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *arrays], names=["doc_id", *columns])

    return slim.mapInArrow(run, ", ".join([f"doc_id {dict(slim.dtypes)['doc_id']}", *(f"{c} {k}" for c, k in columns.items())]))


def curves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of measure.curves() for every equal-word slice of every document; blank texts have none."""
    return _slices(docs, B.curves_all, _CURVE, id_col, text_col)


def elegant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of measure.elegant() for every structural slice of every document."""
    return _slices(docs, B.elegant_all, _PLACED, id_col, text_col)
