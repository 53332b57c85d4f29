"""Queries beyond the shared SQL: scripts, lines, vectors, conversations and the sequential operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import words
from ..operators import columns, reference, sequential, wide
from ..sources.tables import written
from . import trajectory


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LATIN, _OTHER = T.SCRIPTS["latin"], T.SCRIPTS["other"]


def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of the Latin script and of ten others; soft refusal at 50 letters and a tenth."""
    n = lambda c: F.regexp_count("text", F.lit(f"[{c}]")).cast("long")
    rows = _table(spark, sf_dir, "documents").select("doc_id", n(_LATIN).alias("latin"), n(_OTHER).alias("other"))
    return rows.withColumn("nonlatin", (F.col("other") >= 50) & (F.col("other") >= 0.1 * (F.col("latin") + F.col("other"))))


_LINES = [("heading", r"^\s{0,3}#{1,6}\s"), ("rule", r"^\s*(?:[-*_]\s*){3,}$"), ("table", r"^\s*\|"), ("bullet", r"^\s*(?:[-*+]|\d+\.)\s+")]


def structural_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each kind per document, rules before headings, tables and bullets, the rest prose (no fences or front matter in these tables)."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    like = lambda p: F.regexp_like("x", F.lit(p))
    kind = F.when(~like(r"\S"), "blank").when(like(r"^\s{4,}\S"), "code").when(like(_LINES[1][1]), "rule").when(like(_LINES[0][1]), "heading").when(like(_LINES[2][1]), "table").when(like(_LINES[3][1]), "bullet").otherwise("prose")
    return lines.select("doc_id", kind.alias("k")).groupBy("doc_id").agg(*[F.count_if(F.col("k") == k).alias(f"n_{k}") for k in ("blank", "code", "rule", "heading", "table", "bullet", "prose")])


STRUCTURAL_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), c AS (SELECT doc_id, CASE WHEN NOT regexp_matches(x, '\S') THEN 'blank' WHEN regexp_matches(x, '^\s{4,}\S') THEN 'code' WHEN regexp_matches(x, '^\s*(?:[-*_]\s*){3,}$') THEN 'rule' WHEN regexp_matches(x, '^\s{0,3}#{1,6}\s') THEN 'heading' WHEN regexp_matches(x, '^\s*\|') THEN 'table' WHEN regexp_matches(x, '^\s*(?:[-*+]|\d+\.)\s+') THEN 'bullet' ELSE 'prose' END AS k FROM l)
SELECT doc_id, """ + ", ".join(f"count_if(k = '{k}') AS n_{k}" for k in ("blank", "code", "rule", "heading", "table", "bullet", "prose")) + " FROM c GROUP BY doc_id"


def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and Euclidean distance of each vector and the next."""
    e = _table(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(columns.cosine(F.col("a"), F.col("b")), 6).alias("cosine"), F.round(columns.euclidean(F.col("a"), F.col("b")), 6).alias("euclidean"))


def conversation_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, modals and negations of each role per 100 words."""
    w = T.words(F.coalesce("text", F.lit("")))
    hits = lambda name: F.size(F.filter("w", lambda x: x.isin(words(name))))
    rows = _table(spark, sf_dir, "conversations").select("role", F.explode(F.array(w)).alias("w"))
    total = rows.groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.size("w")).alias("words"), F.sum(hits("modal")).alias("m"), F.sum(hits("neg")).alias("n"))
    return total.select("role", "turns", "words", F.round(100.0 * F.col("m") / F.nullif(F.col("words"), F.lit(0)), 6).alias("modal_density"), F.round(100.0 * F.col("n") / F.nullif(F.col("words"), F.lit(0)), 6).alias("negation_density"))


def _in(name: str) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words(name))


_PATTERN = "'" + T.WORD.replace("'", "''") + "'"
CONVERSATION_SQL = f"""WITH t AS (SELECT role, list_transform(regexp_extract_all(coalesce(text, ''), {_PATTERN}), lambda x: replace(lower(x), '’', '''')) AS w FROM conversations),
s AS (SELECT role, count(*) AS turns, sum(len(w))::BIGINT AS words, sum(len(list_filter(w, lambda x: x IN ({_in("modal")})))) AS m, sum(len(list_filter(w, lambda x: x IN ({_in("neg")})))) AS n FROM t GROUP BY role)
SELECT role, turns, words, round(100.0::DOUBLE * m / nullif(words, 0), 6) AS modal_density, round(100.0::DOUBLE * n / nullif(words, 0), 6) AS negation_density FROM s"""


def lz78(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy distinct phrases per byte of the cleaned text."""
    return wide.compression(_table(spark, sf_dir, "documents"))


def elegant_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.slices(_table(spark, sf_dir, "documents"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.bootstrap(_table(spark, sf_dir, "documents"))


def perturb_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean words and sentences per perturbation and intensity."""
    sums = sequential.perturbed_words(_table(spark, sf_dir, "documents"))
    return sums.select("kind", "intensity", "n", F.round(F.col("words") / F.col("n"), 6).alias("words"))


REGISTER = ["lexical_novelty", "sentence_length_variance", "modal_density", "negation_density"]


def _register(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import queries

    return queries.feat(_table(spark, sf_dir, "documents"))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang and the 57 features that references are fitted on."""
    from . import features as X

    docs = _table(spark, sf_dir, "documents")
    rows = wide.wide(docs, frozenset(wide.COLUMNS) - {"spread", "letters"}, keep=("lang",))
    return written(spark.sql(f"SELECT d.doc_id, d.lang, {X.FLAT} FROM {{wide}} d", wide=rows), "flat")


def reference_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference of every language on the 57 flat features, fitted on all its documents; every document routed to the nearest.

    A null language and one of fewer than two measurable documents or without
    spread have no reference; their documents get the nearest of the others and
    the match "no_reference".  A document with a null feature is unprojectable.
    """
    from .features import FLAT_NAMES

    return _routed(_flat(spark, sf_dir), FLAT_NAMES)


def _routed(feat: DataFrame, features: list[str]) -> DataFrame:
    refs = reference.fit_groups(feat, features, "lang")
    known = feat.sparkSession.createDataFrame([(r["name"],) for r in refs], "__lang string")
    found = reference.nearest(feat, features, refs).join(known, F.col("lang") == F.col("__lang"), "left")
    match = F.when(F.col("__lang").isNull(), "no_reference").otherwise(F.col("match"))
    return found.select("doc_id", "lang", "cohort", F.round("distance", 6).alias("distance"), match.alias("match"))


def compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both compression ratios: of every text, and of those in the envelope."""
    from . import features as X

    rows = wide.wide(_table(spark, sf_dir, "documents"), frozenset(("lz",)))
    return spark.sql(f"SELECT d.doc_id, {X.prefixed('stylometry', X.COMPRESSION)}, {X.prefixed('distributional', X.COMPRESSION_GATED)} FROM {{wide}} d", wide=rows)


def full_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 69 features of every document in one pass, with the digests of its text and of its canonical record."""
    from . import features as X

    docs = _table(spark, sf_dir, "documents")
    rows = wide.wide(docs.withColumn("input_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)), frozenset(wide.COLUMNS), keep=("input_sha256",))
    found = spark.sql(f"SELECT d.doc_id, d.input_sha256, d.n_words, d.n_sent, {X.EVERY} FROM {{wide}} d", wide=rows)
    names = [c for c in found.columns if c not in ("doc_id", "input_sha256")]
    return found.withColumn("reading_sha256", sequential.record_hash(F.struct(*names)))


def record_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of the canonical JSON of the whole reading: twelve digits, sorted keys."""
    return full_record(spark, sf_dir).select("doc_id", "reading_sha256")


def trajectory_elegant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four curves over structural slices, with the level of the cut."""
    values = [F.round(c, 8).alias(c) for c in trajectory.DIMENSIONS]
    return wide.elegant(_table(spark, sf_dir, "documents")).select("doc_id", "level", "slice", "n_slices", "start", "stop", *values)


def _on_elegant(name: str, sql: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from . import queries as Q

        rel = {"traj": written(trajectory_elegant(spark, sf_dir).drop("level", "start", "stop"), "trajectory")}
        if "{wide}" in sql:
            rel["wide"] = wide.wide(_table(spark, sf_dir, "documents"), frozenset())
        return spark.sql(Q._fill(sql, Q.SPARK), **rel)

    query.__name__ = name
    query.__doc__ = "The query of the same name over structural slices."
    return query


_ELEGANT = [_on_elegant(f"{name}_elegant", sql) for name, sql in (("slice_deltas", trajectory.DELTAS), ("arc_summary", trajectory.ARC), ("slice_labels", trajectory.LABELS), ("flags_summary", trajectory.FLAGS))]


def trajectory_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four elegant curves on a grid of ten points, linear between slices: doc_id and an array of 40."""
    rows = trajectory_elegant(spark, sf_dir)
    pts = lambda c: F.array_sort(F.filter(F.collect_list(F.struct(F.col("slice").cast("double").alias("x"), F.col(c).alias("y"))), lambda p: p["y"].isNotNull()))
    kept = rows.groupBy("doc_id").agg(F.max("n_slices").alias("n"), *[pts(c).alias(c) for c in trajectory.DIMENSIONS])
    grid = F.sequence(F.lit(0), F.lit(9))
    on = lambda c: F.transform(grid, lambda k: F.round(columns.interpolate(F.col(c)["x"], F.col(c)["y"], k * (F.col("n") - 1) / 9.0), 8))
    return kept.select("doc_id", F.concat(*[on(c) for c in trajectory.DIMENSIONS]).alias("embedding"))


def queries():
    return {f.__name__: f for f in (script_counts, structural_lines, embedding_cosine, conversation_register, lz78, elegant_slices, bootstrap_ci, perturb_study, reference_route, record_hash, compression, full_record, trajectory_elegant, trajectory_embedding, *_ELEGANT)}


def oracle_sql() -> dict[str, str]:
    count = lambda c: f"len(regexp_extract_all(text, '[{c}]'))"
    return {
        "script_counts": f"SELECT doc_id, latin, other, other >= 50 AND other >= 0.1 * (latin + other) AS nonlatin FROM (SELECT doc_id, {count(_LATIN)} AS latin, {count(_OTHER)} AS other FROM documents) x",
        "structural_lines": STRUCTURAL_SQL,
        "embedding_cosine": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "conversation_register": CONVERSATION_SQL,
    }
