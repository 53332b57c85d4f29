"""Every query by name, and the same result as SQL for another engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import words
from ..operators import charts, ranks, wide
from ..sources.tables import written
from . import base, control, features as X, trajectory as J

# ---- relations that only some queries need


_STRONG = [w for w in words("rst_elaboration") if w not in words("rst_elaboration_broad")]
_L = r"[\p{L}\p{N}_]"
_N = r"[^\p{L}\p{N}_]"


def _cues(found: list[str]) -> str:
    """A pattern for any cue as a whole word; a cue that ends in a full stop needs a letter after it, as \\b does."""
    plain = "|".join(w for w in found if w[-1] != ".")
    dotted = "|".join(w.replace(".", r"\.") for w in found if w[-1] == ".")
    return rf"(?i)(?:^|{_N})(?:{plain})(?:$|{_N})" + (rf"|(?:^|{_N})(?:{dotted}){_L}" if dotted else "")


_BUT = rf"({_L}+){_N}+but(?:{_N}|$)"
_TRIGGERS = ["nothing", "anything", "all", "everything", "none"]
_DASH = r"[a-z]\w*[^\n]{0,80}?\s+(?:[–—]|--)\s+[A-Za-z]"
_COLON = r"[a-z]{2,}:\s+[a-z]{3,}"
_XDASH = r"[A-Za-z][^\n]{1,120}?\s+(?:[–—]|--)\s+[A-Za-z]"
_XCOLON = r"[A-Za-z]\s*:\s+[a-z][a-z]+"
_OFF = r"^\s*#|\||^\s*(?:[-*+]|\d+\.)\s+|^[\s\-*_=]*$"
_CODE = r"`[^`\n]*`"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PROSE_SQL = f"regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, {_q(_OFF)})), chr(10)), {_q(_CODE)}, ' ', 'g')"
_BARE_SQL = "regexp_replace(lower(text), '^[ ,;:—-]+', '')"
CUE_SQL = f"""cue AS (SELECT doc_id, sent, regexp_extract({_BARE_SQL}, '^([^ ,]+)[ ,]', 1) AS marker, rtrim(regexp_extract({_BARE_SQL}, '^(\\S*)', 1), ',.;:!?') AS first_word, len(regexp_extract_all(text, '\\S+')) AS blanks,
  CASE WHEN len(list_filter(regexp_extract_all(lower(text), {_q(_BUT)}, 1), lambda w: w NOT IN ({", ".join(map(_q, _TRIGGERS))}))) > 0 THEN 1 ELSE 0 END AS but,
  CASE WHEN regexp_matches(scrubbed, {_q(_cues(_STRONG))}) OR (len(regexp_extract_all(scrubbed, '\\S+')) >= 8 AND regexp_matches(scrubbed, {_q(_cues(words("rst_elaboration_broad")))})) OR regexp_matches(scrubbed, {_q(_DASH)}) OR regexp_matches(scrubbed, {_q(_COLON)}) THEN 1 ELSE 0 END AS gloss,
  CASE WHEN regexp_matches(text, {_q(_XDASH)}) OR regexp_matches(text, {_q(_XCOLON)}) THEN 1 ELSE 0 END AS xgloss FROM (SELECT *, {_PROSE_SQL} AS scrubbed FROM sen) x)"""


LETTERS_SQL = r"letters AS (SELECT doc_id, half, unnest(string_split(h, '')) AS ch FROM (SELECT doc_id, 0 AS half, regexp_replace(lower(substr(text, 1, n_chars // 2)), '\P{L}', '', 'g') AS h FROM doc UNION ALL SELECT doc_id, 1, regexp_replace(lower(substr(text, n_chars // 2 + 1)), '\P{L}', '', 'g') FROM doc) x WHERE h <> '')"


WW_SQL = f"ww AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS w FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS l FROM doc) x), wt AS (SELECT doc_id, k, lower(unnest(regexp_extract_all(w, {_q(T.WORD)}))) AS word FROM ww)"

#: Fragments that the engines spell differently.
SPARK = {"ends": "before RLIKE '[.!?]$'", "capital": "w RLIKE '^[A-Z]'", "short": "lower(regexp_replace(before, '[.]+$', ''))", "rid": "monotonically_increasing_id()", "unnest_percents": "explode(sequence(0, 100))"}
DUCK = {"ends": "regexp_matches(before, '[.!?]$')", "capital": "regexp_matches(w, '^[A-Z]')", "short": "lower(rtrim(before, '.'))", "rid": "row_number() OVER ()", "unnest_percents": "unnest(generate_series(0, 100))"}

READING = f"SELECT d.doc_id, {X.fields(X.SFL)}, {X.fields(X.RST)}, {X.fields(X.COHESION)}, {X.fields(X.REGISTER)} FROM {{wide}} d"

_AXES = [
    ("sfl_process_complexity", "s.process_proxy_entropy", 1.13, 2.46, "(" + " + ".join(f"(CASE WHEN e.pct_{x} > 0 THEN -e.pct_{x} * log2(e.pct_{x}) ELSE 0.0 END)" for x in X.EXTENDED[1:]) + ")", 1.13, 2.46),
    ("rst_contrast", "t.contrast_marker_density", 0.0, 0.13, "(x.contrast_density + x.concession_density)", 0.0, 0.15),
    ("rst_elaboration", "t.elaboration_marker_density", 0.0, 0.42, "x.elaboration_density", 0.0, 0.28),
    ("cohesion_repetition", "c.lexical_repetition", 0.07, 0.49, "h.lexical_repetition_rate", 0.08, 0.52),
    ("register_modality", "g.modal_density", 0.0, 2.45, "(e.modal_density + e.hedge_density)", 0.0, 4.9),
]
_bare = lambda x: re.sub(r"\b[a-z]\.(?=[a-z])", "", x)
_COMPACT = f"SELECT d.*, {X.fields(X.SFL)}, {X.fields(X.RST)}, {X.fields(X.COHESION)}, {X.fields(X.REGISTER)} FROM {{wide}} d"
_BOTH = f"SELECT d.doc_id, {', '.join(f'd.{_bare(a)} AS a{k}' for k, (_, a, *_) in enumerate(_AXES))}, {X.fields(X.EXT_SFL)}, {X.fields(X.EXT_RST)}, {X.fields(X.EXT_COHESION)} FROM ({_COMPACT}) d"
_PAIRS = f"SELECT doc_id, {', '.join(f'a{k}, {_bare(b)} AS b{k}' for k, (_, _, _, _, b, _, _) in enumerate(_AXES))} FROM ({_BOTH}) both_views"
# values of eight digits divided by limits of two can lie on a tie of the seventh digit: a little more settles it
_ONE = "{u} AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS axis, CASE WHEN a{k} IS NOT NULL THEN round(least(1.0, greatest(0.0, (a{k} - {lo}) / ({hi} - {lo}))) + 1e-10, 7) END AS flat, round(least(1.0, greatest(0.0, (b{k} - {lo2}) / ({hi2} - {lo2}))) + 1e-10, 7) AS wide FROM pairs" for k, (n, _, lo, hi, _, lo2, hi2) in enumerate(_AXES)) + ")"
_AXIS = f"WITH pairs AS ({_PAIRS}), {_ONE.replace('{u}', 'u')}, ax AS (SELECT doc_id, axis, flat, CASE WHEN flat IS NOT NULL THEN wide END AS wide, CASE WHEN flat IS NULL THEN 'incomparable' WHEN round(1 - abs(flat - wide), 7) < 0.8 THEN 'diverge' WHEN (flat + wide) / 2 >= 0.66 THEN 'agree_high' WHEN (flat + wide) / 2 <= 0.33 THEN 'agree_low' ELSE 'agree_mid' END AS direction FROM u)"
CONVERGENCE = f"{_AXIS} SELECT doc_id, axis, flat, wide, direction FROM ax"
COHERENCE = f"""{_AXIS}, k AS (SELECT doc_id, sum(CASE WHEN direction LIKE 'agree%' THEN 1 ELSE 0 END) AS agree5, sum(CASE WHEN direction = 'diverge' THEN 1 ELSE 0 END) AS diverge5, sum(CASE WHEN direction LIKE 'agree%' AND axis <> 'cohesion_repetition' THEN 1 ELSE 0 END) AS agree, sum(CASE WHEN direction <> 'incomparable' AND axis <> 'cohesion_repetition' THEN 1 ELSE 0 END) AS measurable FROM ax GROUP BY doc_id)
SELECT doc_id, CAST(agree AS BIGINT) AS n_agree, CAST(measurable AS BIGINT) AS n_measurable, round(agree / CAST(nullif(measurable, 0) AS DOUBLE), 6) AS value, CASE WHEN measurable = 0 THEN NULL WHEN measurable < 3 THEN 'unmeasurable' WHEN agree / CAST(measurable AS DOUBLE) >= 0.8 THEN 'high' WHEN agree / CAST(measurable AS DOUBLE) >= 0.5 THEN 'moderate' ELSE 'low' END AS label,
  CASE WHEN agree5 >= 4 THEN 'converge' WHEN diverge5 >= 4 THEN 'diverge' ELSE 'mixed' END AS overall FROM k"""

MINIMUM = "SELECT lang, count(*) AS documents, CAST(sum(n_words) AS BIGINT) AS words, round(avg(modal_density), 6) AS modal_density, round(avg(lexical_novelty), 6) AS lexical_novelty FROM {feat} WHERE n_words >= 150 GROUP BY lang"
COHORTS = "SELECT lang, CASE WHEN n_words < 2000 THEN 'short' WHEN n_words < 8000 THEN 'medium' ELSE 'long' END AS cohort, count(*) AS n, CAST(sum(n_words) AS BIGINT) AS words FROM {wide} GROUP BY lang, CASE WHEN n_words < 2000 THEN 'short' WHEN n_words < 8000 THEN 'medium' ELSE 'long' END"
SOFT = "SELECT doc_id, n_words < 60 AS below_hard_floor, n_words < 120 AS joint_cosine_unreliable, n_words < 200 AS rst_unreliable FROM {wide}"

_SCALED = {k: f"ln(1 + {k})" if k == "sentence_length_variance" else k for k in X.SCALES}
EMBEDDING = f"SELECT doc_id, {', '.join(f'CASE WHEN {k} IS NOT NULL THEN round(least(1.0, greatest(0.0, {_SCALED[k]} / {top})), 5) END AS {k}' for k, top in X.SCALES.items())} FROM ({READING}) reading"

_JOINT = ("counts", "len", "cue")
_VIEWS = ("counts", "len", "cue", "rel", "stems")
_FEAT = ("counts", "len", "feat")
_EVERY = ("counts", "len", "cue", "rel", "stems", "spread", "letters", "sub")
JOINT = f"SELECT d.doc_id, d.n_words, d.n_sent, {X.JOINT} FROM {{wide}} d"
#: The flat features without the compression ratio.
FLAT = f"SELECT d.doc_id, {X.FLAT.replace(', ' + X.prefixed('stylometry', X.COMPRESSION), '')} FROM {{wide}} d"
_NULLS = " + ".join(f"CASE WHEN {x} IS NULL THEN 1 ELSE 0 END" for x in X.FLAT_NAMES if not x.endswith("compression_ratio"))
#: Views that diverge, five or more of the 57 flat features unmeasurable (a compression ratio is so for an empty text), a fence that was never closed.
FLAGS_OF_VIEWS = f"""SELECT a.doc_id, CASE WHEN b.overall = 'diverge' THEN 1 ELSE 0 END AS cross_view_diverge, CASE WHEN {_NULLS} + CASE WHEN c.n_chars = 0 THEN 1 ELSE 0 END >= 5 THEN 1 ELSE 0 END AS feature_unmeasurable_cluster,
  CASE WHEN c.open_fence THEN 1 ELSE 0 END AS malformed_fence_recovered FROM ({FLAT}) a JOIN ({COHERENCE}) b ON a.doc_id = b.doc_id JOIN {{wide}} c ON a.doc_id = c.doc_id"""
#: name -> (SQL, the parts of {wide} that it reads and relations beyond)
SHARED: dict[str, tuple[str, tuple[str, ...]]] = {
    "doc_word_counts": (X.WORD_COUNTS, ()), "cohesion_compact": (X.COHESION, ("counts",)), "register_compact": (X.REGISTER, ("counts", "len")), "sfl_compact": (X.SFL, ("counts",)), "sfl_trace_counts": (X.SFL_TRACE, ("counts",)), "rst_compact": (X.RST, ("cue",)), "stylometry": (X.STYLOMETRY, ()),
    "dist_types": (X.DIST_TYPES, ("counts",)), "dist_mattr": (X.DIST_MATTR, ("spread",)), "dist_bigram_entropy": (X.DIST_BIGRAM, ("spread",)), "dist_halflife": (X.DIST_HALFLIFE, ("spread",)), "dist_burstiness": (X.DIST_BURSTINESS, ("spread",)), "dist_sentence_entropy": (X.DIST_SENTENCES, ("len",)), "dist_char_entropy": (X.DIST_CHARS, ("letters",)),
    "ext_sfl": (X.EXT_SFL, ("counts",)), "ext_rst": (X.EXT_RST, ("rel",)), "ext_cohesion": (X.EXT_COHESION, ("counts", "stems")), "compact_reading": (READING, _JOINT), "convergence_axes": (CONVERGENCE, (*_VIEWS, "written")), "coherence": (COHERENCE, (*_VIEWS, "written")),
    "chunker_slices": (J.SLICES, ("ww",)), "trajectory_chunker": (J.TRAJECTORY, ("ww",)), "slice_deltas": (J.DELTAS, ("ww", "traj")), "arc_summary": (J.ARC, ("ww", "traj")), "slice_labels": (J.LABELS, ("ww", "traj")), "flags_summary": (J.FLAGS, ("ww", "traj")),
    "subordination": (X.SUBORDINATION, ("sub",)), "joint_reading": (JOINT, _EVERY), "flat_features": (FLAT, _EVERY), "flags_of_views": (FLAGS_OF_VIEWS, (*_EVERY, "written")),
    "sfl_token_trace": (X.TOKEN_TRACE, ("words",)), "top_words": (X.TOP_WORDS, ("words",)), "flat_embedding": (EMBEDDING, _JOINT), "distance_envelope": (control.ENVELOPE, _FEAT), "spc_summary": (control.SUMMARY, _FEAT), "quantile_grid": (control.GRID, _FEAT),
    "words_by_lang": (MINIMUM, _FEAT), "length_cohorts": (COHORTS, ()), "soft_flags": (SOFT, ()), "reference_feature_stats": (control.REFERENCE, _FEAT), "zscore_distance": (control.DISTANCE, _FEAT), "distance_midrank": (control.MIDRANK, _FEAT), "feature_bh": (control.BH, _FEAT), "cv_fold_ids": (control.FOLDS, _FEAT),
    "spc_individuals": (control.INDIVIDUALS, _FEAT), "spc_cusum": (control.CUSUM, _FEAT), "spc_ewma": (control.EWMA, _FEAT), "length_spearman": (control.SPEARMAN, _FEAT), "detection_rate": (control.DETECTION, _FEAT), "quality_label_contrast": (control.CONTRAST, (*_FEAT, "labels")),
}

FEAT = f"SELECT {{rid}} AS rid, d.doc_id, d.lang, d.n_words, {X.fields(X.REGISTER)} FROM {{wide}} d"


def _fill(sql: str, names: dict[str, str]) -> str:
    for k, v in names.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def _trajectory(docs: DataFrame) -> DataFrame:
    values = [F.round(c, X.D).alias(c) for c in J.DIMENSIONS]
    return wide.curves(docs).select("doc_id", "slice", "n_slices", *values)


def feat(docs: DataFrame) -> DataFrame:
    """rid, doc_id, lang, n_words and the register features of every document, written once: {feat} is read several times."""
    rows = wide.wide(docs, frozenset(("counts", "len")), keep=("lang",))
    return written(docs.sparkSession.sql(_fill(FEAT, SPARK), wide=rows), "feat")


def _control(spark: SparkSession, sql: str, rel: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Adds the relations of control.py that a query reads to {feat}."""

    def need(name: str) -> None:
        if name in rel:
            return
        if name in control.RANKS:
            source, by, value = control.RANKS[name]
            if source == "long":
                rel[name] = ranks.ranked(spark.sql(_fill(control.LONG, SPARK), feat=rel["feat"]), by, value)
            else:
                need(source)
                rel[name] = ranks.ranked(rel[source], by, value)
        elif name == "dist":
            rel[name] = written(spark.sql(_fill(control.DIST, SPARK), feat=rel["feat"]), "dist")
        elif name == "stream":
            need("dist")
            need("irank")
            rel[name] = written(spark.sql(_fill(control.STREAM, SPARK), dist=rel["dist"], irank=rel["irank"]), "stream")
        elif name == "charted":
            need("stream")
            rel[name] = charts.charted(rel["stream"])
        elif name in _CHARTS:
            if name != "individuals":
                need("charted")
                rel["charted"] = written(rel["charted"], "charted")
            rel[name] = spark.sql(_fill(_CHARTS[name], SPARK), **_control(spark, _CHARTS[name], rel))

    for name in re.findall(r"\{(\w+)\}", sql):
        need(name)
    return rel


_CHARTS = {"ewma": control.EWMA, "cusum": control.CUSUM, "individuals": control.INDIVIDUALS}


#: So many ids are broadcast at most, 8 MB.
FEW_IDS = 1_000_000


def _top_words(docs: DataFrame) -> DataFrame:
    """Each row of its own id has its words counted where it is read; rows that share an id are one document, whose words are joined by shuffle."""
    spark = docs.sparkSession
    shared = written(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id")), "shared-ids")
    n = shared.limit(FEW_IDS + 1).count()
    if not n:
        return wide.top_words(docs)
    same = docs["doc_id"].eqNullSafe(F.col("__id"))
    ids = F.broadcast(shared) if n <= FEW_IDS else shared
    return wide.top_words(docs.join(ids, same, "left_anti")).unionByName(spark.sql(X.TOP_WORDS, **base.relations(docs.join(ids, same, "left_semi"))))


def run(spark: SparkSession, name: str, docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One shared query over a table of documents (doc_id, text, lang)."""
    sql, more = SHARED[name]
    if name == "chunker_slices":
        return wide.curves(docs).select("doc_id", "slice", "n_slices", "words", "first_word", "last_word")
    if name == "trajectory_chunker":
        return _trajectory(docs)
    if name == "top_words":
        return _top_words(docs)
    if "words" in more:
        return spark.sql(_fill(sql, SPARK), **base.relations(docs))
    rel = {}
    if "{wide}" in sql:
        rel["wide"] = wide.wide(docs, frozenset(more) & frozenset(wide.COLUMNS), keep=("lang",) if "lang" in docs.columns else ())
        if "written" in more:
            rel["wide"] = written(rel["wide"], "wide")
    if labels is not None:
        rel["labels"] = labels
    if "traj" in more:
        rel["traj"] = written(_trajectory(docs), "trajectory")
    if "feat" in more:
        rel["feat"] = feat(docs)
        rel = _control(spark, sql, rel)
    return spark.sql(_fill(sql, SPARK), **rel)


def _other(name: str) -> str:
    sql, more = SHARED[name]
    parts = [base.base_sql(keep=("lang",)).strip()]
    plain = {k: k for k in "doc sen tok freq lex cue letters ww wt traj feat labels ewma cusum individuals wide dist stream charted xrank frank grank wrank irank".split()}
    if {"cue", "rel"} & {*more}:
        parts.append(CUE_SQL)
    if "letters" in more:
        parts.append(LETTERS_SQL)
    if "ww" in more:
        parts.append(WW_SQL)
    if "traj" in more:
        parts.append(f"traj AS ({_fill(J.TRAJECTORY, DUCK | plain)})")
    parts.append(X.wide_sql(tuple(p for p in more if p in X.WIDE_SQL)))
    if "feat" in more:
        parts.append(f"feat AS ({_fill(FEAT, DUCK | plain)})")
        parts.append(f"long AS ({_fill(control.LONG, DUCK | plain)})")
        parts.append(f"dist AS ({_fill(control.DIST, DUCK | plain)})")
        parts += [f"{k} AS ({control.ranks_sql(source, ', '.join(by), value)})" for k, (source, by, value) in control.RANKS.items()]
        parts.append(f"stream AS ({_fill(control.STREAM, DUCK | plain)})")
        if {"charted", *_CHARTS} & set(re.findall(r"\{(\w+)\}", sql)):
            parts.append(control.CHARTED_SQL)
            parts += [f"{k} AS ({_fill(q, DUCK | plain)})" for k, q in _CHARTS.items()]
            return "WITH RECURSIVE " + ", ".join(parts) + " SELECT * FROM (" + _fill(sql, DUCK | plain) + ") final_result"
    return "WITH " + ", ".join(parts) + " SELECT * FROM (" + _fill(sql, DUCK | plain) + ") final_result"


def _documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = _documents(spark, sf_dir, "labels") if "labels" in SHARED[name][1] else None
        return run(spark, name, _documents(spark, sf_dir), labels)

    query.__name__ = name
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _shared(name) for name in SHARED}
    from . import more

    return found | more.queries()


def oracle_sql() -> dict[str, str]:
    from . import more

    return {name: _other(name) for name in SHARED} | more.oracle_sql()
