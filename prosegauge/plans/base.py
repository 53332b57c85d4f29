"""The relations that every feature query reads, as DataFrames and as SQL for another engine.

doc: one row per document (in-row counts, no shuffle); sen: one row per
sentence; tok: one row per word; freq: one row per document and distinct word.
Exploded rows of a document lie in one partition, so aggregates by document are
combined before the shuffle and move about one row per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, text as T

EXISTENTIAL = r"(?i)\bthere\s+(is|are|was|were|exists?|existed)\b"
COPULA = r"(?i)\bthere\s+(is|are|was|were)\b"


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), sents: bool = False) -> DataFrame:
    """doc_id, text (cleaned) and kept columns; sents (array) where wanted, since a generated column can't be pruned."""
    once = lambda c, name: F.explode(F.array(c)).alias(name)  # noqa: E731  a generated column is computed once, however often it is read
    step = docs.select(F.col(id_col).alias("doc_id"), *keep, once(T.unfenced(T.canonicalise(F.coalesce(F.col(text_col), F.lit("")))), "raw"))
    step = step.select("doc_id", *keep, "raw", once(T.fence_state(F.col("raw")), "state"))
    step = step.select("doc_id", *keep, once(T.blank_fences(F.col("raw"), F.col("state")), "text"))
    return step.select("doc_id", *keep, "text", once(T.paragraph_sentences(F.col("text")), "sents")) if sents else step


def relations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    base = cleaned(docs, id_col, text_col, keep, sents=True)
    text, sents = F.col("text"), F.col("sents")
    ends = lambda mark: F.size(F.filter(sents, lambda s: F.endswith(s, F.lit(mark)))).cast("long")
    doc = base.select(
        "doc_id", *keep,
        F.regexp_count(text, F.lit(T.WORD)).cast("long").alias("n_words"), F.size(sents).cast("long").alias("n_sent"), F.length(text).cast("long").alias("n_chars"),
        T.count_of(text, ";").cast("long").alias("semicolons"), T.count_of(text, ",").cast("long").alias("commas"), T.count_of(text, T.QUOTES).cast("long").alias("quotes"),
        ends("?").alias("questions"), ends("!").alias("exclaims"), F.regexp_count(text, F.lit(EXISTENTIAL)).cast("long").alias("n_exist"), F.regexp_count(text, F.lit(COPULA)).cast("long").alias("n_cop"),
        F.regexp_like(text, F.lit("[.!?]")).alias("has_end"), T.blank_words(text).cast("long").alias("blank_words"), text.alias("text"),
    )
    sen = base.select("doc_id", F.posexplode("sents").alias("sent", "text"))
    placed = F.flatten(F.transform(sents, lambda s, i: F.transform(T.words(s), lambda w: F.struct(i.alias("sent"), w.alias("word")))))
    tok = base.select("doc_id", F.posexplode(placed).alias("pos", "t")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("t.sent").cast("long").alias("sent"), F.col("t.word").alias("word"))
    freq = tok.groupBy("doc_id", "word").agg(F.count("*").alias("c"), F.min("pos").alias("p"), F.min("sent").alias("s0"), F.max("sent").alias("s1"))
    return {"doc": doc, "sen": sen.select("doc_id", F.col("sent").cast("long").alias("sent"), "text"), "tok": tok, "freq": freq, "lex": F.broadcast(lexicon.table(docs.sparkSession))}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def base_sql(source: str = "documents", id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> str:
    """The same relations as common table expressions.

    Holds for texts without front matter, fences, blank lines and typographic
    apostrophes, as the shipped test tables are; abbreviations are merged by a
    running count instead of a look-behind.
    """
    k = "".join(f", {c}" for c in keep)
    abbreviations = ", ".join(_quoted(a) for a in T.ABBREVIATIONS)
    quotes = "regexp_replace(text, '[^" + T.QUOTES.replace("'", "''") + "]', '', 'g')"
    return f"""
src AS (SELECT {id_col} AS doc_id{k}, regexp_replace(coalesce({text_col}, ''), '[ \\t]+(\\n|$)', '\\1', 'g') AS text FROM {source}),
pieces AS (SELECT doc_id, generate_subscripts(l, 1) AS i, trim(unnest(l), E' \\n\\t') AS piece FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM src)),
marked AS (SELECT *, coalesce(lower(rtrim(regexp_extract(lag(piece) OVER (PARTITION BY doc_id ORDER BY i), '(\\S+)$', 1), '.')) IN ({abbreviations}), false) AS joined FROM pieces WHERE piece <> ''),
numbered AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sent FROM marked),
sen AS (SELECT doc_id, sent::BIGINT AS sent, string_agg(piece, ' ' ORDER BY i) AS text FROM numbered GROUP BY doc_id, sent),
spread AS (SELECT doc_id, sent, generate_subscripts(l, 1) AS k, unnest(l) AS word FROM (SELECT doc_id, sent, regexp_extract_all(text, {_quoted(T.WORD)}) AS l FROM sen)),
tok AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent, k) - 1 AS pos, sent, replace(lower(word), '’', '''') AS word FROM spread),
freq AS (SELECT doc_id, word, count(*) AS c, min(pos) AS p, min(sent) AS s0, max(sent) AS s1 FROM tok GROUP BY doc_id, word),
senc AS (SELECT doc_id, count(*) AS n_sent, count_if(text LIKE '%?') AS questions, count_if(text LIKE '%!') AS exclaims FROM sen GROUP BY doc_id),
doc AS (SELECT src.doc_id{"".join(f", src.{c}" for c in keep)}, len(regexp_extract_all(text, {_quoted(T.WORD)})) AS n_words, coalesce(n_sent, 0) AS n_sent, length(text) AS n_chars,
  length(text) - length(replace(text, ';', '')) AS semicolons, length(text) - length(replace(text, ',', '')) AS commas, length({quotes}) AS quotes,
  coalesce(questions, 0) AS questions, coalesce(exclaims, 0) AS exclaims, len(regexp_extract_all(text, {_quoted(EXISTENTIAL)})) AS n_exist, len(regexp_extract_all(text, {_quoted(COPULA)})) AS n_cop,
  regexp_matches(text, '[.!?]') AS has_end, len(regexp_extract_all(text, '\\S+')) AS blank_words, text FROM src LEFT JOIN senc ON src.doc_id = senc.doc_id),
lex AS ({lexicon.values_sql()})"""
