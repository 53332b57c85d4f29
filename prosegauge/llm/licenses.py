"""License scans by canonical digest lookup.

A text is folded to lower case and unwrapped, its copyright statements are
dropped, equivalent spellings are made one, everything but letters and digits becomes one blank, and
the MD5 of the whole rest is looked up among the digests of known licences.  The
known side is a catalogue of a few hundred rows at most (CATALOGUE, checked), so
it is broadcast; the corpus is scanned once and never shuffled.

A copyright statement is a sign ("copyright", "(c)", ©) with a year or a holder
after it, wherever lines break, up to the end of its paragraph or the words that
open a licence, and within EXTENT characters; without such an end only the sign
and the year go.  Words such as "copyright holders" in the text stay.

Defined results: a null text counts as empty; what folds to nothing has the
digest of the empty text and no licence; if two catalogue entries fold alike,
the name that sorts first is given; repeated rows are looked up alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE = 2_000
#: One spelling for each family; applied in order to lower-case text.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("favour", "favor"), ("merchantib", "merchantab"), ("non-infring", "noninfring"), ("non infring", "noninfring"), ("whilst", "while"), ("analogue", "analog"), ("fulfilment", "fulfillment"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("http://", "https://"), ("&", " and "), ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"')]
#: Most characters of a copyright statement after its sign and year.
EXTENT = 240
#: Applied before all else: marks of comments at the beginnings of lines, then blank lines as a control character, then all white space as one blank.
_UNWRAP = [(r"(^|\n)[ \t]*([*#;]+|//+|--+|\.\.)[ \t]*", "\n"), (r"\n[ \t\r\f]*\n\s*", " \x01 "), (r"\s+", " ")]
_YEAR = r"[\[<{(]?\s?((19|20)\d\d|years?\b|yyyy|xxxx|dates?\b)"
_SIGN = rf"(\bcopyright:? ?(\(c\)|©|&copy;),? ?({_YEAR})?|\bcopyright:? ?{_YEAR}|(©|&copy;) ?({_YEAR})?|\(c\) ?{_YEAR})"
_END = r"(\x01|$|\b(all rights reserved|permission is|permission to|redistribution and|licensed under|this (program|software|library|file|work|document|is free|license)|everyone is permitted|the (program|software|work) is|you may))"
_COPYRIGHT = [(rf"{_SIGN}[^\x01]{{0,{EXTENT}}}?{_END}", r" \9"), (_SIGN, " ")]
_RIGHTS = r"all rights reserved\.?"
_OTHER = r"[^\p{L}\p{N}]+"


def _groups(pattern: str) -> int:
    return re.compile(pattern).groups


# the end is put back, since it is text or holds a paragraph's end
_COPYRIGHT[0] = (_COPYRIGHT[0][0], f" \\{_groups(_SIGN) + 1} ")
_STEPS = [*_UNWRAP, *_COPYRIGHT, (_RIGHTS, " ")]


def canonical(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    for pattern, by in _STEPS:
        t = F.regexp_replace(t, pattern, by.replace("\\", "$"))
    t = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SPELLINGS, t)
    return F.trim(F.regexp_replace(t, _OTHER, " "))


def digest(text: Column) -> Column:
    return F.md5(canonical(text).cast("binary"))


def known_texts() -> list[tuple[str, str]]:
    """(name, text) of the licences shipped as text files."""
    folder = Path(__file__).with_name("license_texts")
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt"))]


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license_id: one row per canonical text."""
    texts = known_texts() if texts is None else texts
    if len(texts) > CATALOGUE:
        raise ValueError(f"a catalogue of more than {CATALOGUE} licences")
    rows = spark.createDataFrame(texts, "license_id string, text string").where(canonical(F.col("text")) != "")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id (null if unknown) of every document."""
    slim = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    return slim.join(F.broadcast(known(docs.sparkSession, texts)), "digest", "left").select("doc_id", "digest", "license_id")


def oracle_sql(texts: list[tuple[str, str]] | None = None) -> str:
    """The scan as SQL over a view documents(doc_id, text)."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    t = "lower(coalesce(text, ''))"
    for pattern, by in _STEPS:
        t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(by)}, 'g')"
    for a, b in SPELLINGS:
        t = f"replace({t}, {quoted(a)}, {quoted(b)})"
    folded = f"trim(regexp_replace({t}, {quoted(_OTHER)}, ' ', 'g'))"
    values = ", ".join(f"({quoted(n)}, {quoted(x)})" for n, x in (known_texts() if texts is None else texts))
    return (
        f"WITH raw(license_id, text) AS (VALUES {values}), known AS (SELECT md5(t) AS digest, min(license_id) AS license_id FROM (SELECT license_id, {folded} AS t FROM raw) WHERE t <> '' GROUP BY 1), "
        f"docs AS (SELECT doc_id, md5({folded}) AS digest FROM documents) SELECT doc_id, docs.digest AS digest, license_id FROM docs LEFT JOIN known ON docs.digest = known.digest"
    )
