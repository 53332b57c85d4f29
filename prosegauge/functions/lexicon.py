"""The word table: one row per listed word, classes resolved by priority ahead of time.

cls: compact process class (MENTAL..MATERIAL; 7 to 9 are deny lists that only
stop the -ing/-ed fallback).  ext: extended process class.  rel: discourse
relation.  bits: list membership by FLAGS.  lists: membership in LISTS.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FLAGS = "pron stop modal neg sub1 xmodal hedge boost xpron demon defart addc advc cauc temc i_elab i_contrast i_cause i_result i_cond i_joint broad init_only".split()
LISTS = "cohesion_additive cohesion_adversative cohesion_causal cohesion_temporal existential_triggers processes_behavioral processes_material processes_mental processes_relational processes_verbal rst_cause rst_concession rst_condition rst_contrast rst_elaboration rst_elaboration_broad rst_purpose rst_result rst_sequence rst_summary stance_boosters stance_hedges stance_modal".split()
CLASSES = ["none", "mental", "verbal", "copula", "relational", "behavioral", "material", "plural_noun", "adjectival_participle", "non_process"]
EXTENDED = ["none", "material", "mental", "relational", "verbal", "behavioral", "existential"]
RELATIONS = ["contrast", "concession", "cause", "result", "elaboration", "sequence", "condition", "purpose", "summary"]


@lru_cache(maxsize=1)
def rows() -> list[tuple[str, int, int, int, int, int]]:
    text = Path(__file__).with_name("lexicon.tsv").read_text(encoding="utf-8")
    return [(w, *map(int, rest)) for w, *rest in (line.split("\t") for line in text.splitlines())]


def words(flag: str) -> list[str]:
    """The words of one flag or list, sorted."""
    if flag in FLAGS:
        return [r[0] for r in rows() if r[4] >> FLAGS.index(flag) & 1]
    return [r[0] for r in rows() if r[5] >> LISTS.index(flag) & 1]


def bit(flag: str) -> int:
    return 1 << FLAGS.index(flag)


def table(spark: SparkSession) -> DataFrame:
    """A fixed table of under 3,000 rows: always safe to broadcast."""
    return spark.createDataFrame([r[:5] for r in rows()], "word string, cls int, ext int, rel int, bits int")


def lists(spark: SparkSession) -> DataFrame:
    """lexicon, word: one row per membership."""
    return spark.createDataFrame([(name, w) for name in LISTS for w in words(name)], "lexicon string, word string")


def values_sql() -> str:
    """The table as a VALUES list for another SQL engine."""
    quoted = ", ".join("('{}', {}, {}, {}, {})".format(r[0].replace("'", "''"), *r[1:5]) for r in rows())
    return f"SELECT * FROM (VALUES {quoted}) AS t(word, cls, ext, rel, bits)"
