"""The document features as SQL over {wide}, one row of counts per document.

Here {wide} comes from one pass over the texts (operators/wide.py), so a feature
is a projection without a join or a shuffle.  For another engine WIDE_SQL makes
the same row from relations of sentences and words: an independent form of every
count.  Values below the 150-word envelope are
null where the feature is gated, and 0 or a number where it is not.
"""

from __future__ import annotations

import re

from ..functions.lexicon import EXTENDED, RELATIONS, bit
from ..functions.measure import PHRASES, SUBORDINATORS

D = 8  # digits that results are rounded to
MIN_WORDS = 150


def flag(name: str) -> str:
    return f"(coalesce(l.bits, 0) & {bit(name)}) <> 0"


def hits(name: str) -> str:
    return f"sum(CASE WHEN {flag(name)} THEN c ELSE 0 END)"


def entropy(counts: list[str], total: str) -> str:
    return " + ".join(f"(CASE WHEN {c} > 0 THEN -(({c}) / CAST({total} AS DOUBLE)) * log2(({c}) / CAST({total} AS DOUBLE)) ELSE 0.0 END)" for c in counts)


def fields(sql: str) -> str:
    """The columns besides doc_id of a query of the form SELECT d.doc_id, ... FROM {wide} d."""
    begin, end = "SELECT d.doc_id, ", " FROM {wide} d"
    return sql.replace("\nFROM {wide} d", end).strip().removeprefix(begin).removesuffix(end)


#: Compact class of a word: list classes first, then the -ing / -ed fallback unless a deny list holds the word.
KIND = "CASE WHEN l.cls BETWEEN 1 AND 6 THEN l.cls WHEN l.cls >= 7 THEN 0 WHEN f.word LIKE '%ing' AND length(f.word) > 5 THEN 6 WHEN f.word LIKE '%ed' AND length(f.word) > 4 THEN 6 ELSE 0 END"

_COUNTS = f"""counts AS (SELECT f.doc_id, sum(c) AS n, count(*) AS types, sum(c * length(f.word)) AS letters, sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS hapax, sum(c * c) AS c2, sum(p) AS p1, sum(p * p) AS p2,
  {", ".join(f"sum(CASE WHEN {KIND} = {k} THEN c ELSE 0 END) AS k{k}" for k in range(1, 7))},
  {", ".join(f"sum(CASE WHEN coalesce(l.ext, 0) = {k} THEN c ELSE 0 END) AS e{k}" for k in range(1, 7))},
  {", ".join(f"{hits(x)} AS {x}" for x in "pron modal neg sub1 xmodal hedge boost xpron demon defart addc advc cauc temc".split())},
  sum(CASE WHEN NOT {flag("stop")} AND length(f.word) > 2 THEN c ELSE 0 END) AS content, sum(CASE WHEN NOT {flag("stop")} AND length(f.word) > 2 THEN 1 ELSE 0 END) AS content_types,
  sum(CASE WHEN NOT {flag("stop")} AND length(f.word) > 2 AND s0 < s1 THEN 1 ELSE 0 END) AS repeated_types
  FROM {{freq}} f LEFT JOIN {{lex}} l ON f.word = l.word GROUP BY f.doc_id)"""

GATE = f"CASE WHEN d.n_words >= {MIN_WORDS} THEN"


def r(x: str) -> str:
    return f"round({x}, {D})"


WORD_COUNTS = "SELECT d.doc_id, d.n_words, d.n_sent, d.blank_words FROM {wide} d"

COHESION = f"""SELECT d.doc_id, {GATE} {r("d.types / CAST(d.n_words AS DOUBLE)")} END AS type_token_ratio, {GATE} {r("d.pron * 100.0 / CAST(d.n_words AS DOUBLE)")} END AS pronoun_density,
  {GATE} CASE WHEN d.content_types > 0 THEN {r("d.repeated_types / CAST(d.content_types AS DOUBLE)")} ELSE 0.0 END END AS lexical_repetition FROM {{wide}} d"""

REGISTER = f"""SELECT d.doc_id, {r("coalesce(d.content_types, 0) / CAST(greatest(coalesce(d.content, 0), 1) AS DOUBLE)")} AS lexical_novelty, CASE WHEN coalesce(d.len_m, 0) < 2 THEN 0.0 ELSE {r("(d.len_m * d.len_s2 - d.len_s1 * d.len_s1) / CAST(d.len_m * d.len_m AS DOUBLE)")} END AS sentence_length_variance,
  CASE WHEN d.n_words = 0 THEN 0.0 ELSE {r("d.modal * 100.0 / CAST(d.n_words AS DOUBLE)")} END AS modal_density, CASE WHEN d.n_words = 0 THEN 0.0 ELSE {r("d.neg * 100.0 / CAST(d.n_words AS DOUBLE)")} END AS negation_density
FROM {{wide}} d"""

_RELATIONAL = "(d.k4 + greatest(0, d.k3 - d.n_cop))"
_SIX = ["d.k1", "d.k2", _RELATIONAL, "d.k5", "d.k6", "d.n_exist"]
_ALL = " + ".join(_SIX)
SFL = f"""SELECT d.doc_id, {GATE} CASE WHEN {_ALL} = 0 THEN 0.0 ELSE {r(entropy(_SIX, f"({_ALL})"))} END END AS process_proxy_entropy,
  {GATE} {r(f"({_RELATIONAL} + d.n_exist) / CAST(greatest(d.k1 + d.k2 + d.k6, 1) AS DOUBLE)")} END AS stative_active_ratio, {GATE} {r("(d.k1 + d.k2) * 100.0 / CAST(d.n_words AS DOUBLE)")} END AS projection_frequency FROM {{wide}} d"""

SFL_TRACE = f"""SELECT d.doc_id, {", ".join(f"CAST({x} AS BIGINT) AS {n}" for n, x in [("mental", "coalesce(k1, 0)"), ("verbal", "coalesce(k2, 0)"), ("relational", "greatest(0, coalesce(k3 + k4, 0) - d.n_cop)"), ("behavioral", "coalesce(k5, 0)"), ("existential", "d.n_exist"), ("material", "coalesce(k6, 0)"), ("debit", "d.n_cop")])}
FROM {{wide}} d"""

STYLOMETRY = f"""SELECT d.doc_id, {", ".join(f"CASE WHEN d.n_sent > 0 AND d.n_words > 0 THEN {r(x)} END AS {n}" for n, x in [("semicolon_per_1k_words", "semicolons * 1000.0 / CAST(d.n_words AS DOUBLE)"), ("comma_per_sentence", "commas / CAST(d.n_sent AS DOUBLE)"), ("question_rate", "questions / CAST(d.n_sent AS DOUBLE)"), ("exclamation_rate", "exclaims / CAST(d.n_sent AS DOUBLE)"), ("quotation_density", "quotes * 1000.0 / CAST(greatest(n_chars, 1) AS DOUBLE)")])} FROM {{wide}} d"""

SUBORDINATION = f"""SELECT d.doc_id, CASE WHEN d.n_words > 0 THEN {r("coalesce(d.sub_hits, 0) * 1000.0 / CAST(d.n_words AS DOUBLE)")} END AS subordination_density FROM {{wide}} d"""
COMPRESSION = f"""SELECT d.doc_id, {r("d.lz")} AS compression_ratio FROM {{wide}} d"""
COMPRESSION_GATED = f"""SELECT d.doc_id, {GATE} {r("d.lz")} END AS compression_ratio FROM {{wide}} d"""

DIST_TYPES = f"""SELECT d.doc_id, {GATE} {r("hapax / CAST(types AS DOUBLE)")} END AS hapax_ratio, {GATE} {r("10000.0 * (c2 - n) / CAST(n * n AS DOUBLE)")} END AS yule_k,
  {GATE} {r("((n * p1 - p2) / 2.0) / (CAST(n AS DOUBLE) * (n * n - 1) / 12.0) / n")} END AS growth_slope, {GATE} {r("letters / CAST(n AS DOUBLE)")} END AS mean_word_length FROM {{wide}} d"""

DIST_MATTR = f"""SELECT d.doc_id, {GATE} {r("d.mattr_total / CAST((d.n_words - 99) * 100 AS DOUBLE)")} END AS mattr FROM {{wide}} d"""
DIST_BIGRAM = f"""SELECT d.doc_id, {GATE} {r("log2(CAST(d.n_words - 1 AS DOUBLE)) - d.bg_s / (d.n_words - 1)")} END AS bigram_entropy FROM {{wide}} d"""
DIST_HALFLIFE = f"""SELECT d.doc_id, {GATE} coalesce({r("d.half_pos / CAST(d.n_words - 1 AS DOUBLE)")}, 0.5) END AS repetition_halflife FROM {{wide}} d"""
DIST_BURSTINESS = f"""SELECT d.doc_id, {GATE} coalesce({r("d.burst")}, 0.0) END AS burstiness FROM {{wide}} d"""
DIST_SENTENCES = f"""SELECT d.doc_id, {GATE} {r("abs(log2(CAST(d.len_m AS DOUBLE)) - d.sb_s / d.len_m)")} END AS sentence_length_entropy FROM {{wide}} d"""
DIST_CHARS = f"""SELECT d.doc_id, {GATE} {r("log2(CAST(d.ch_n AS DOUBLE)) - d.ch_s / d.ch_n")} END AS char_entropy, {GATE} CASE WHEN n_chars < 20 THEN 0.0 ELSE {r("d.drift")} END END AS entropy_drift FROM {{wide}} d"""

_CLASSIFIED = "(e1 + e2 + e3 + e4 + e5 + e6)"
_W = "CAST(d.n AS DOUBLE)"
EXT_SFL = f"""SELECT d.doc_id, {", ".join(f"coalesce({r(f'e{k} / CAST(nullif({_CLASSIFIED}, 0) AS DOUBLE)')}, 0.0) AS pct_{name}" for k, name in enumerate(EXTENDED) if k)},
  {", ".join(f"coalesce({r(f'{x} * 100.0 / {_W}')}, 0.0) AS {n}" for n, x in [("process_density", _CLASSIFIED), ("modal_density", "xmodal"), ("hedge_density", "hedge"), ("booster_density", "boost")])},
  coalesce({r("(boost - hedge) / CAST(nullif(boost + hedge, 0) AS DOUBLE)")}, 0.0) AS modality_balance FROM {{wide}} d"""

_STEM = "CASE WHEN length(word) < 5 THEN word " + " ".join(f"WHEN word LIKE '%{s}' AND length(word) >= {len(s) + 3} THEN substr(word, 1, length(word) - {len(s)})" for s in "ingly ation ions ing ies ied ed es s ly".split()) + " ELSE word END"
EXT_COHESION = f"""SELECT d.doc_id, {", ".join(f"coalesce({r(f'{x} * 100.0 / {_W}')}, 0.0) AS {n}" for n, x in [("pronoun_density", "xpron"), ("demonstrative_density", "demon"), ("definite_article_density", "defart"), ("reference_density", "(xpron + demon + defart)"), ("additive_density", "addc"), ("adversative_density", "advc"), ("causal_density", "cauc"), ("temporal_density", "temc")])},
  coalesce({r("advc / CAST(nullif(addc + advc, 0) AS DOUBLE)")}, 0.0) AS conjunction_balance, coalesce({r("d.stems / CAST(d.st_n AS DOUBLE)")}, 0.0) AS type_token_ratio, coalesce({r("d.again / CAST(d.stems AS DOUBLE)")}, 0.0) AS lexical_repetition_rate,
  coalesce({r("d.chains / CAST(nullif(d.n_sent, 0) AS DOUBLE)")}, 0.0) AS lexical_chain_count, coalesce({r("d.span / CAST(greatest(d.n_sent - 1, 1) AS DOUBLE) / nullif(d.chains, 0)")}, 0.0) AS lexical_chain_span
FROM {{wide}} d"""

RST = f"""SELECT d.doc_id, {", ".join(f"CASE WHEN d.n_words >= {MIN_WORDS} AND d.has_end AND d.n_sent > 0 THEN {r(f'd.{x} / CAST(d.n_sent AS DOUBLE)')} END AS {n}" for n, x in [("marker_density", "markers"), ("elaboration_marker_density", "elaboration"), ("contrast_marker_density", "contrast")])} FROM {{wide}} d"""

_REL9 = [f"d.r{k}" for k in range(1, 10)]
EXT_RST = f"""SELECT d.doc_id, {", ".join(f"coalesce({r(f'd.r{k + 1} / CAST(nullif(d.n_sent, 0) AS DOUBLE)')}, 0.0) AS {name}_density" for k, name in enumerate(RELATIONS))}, coalesce({r("d.rel_total / CAST(nullif(d.n_sent, 0) AS DOUBLE)")}, 0.0) AS total_marker_density,
  coalesce({r("(" + entropy(_REL9, "d.rel_total") + ") / log2(CAST(9 AS DOUBLE))")}, 0.0) AS relation_diversity, coalesce({r("d.switches / CAST(nullif(d.pairs, 0) AS DOUBLE)")}, 0.0) AS branching_score, coalesce({r("d.deep / CAST(nullif(d.n_sent, 0) AS DOUBLE)")}, 0.0) AS max_depth_score
FROM {{wide}} d"""

# ---- the parts of {wide} as SQL over the relations of base.py, for another engine

_CATS = ["i_elab", "i_contrast", "i_cause", "i_result", "i_cond", "i_joint"]
_HIT = f"m AS (SELECT t.doc_id, t.sent, t.pos, CASE WHEN l.rel = 5 AND (l.bits & {bit('broad')}) <> 0 AND w.n < 8 THEN 0 ELSE coalesce(l.rel, 0) END AS rel FROM tok t LEFT JOIN lex l ON t.word = l.word JOIN (SELECT doc_id, sent, count(*) AS n FROM tok GROUP BY doc_id, sent) w ON t.doc_id = w.doc_id AND t.sent = w.sent)"
_LOGS = "sum(c * log2(CAST(c AS DOUBLE)))"
_SPACED = "array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z]+(?:[''’-][a-z]+)*'), lambda w: ' ' || replace(w, '’', '''') || ' '), '')"
_PHRASES = "|".join("  ".join(p) for p in PHRASES)
#: part -> (common table expressions, of which the last has one row per document; its columns)
WIDE_SQL: dict[str, tuple[str, str]] = {
    "counts": (_COUNTS.replace("{{freq}}", "freq").replace("{{lex}}", "lex").replace("{freq}", "freq").replace("{lex}", "lex"), "counts"),
    "len": (
        f"""sl AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM sen), slb AS (SELECT doc_id, {_LOGS} AS sb_s FROM (SELECT doc_id, CASE WHEN n <= 5 THEN 1 WHEN n <= 10 THEN 2 WHEN n <= 15 THEN 3 WHEN n <= 20 THEN 4 WHEN n <= 30 THEN 5 ELSE 6 END AS bin, count(*) AS c FROM sl GROUP BY 1, 2) GROUP BY doc_id),
lens AS (SELECT sl.doc_id, count(*) AS len_m, sum(n) AS len_s1, sum(n * n) AS len_s2, max(sb_s) AS sb_s FROM sl JOIN slb ON sl.doc_id = slb.doc_id GROUP BY sl.doc_id)""",
        "lens",
    ),
    "cue": (
        f"""cs AS (SELECT q.doc_id, q.sent, {", ".join(f"CASE WHEN (coalesce(l.bits, 0) & {bit(x)}) <> 0 AND ((coalesce(l.bits, 0) & {bit('init_only')}) = 0 OR q.first_word = q.marker)" + (f" AND ((coalesce(l.bits, 0) & {bit('broad')}) = 0 OR q.blanks >= 8)" if x == "i_elab" else "") + f" THEN 1 ELSE 0 END AS {x}" for x in _CATS)}, q.but, q.gloss FROM cue q LEFT JOIN lex l ON q.marker = l.word),
cues AS (SELECT doc_id, sum(greatest(i_elab, gloss)) AS elaboration, sum(greatest(i_contrast, but)) AS contrast, sum(greatest(i_elab, gloss) + greatest(i_contrast, but) + i_cause + i_result + i_cond + i_joint) AS markers FROM cs GROUP BY doc_id)""",
        "cues",
    ),
    "rel": (
        f"""{_HIT}, rf AS (SELECT doc_id, sent, rel, min(pos) AS p FROM m WHERE rel > 0 GROUP BY doc_id, sent, rel UNION ALL SELECT q.doc_id, q.sent, 5 AS rel, 1000000000 AS p FROM cue q WHERE q.xgloss = 1),
rg AS (SELECT doc_id, sent, rel, min(p) AS p FROM rf GROUP BY doc_id, sent, rel),
dom AS (SELECT doc_id, sent, rel, row_number() OVER (PARTITION BY doc_id, sent ORDER BY p) AS k FROM rg),
seq AS (SELECT q.doc_id, q.sent, dom.rel, lag(dom.rel) OVER (PARTITION BY q.doc_id ORDER BY q.sent) AS prev FROM cue q LEFT JOIN dom ON q.doc_id = dom.doc_id AND q.sent = dom.sent AND dom.k = 1),
isl AS (SELECT doc_id, sent, rel, prev, sum(CASE WHEN rel = prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY sent ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM seq),
runs AS (SELECT doc_id, run, count(*) AS n FROM isl WHERE rel IS NOT NULL GROUP BY doc_id, run), dp AS (SELECT doc_id, max(n) AS deep FROM runs GROUP BY doc_id),
br AS (SELECT doc_id, sum(CASE WHEN rel IS NOT NULL AND prev IS NOT NULL THEN 1 ELSE 0 END) AS pairs, sum(CASE WHEN rel <> prev THEN 1 ELSE 0 END) AS switches FROM seq GROUP BY doc_id),
rt AS (SELECT doc_id, count(*) AS rel_total, {", ".join(f"sum(CASE WHEN rel = {k} THEN 1 ELSE 0 END) AS r{k}" for k in range(1, 10))} FROM rg GROUP BY doc_id),
rels AS (SELECT br.doc_id, pairs, switches, deep, rt.* EXCLUDE (doc_id) FROM br LEFT JOIN dp ON br.doc_id = dp.doc_id LEFT JOIN rt ON br.doc_id = rt.doc_id)""",
        "rels",
    ),
    "stems": (
        f"""st AS (SELECT doc_id, stem, sent, count(*) AS c FROM (SELECT t.doc_id, t.sent, t.word, l.bits, {_STEM.replace("word", "t.word")} AS stem FROM tok t LEFT JOIN lex l ON t.word = l.word) x WHERE length(word) >= 3 AND (coalesce(bits, 0) & {bit("stop")}) = 0 GROUP BY doc_id, stem, sent),
ss AS (SELECT doc_id, stem, sum(c) AS c, count(*) AS m, min(sent) AS lo, max(sent) AS hi FROM st GROUP BY doc_id, stem),
stemmed AS (SELECT doc_id, sum(c) AS st_n, count(*) AS stems, sum(CASE WHEN m >= 2 THEN 1 ELSE 0 END) AS again, sum(CASE WHEN m >= 3 THEN 1 ELSE 0 END) AS chains, sum(CASE WHEN m >= 3 THEN hi - lo ELSE 0 END) AS span FROM ss GROUP BY doc_id)""",
        "stemmed",
    ),
    "spread": (
        f"""mw AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id, word ORDER BY pos) AS prev FROM tok),
ms AS (SELECT mw.doc_id, sum(greatest(0, least(mw.pos, d.n_words - 100) - greatest(mw.pos - 99, coalesce(mw.prev + 1, 0), 0) + 1)) AS mattr_total FROM mw JOIN doc d ON mw.doc_id = d.doc_id WHERE d.n_words >= {MIN_WORDS} GROUP BY mw.doc_id),
bg AS (SELECT doc_id, pos, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM tok),
bs AS (SELECT doc_id, {_LOGS} AS bg_s FROM (SELECT doc_id, word, next, count(*) AS c FROM bg WHERE next IS NOT NULL GROUP BY doc_id, word, next) GROUP BY doc_id),
bo AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, word, next ORDER BY pos) AS k FROM bg WHERE next IS NOT NULL),
bq AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc_id) AS m FROM bo WHERE k = 2), bh AS (SELECT doc_id, min(pos) AS half_pos FROM bq WHERE 2 * i >= m GROUP BY doc_id),
ranked AS (SELECT doc_id, word, c, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, p) AS k FROM freq WHERE length(word) >= 3), top AS (SELECT doc_id, word FROM ranked WHERE k <= 20 AND c >= 3),
gaps AS (SELECT t.doc_id, t.word, pos - lag(pos) OVER (PARTITION BY t.doc_id, t.word ORDER BY pos) AS gap FROM tok t JOIN top ON t.doc_id = top.doc_id AND t.word = top.word),
gone AS (SELECT doc_id, word, avg(gap) AS mu, stddev_pop(gap) AS sigma FROM gaps WHERE gap IS NOT NULL GROUP BY doc_id, word), two AS (SELECT doc_id, avg((sigma - mu) / (sigma + mu)) AS burst FROM gone GROUP BY doc_id),
spreads AS (SELECT bs.doc_id, mattr_total, bg_s, half_pos, burst FROM bs LEFT JOIN ms ON bs.doc_id = ms.doc_id LEFT JOIN bh ON bs.doc_id = bh.doc_id LEFT JOIN two ON bs.doc_id = two.doc_id)""",
        "spreads",
    ),
    "sub": (
        f"""sp AS (SELECT doc_id, {_SPACED} AS w FROM sen), subs AS (SELECT doc_id, sum(len(regexp_extract_all(w, ' ({_PHRASES}) ')) + len(regexp_extract_all(regexp_replace(w, ' ({_PHRASES}) ', '|', 'g'), ' ({"|".join(sorted(SUBORDINATORS))}) '))) AS sub_hits FROM sp GROUP BY doc_id)""",
        "subs",
    ),
    "letters": (
        f"""lh AS (SELECT doc_id, half, ch, count(*) AS c FROM letters GROUP BY doc_id, half, ch), lw AS (SELECT doc_id, ch, sum(c) AS c FROM lh GROUP BY doc_id, ch), la AS (SELECT doc_id, sum(c) AS ch_n, {_LOGS} AS ch_s FROM lw GROUP BY doc_id),
le AS (SELECT doc_id, half, log2(CAST(sum(c) AS DOUBLE)) - {_LOGS} / sum(c) AS e FROM lh GROUP BY doc_id, half),
lettered AS (SELECT la.doc_id, ch_n, ch_s, drift FROM la JOIN (SELECT doc_id, abs(coalesce(sum(CASE WHEN half = 0 THEN e END), 0.0) - coalesce(sum(CASE WHEN half = 1 THEN e END), 0.0)) AS drift FROM le GROUP BY doc_id) p ON la.doc_id = p.doc_id)""",
        "lettered",
    ),
}


def wide_sql(parts: tuple[str, ...]) -> str:
    """The common table expressions up to wide, with the parts asked for."""
    names = [WIDE_SQL[p][1] for p in parts]
    own = ", ".join(["d.*", *(f"{n}.* EXCLUDE (doc_id)" for n in names)])
    made = [WIDE_SQL[p][0] for p in parts]
    odd = "(length(d.text) - length(replace(d.text, '\"', ''))) % 2 = 1 OR length(replace(d.text, '“', '')) <> length(replace(d.text, '”', ''))"
    return ", ".join([*made, f"wide AS (SELECT {own}, {odd} AS odd_quotes, false AS open_fence FROM doc d " + " ".join(f"LEFT JOIN {n} ON d.doc_id = {n}.doc_id" for n in names) + ")"])


_RULES = ["default", "lexicon_mental", "lexicon_verbal", "lexicon_copula_be", "lexicon_relational", "lexicon_behavioral", "lexicon_material", "denylist_plural_noun", "denylist_adjectival_participle", "denylist_non_process"]
_SHOWN = ["none", "mental", "verbal", "relational", "relational", "behavioral", "material", "none", "none", "none"]
_CODE = "CASE WHEN l.cls >= 1 THEN l.cls WHEN f.word LIKE '%ing' AND length(f.word) > 5 THEN 10 WHEN f.word LIKE '%ed' AND length(f.word) > 4 THEN 11 ELSE 0 END"
#: One row per token: its class and the rule that gave it.
TOKEN_TRACE = f"""SELECT /*+ BROADCAST(l) */ f.doc_id, f.pos, f.word, CASE {_CODE} {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_SHOWN))} ELSE 'material' END AS classification,
  CASE {_CODE} {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_RULES))} WHEN 10 THEN 'morphology_ing' ELSE 'morphology_ed' END AS rule FROM {{tok}} f LEFT JOIN {{lex}} l ON f.word = l.word"""

TOP_WORDS = "SELECT doc_id, word, c, CAST(k AS BIGINT) AS place FROM (SELECT doc_id, word, c, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, p) AS k FROM {freq} WHERE length(word) >= 3) x WHERE k <= 20"

def prefixed(view: str, *parts: str) -> str:
    """The columns of feature queries with the name of their view before them."""
    return ", ".join(re.sub(r"\bAS (\w+)(?=,|$)", rf"AS {view}_\1", fields(p)) for p in parts)


_SHAPER, _EXTENDED, _STYLE = prefixed("shaper", SFL, RST, COHESION, REGISTER), prefixed("extended", EXT_SFL, EXT_RST, EXT_COHESION), prefixed("stylometry", STYLOMETRY, SUBORDINATION)
_DISTRIBUTIONAL = prefixed("distributional", DIST_TYPES, DIST_CHARS, DIST_BIGRAM, DIST_SENTENCES, DIST_BURSTINESS, DIST_HALFLIFE, DIST_MATTR)
#: Every feature of a document's joint reading but the two compression ratios, which SQL can't count: 13 compact, 37 extended, 6 stylometric and 11 distributional ones; with them 69.
JOINT = ", ".join([_SHAPER, _EXTENDED, _STYLE, _DISTRIBUTIONAL])
EVERY = ", ".join([JOINT, prefixed("stylometry", COMPRESSION), prefixed("distributional", COMPRESSION_GATED)])
#: The 57 that references are fitted on.
FLAT = ", ".join([_SHAPER, _EXTENDED, _STYLE, prefixed("stylometry", COMPRESSION)])
FLAT_NAMES = re.findall(r"\bAS ((?:shaper|extended|stylometry)_\w+)", FLAT)

#: Upper ends of the fixed scales of the flat embedding, in the order of the compact reading.
SCALES = {"process_proxy_entropy": 2.2, "stative_active_ratio": 3.0, "projection_frequency": 6.0, "marker_density": 1.0, "elaboration_marker_density": 1.0, "contrast_marker_density": 1.0, "type_token_ratio": 1.0, "pronoun_density": 15.0, "lexical_repetition": 1.0, "lexical_novelty": 1.0, "sentence_length_variance": 10.0, "modal_density": 5.0, "negation_density": 5.0}
