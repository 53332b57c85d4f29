"""Equal-word slices, their feature curves, labels, arcs and flags as SQL.

{ww} has one row per white-space word (doc_id, k, w), {wt} one row per word
token inside it (doc_id, k, word).  Tokens never cross white space, so a slice
of white-space words is a slice of tokens.
"""

from __future__ import annotations

from ..functions import text as T
from ..functions.lexicon import bit
from .features import r

MIN_SLICE = 150

_SIZED = f"sized AS (SELECT doc_id, n, CASE WHEN n < {MIN_SLICE} THEN 1 ELSE CAST(floor(n / CAST({MIN_SLICE} AS DOUBLE)) AS BIGINT) END AS n_slices FROM (SELECT doc_id, count(*) AS n FROM {{ww}} GROUP BY doc_id) x)"
_CUT = f"""{_SIZED}, cut AS (SELECT doc_id, n, n_slices, CAST(floor(n / CAST(n_slices AS DOUBLE)) AS BIGINT) AS chunk FROM sized),
placed AS (SELECT w.doc_id, w.k, w.w, c.n_slices, least(CAST(floor(w.k / CAST(c.chunk AS DOUBLE)) AS BIGINT), c.n_slices - 1) AS slice FROM {{ww}} w JOIN cut c ON w.doc_id = c.doc_id)"""

SLICES = f"WITH {_CUT} SELECT doc_id, slice, n_slices, count(*) AS words, min(k) AS first_word, max(k) AS last_word FROM placed GROUP BY doc_id, slice, n_slices"

_ABBREVIATED = ", ".join(f"'{a}'" for a in T.ABBREVIATIONS)
TRAJECTORY = f"""WITH {_CUT},
lagged AS (SELECT *, lag(w) OVER (PARTITION BY doc_id, slice ORDER BY k) AS before FROM placed),
starts AS (SELECT doc_id, slice, n_slices, k, CASE WHEN before IS NULL THEN 0 WHEN {{ends}} AND {{capital}} AND NOT {{short}} IN ({_ABBREVIATED}) THEN 1 ELSE 0 END AS new FROM lagged),
sents AS (SELECT doc_id, slice, n_slices, sum(new) OVER (PARTITION BY doc_id, slice ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM starts),
lens AS (SELECT doc_id, slice, n_slices, s, count(*) AS n FROM sents GROUP BY doc_id, slice, n_slices, s),
var AS (SELECT doc_id, slice, n_slices, CASE WHEN count(*) < 2 THEN 0.0 ELSE (count(*) * sum(n * n) - sum(n) * sum(n)) / CAST(count(*) * count(*) AS DOUBLE) END AS variance FROM lens GROUP BY doc_id, slice, n_slices),
toks AS (SELECT /*+ BROADCAST(l) */ t.doc_id, p.slice, t.word, coalesce(l.bits, 0) AS bits FROM {{wt}} t JOIN placed p ON t.doc_id = p.doc_id AND t.k = p.k LEFT JOIN {{lex}} l ON t.word = l.word),
dens AS (SELECT doc_id, slice, count(*) AS n, sum(CASE WHEN (bits & {bit("modal")}) <> 0 THEN 1 ELSE 0 END) AS modal, sum(CASE WHEN (bits & {bit("neg")}) <> 0 THEN 1 ELSE 0 END) AS neg FROM toks GROUP BY doc_id, slice),
types AS (SELECT doc_id, slice, word FROM toks WHERE (bits & {bit("stop")}) = 0 AND length(word) > 2 GROUP BY doc_id, slice, word),
firsts AS (SELECT *, min(slice) OVER (PARTITION BY doc_id, word) AS first_slice FROM types),
nov AS (SELECT doc_id, slice, sum(CASE WHEN slice = first_slice THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS novelty FROM firsts GROUP BY doc_id, slice)
SELECT v.doc_id, v.slice, v.n_slices, CASE WHEN v.slice = 0 THEN NULL ELSE coalesce({r("nov.novelty")}, 0.0) END AS novelty, {r("v.variance")} AS variance,
  coalesce({r("d.modal * 100.0 / CAST(d.n AS DOUBLE)")}, 0.0) AS modal, coalesce({r("d.neg * 100.0 / CAST(d.n AS DOUBLE)")}, 0.0) AS negation
FROM var v LEFT JOIN dens d ON v.doc_id = d.doc_id AND v.slice = d.slice LEFT JOIN nov ON v.doc_id = nov.doc_id AND v.slice = nov.slice"""

DIMENSIONS = ["novelty", "variance", "modal", "negation"]
_BY = "(PARTITION BY doc_id ORDER BY slice)"
_UP = "(PARTITION BY doc_id ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

DELTAS = f"SELECT doc_id, slice, {', '.join(f'{r(f'{x} - lag({x}) OVER {_BY}')} AS {x}_delta' for x in DIMENSIONS)} FROM {{traj}}"

_LONG = " UNION ALL ".join(f"SELECT doc_id, slice, '{x}' AS dimension, {x} AS v FROM {{traj}} WHERE {x} IS NOT NULL" for x in DIMENSIONS)
# values have eight digits, so sums of them are exact as integers; a tenth of their last digit keeps ties from turning on an engine's last bit
_SLOPE = "((count(*) * sum(i * u) - sum(i) * sum(u)) / CAST(nullif(count(*) * sum(i * i) - sum(i) * sum(i), 0) AS DOUBLE) / 1e8)"
ARC = f"""WITH lng AS ({_LONG}), k AS (SELECT *, CAST(round(v * 1e8) AS BIGINT) AS u, row_number() OVER (PARTITION BY doc_id, dimension ORDER BY slice) - 1 AS i, v - lag(v) OVER (PARTITION BY doc_id, dimension ORDER BY slice) AS step FROM lng)
SELECT doc_id, dimension, count(*) AS n, min_by(v, slice) AS start_value, max_by(v, slice) AS end_value,
  CASE WHEN count(*) >= 2 THEN round({_SLOPE} + sign({_SLOPE}) * 1e-10, 6) END AS slope, round(max(v) - min(v), 8) AS value_range,
  NOT (coalesce(max(step), 0.0) > 0 AND coalesce(min(step), 0.0) < 0) AS monotone FROM k GROUP BY doc_id, dimension"""

# every slice but the first has all four values, so the previous measurable slice is the previous row
LABELED = f"""labeled AS (SELECT *, CASE WHEN slice >= 2 THEN lag(novelty) OVER {_BY} END AS prev, lag(modal) OVER {_BY} AS lm, lead(modal) OVER {_BY} AS rm, avg(variance) OVER (PARTITION BY doc_id) AS mv, avg(negation) OVER (PARTITION BY doc_id) AS mn,
  CASE WHEN novelty < lag(novelty) OVER {_BY} THEN 1 ELSE 0 END AS fell FROM {{traj}}), seen AS (SELECT *, coalesce(max(fell) OVER {_UP}, 0) AS declined FROM labeled)"""
_BURST = "variance >= 2 * mv AND mv > 0 AND variance >= 300"
_NEG = "negation >= 2 * mn AND mn > 0 AND negation >= 0.1"
_REOPEN = "slice >= 2 AND novelty - prev >= 0.15 AND declined = 1"
LABELS = f"""WITH {LABELED} SELECT doc_id, slice, slice = 0 AS opening, slice = n_slices - 1 AS closing, coalesce(slice > 0 AND novelty >= 0.5, false) AS introduction,
  coalesce(slice > 0 AND novelty >= 0.2 AND novelty < 0.5 AND (prev IS NULL OR prev > novelty), false) AS elaboration, coalesce(slice > 0 AND novelty < 0.2, false) AS plateau, coalesce({_REOPEN}, false) AS reopen,
  coalesce({_BURST}, false) AS variance_burst, coalesce({_NEG}, false) AS negation_cluster,
  coalesce((lm IS NOT NULL OR rm IS NOT NULL) AND modal >= 0.5 AND (lm IS NULL OR modal > lm) AND (rm IS NULL OR modal > rm), false) AS hedging_peak FROM seen"""

FLAGS = f"""WITH {LABELED},
halves AS (SELECT doc_id, n_slices, CASE WHEN slice < CAST(floor(n_slices / 2.0) AS BIGINT) THEN 0 ELSE 1 END AS half, slice AS i, modal AS v FROM {{traj}} WHERE n_slices >= 4),
slopes AS (SELECT doc_id, half, (count(*) * sum(i * v) - sum(i) * sum(v)) / CAST(nullif(count(*) * sum(i * i) - sum(i) * sum(i), 0) AS DOUBLE) AS s FROM halves GROUP BY doc_id, half),
pivot2 AS (SELECT doc_id, round(max(CASE WHEN half = 0 THEN s END), 6) AS s1, round(max(CASE WHEN half = 1 THEN s END), 6) AS s2 FROM slopes GROUP BY doc_id),
f AS (SELECT doc_id, max(n_slices) AS n_slices, max(CASE WHEN {_REOPEN} THEN 1 ELSE 0 END) AS novelty_reopen, max(CASE WHEN novelty < 0.1 AND prev < 0.1 THEN 1 ELSE 0 END) AS novelty_collapse, max(CASE WHEN {_BURST} THEN 1 ELSE 0 END) AS variance_spike, max(CASE WHEN {_NEG} THEN 1 ELSE 0 END) AS negation_cluster FROM seen GROUP BY doc_id),
scale AS (SELECT doc_id, {", ".join(f"coalesce(nullif(max(abs({x})) OVER (PARTITION BY doc_id), 0), 1.0) AS s{k}" for k, x in enumerate(DIMENSIONS))}, {", ".join(f"{x} - lag({x}) OVER {_BY} AS d{k}" for k, x in enumerate(DIMENSIONS))} FROM {{traj}}),
dist AS (SELECT doc_id, round(sqrt({" + ".join(f"(d{k} / s{k}) * (d{k} / s{k})" for k in range(4))}), 8) AS d FROM scale),
ranked AS (SELECT doc_id, d, row_number() OVER (PARTITION BY doc_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS m FROM dist WHERE d IS NOT NULL),
mid AS (SELECT doc_id, max(m) AS m, max(d) AS top, max(CASE WHEN i = CAST(floor(m / 2.0) AS BIGINT) THEN d END) AS med FROM ranked GROUP BY doc_id)
SELECT d.doc_id, coalesce(f.novelty_reopen, 0) AS novelty_reopen, coalesce(f.novelty_collapse, 0) AS novelty_collapse, coalesce(f.variance_spike, 0) AS variance_spike, coalesce(f.negation_cluster, 0) AS negation_cluster,
  CASE WHEN p.s1 * p.s2 < 0 AND abs(p.s1 - p.s2) >= 0.3 THEN 1 ELSE 0 END AS modal_pivot, CASE WHEN mid.m >= 2 AND mid.med > 0 AND mid.top >= 2 * mid.med THEN 1 ELSE 0 END AS register_shift,
  CASE WHEN d.odd_quotes THEN 1 ELSE 0 END AS unbalanced_quotation, CASE WHEN d.n_words < {MIN_SLICE} THEN 1 ELSE 0 END AS below_envelope, CASE WHEN coalesce(f.n_slices, 1) < 2 THEN 1 ELSE 0 END AS trajectory_unmeasurable
FROM {{wide}} d LEFT JOIN f ON d.doc_id = f.doc_id LEFT JOIN pivot2 p ON d.doc_id = p.doc_id LEFT JOIN mid ON d.doc_id = mid.doc_id"""
