"""References, distances, calibration and control charts as SQL over a few relations.

Each language is a cohort, null being one.  All its documents form its
reference and all are measured against it, each without its own count in its
rank; they are its stream in the order of their ids.

{feat}: rid (a number of the row), doc_id, lang, n_words and four ungated
features.  {dist}: rid, doc_id, lang, x (the distance).  {xrank}, {frank},
{grank}, {wrank}, {irank}: different values v with their number c, the number le
of values up to them and n of all, of the distance by language, of a feature by
language, of a feature, of the words, and of the ids by language.  {stream}:
lang, i (place), doc_id, x, mu0, sigma0.  Here they are built by operators/ranks.py
and operators/charts.py, of which no step puts a whole cohort into one task; for
another engine SQL has them as windows.
"""

from __future__ import annotations

FEATURES = ["lexical_novelty", "sentence_length_variance", "modal_density", "negation_density"]
LONG = " UNION ALL ".join(f"SELECT rid, doc_id, lang, n_words, '{x}' AS feature, {x} AS v FROM {{feat}}" for x in FEATURES)
_SAME = "a.lang IS NOT DISTINCT FROM b.lang"

DIST = f"""WITH st AS (SELECT lang, {", ".join(f"avg({x}) AS m{k}, stddev_pop({x}) AS s{k}" for k, x in enumerate(FEATURES))} FROM {{feat}} GROUP BY lang)
SELECT a.rid, a.doc_id, a.lang, round(sqrt({" + ".join(f"coalesce(power((a.{x} - b.m{k}) / nullif(b.s{k}, 0), 2), 0.0)" for k, x in enumerate(FEATURES))}), 6) AS x FROM {{feat}} a JOIN st b ON {_SAME}"""


def ranks_sql(source: str, by: str, value: str) -> str:
    """The ranks of a relation for another engine."""
    own = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT {own}{value} AS v, count(*) AS c, CAST(sum(count(*)) OVER ({part}ORDER BY {value}) AS BIGINT) AS le, CAST(sum(count(*)) OVER ({part.strip()}) AS BIGINT) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY {own}{value}"


#: relation -> (the relation it ranks, by, value)
RANKS = {"xrank": ("dist", ("lang",), "x"), "frank": ("long", ("lang", "feature"), "v"), "grank": ("long", ("feature",), "v"), "wrank": ("feat", (), "n_words"), "irank": ("dist", ("lang",), "doc_id")}


def _percentile(share: float) -> str:
    """The linear percentile of ranked values: of two neighbours in order, found by their places."""
    place = f"({share} * (n - 1))"
    low, high = f"min(CASE WHEN le > floor({place}) THEN v END)", f"min(CASE WHEN le > ceil({place}) THEN v END)"
    return f"({low} + ({high} - {low}) * (max({place}) - floor(max({place}))))"


_MOMENTS = "CAST(sum(c) AS BIGINT) AS n, round(sum(v * c) / sum(c), 6) AS mean, round(sqrt(greatest(0.0, sum(c * power(v - m, 2)) / sum(c))), 6) AS std"
REFERENCE = f"""SELECT a.lang, a.feature, {_MOMENTS.replace("v - m", "v - b.m")}, {", ".join(f"round({_percentile(p / 100).replace('(n - 1)', '(CAST(a.n AS DOUBLE) - 1)')}, 6) AS p{p:02d}" for p in (5, 25, 50, 75, 95))}
FROM {{frank}} a JOIN (SELECT lang, feature, sum(v * c) / sum(c) AS m FROM {{frank}} GROUP BY lang, feature) b ON {_SAME} AND a.feature = b.feature GROUP BY a.lang, a.feature"""

#: Every whole percentile of each feature of each language.
GRID = f"""SELECT a.lang, a.feature, p.k AS percentile, round({_percentile(0).replace("0 * (n - 1)", "p.k / 100.0 * (CAST(a.n AS DOUBLE) - 1)")}, 6) AS value
FROM {{frank}} a CROSS JOIN (SELECT {{unnest_percents}} AS k) p GROUP BY a.lang, a.feature, p.k"""

DISTANCE = "SELECT doc_id, lang, x AS distance, CASE WHEN x <= 2.3 THEN 'match' WHEN x <= 2.8 THEN 'drift' ELSE 'break' END AS band FROM {dist}"

#: The share of the other documents below, ties counting half; null for one alone.
_SHARE = "CASE WHEN b.n > 1 THEN (b.le - b.c + 0.5 * (b.c - 1)) / CAST(b.n - 1 AS DOUBLE) END"
_PCT = f"pct AS (SELECT a.rid, a.doc_id, a.lang, a.x, 100.0 * {_SHARE} AS percentile FROM {{dist}} a JOIN {{xrank}} b ON {_SAME} AND a.x = b.v)"
MIDRANK = f"WITH {_PCT} SELECT doc_id, lang, x AS distance, round(percentile, 6) AS percentile, round(1 - percentile / 100, 8) AS exceedance FROM pct"
INDIVIDUALS = f"WITH {_PCT} SELECT s.lang, s.i, s.doc_id, s.x, round(p.percentile, 6) AS percentile, coalesce(p.percentile > 99.5, false) AS exceeds FROM {{stream}} s JOIN pct p ON s.rid = p.rid"
DETECTION = f"WITH {_PCT} SELECT lang, count(*) AS n, CAST(sum(CASE WHEN percentile > 95 THEN 1 ELSE 0 END) AS BIGINT) AS detected, round(sum(CASE WHEN percentile > 95 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS rate FROM pct GROUP BY lang"

BH = f"""WITH p AS (SELECT a.rid, a.doc_id, a.feature, round(least(1.0, greatest(2 * least({_SHARE}, 1 - ({_SHARE})), 1 / CAST(b.n AS DOUBLE))), 8) AS p FROM ({LONG}) a JOIN {{frank}} b ON {_SAME} AND a.feature = b.feature AND a.v = b.v),
k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p, feature) AS i, count(*) OVER (PARTITION BY rid) AS m FROM p)
SELECT doc_id, feature, p, round(least(1.0, min(m * p / CAST(i AS DOUBLE)) OVER (PARTITION BY rid ORDER BY p, feature ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS q FROM k"""

#: Ten folds of neighbouring ids; rows of one id share a fold.
FOLDS = f"SELECT a.lang, a.doc_id, CAST(floor((10 * (b.le - b.c + 1) - 1) / CAST(b.n AS DOUBLE)) AS BIGINT) AS fold FROM {{dist}} a JOIN {{irank}} b ON {_SAME} AND a.doc_id = b.v"

STREAM = f"""WITH par AS (SELECT lang, avg(x) AS mu0, stddev_pop(x) AS sigma0 FROM {{dist}} GROUP BY lang),
o AS (SELECT a.rid, a.lang, a.doc_id, a.x, b.le - b.c + row_number() OVER (PARTITION BY a.lang, a.doc_id ORDER BY a.x, a.rid) - 1 AS i FROM {{dist}} a JOIN {{irank}} b ON {_SAME} AND a.doc_id = b.v)
SELECT a.rid, a.lang, CAST(a.i AS BIGINT) AS i, a.doc_id, a.x, b.mu0, b.sigma0 FROM o a JOIN par b ON {_SAME}"""

CUSUM = "SELECT lang, i, doc_id, round(c_plus, 5) AS c_plus, round(c_minus, 5) AS c_minus, round(c_plus, 5) > 5 OR round(c_minus, 5) > 5 AS signal FROM {charted}"
EWMA = """SELECT lang, i, doc_id, round(z, 5) AS z, round(mu0 + half, 5) AS ucl, round(mu0 - half, 5) AS lcl, round(z, 5) > round(mu0 + half, 5) OR round(z, 5) < round(mu0 - half, 5) AS beyond
FROM (SELECT *, 3.0 * sigma0 * sqrt(CAST(0.2 AS DOUBLE) / 1.8 * (1 - power(CAST(0.8 AS DOUBLE), 2 * (i + 1)))) AS half FROM {charted}) z"""
#: The charts' values for another engine: CUSUM by running sums and their least, EWMA by recursion.
_RUN = "(PARTITION BY lang ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
CHARTED_SQL = f"""walk(lang, i, z) AS (SELECT lang, i, 0.2::DOUBLE * x + 0.8::DOUBLE * mu0 FROM stream WHERE i = 0 UNION ALL SELECT s.lang, s.i, 0.2::DOUBLE * s.x + 0.8::DOUBLE * w.z FROM walk w JOIN stream s ON s.lang IS NOT DISTINCT FROM w.lang AND s.i = w.i + 1),
sums AS (SELECT *, sum(coalesce((x - mu0) / nullif(sigma0, 0), 0) - 0.5::DOUBLE) OVER {_RUN} AS up, sum(coalesce(-(x - mu0) / nullif(sigma0, 0), 0) - 0.5::DOUBLE) OVER {_RUN} AS down FROM stream),
charted AS (SELECT s.*, s.up - least(0.0, min(s.up) OVER (PARTITION BY s.lang ORDER BY s.i)) AS c_plus, s.down - least(0.0, min(s.down) OVER (PARTITION BY s.lang ORDER BY s.i)) AS c_minus, w.z FROM sums s JOIN walk w ON s.lang IS NOT DISTINCT FROM w.lang AND s.i = w.i)"""

SPEARMAN = f"""WITH rk AS (SELECT a.feature, b.le - (b.c - 1) / 2.0 AS a, w.le - (w.c - 1) / 2.0 AS b FROM ({LONG}) a JOIN {{grank}} b ON a.feature = b.feature AND a.v = b.v JOIN {{wrank}} w ON a.n_words = w.v)
SELECT feature, count(*) AS n, coalesce(round((count(*) * sum(CAST(a AS DOUBLE) * b) - sum(CAST(a AS DOUBLE)) * sum(CAST(b AS DOUBLE))) / nullif(sqrt(count(*) * sum(CAST(a AS DOUBLE) * a) - sum(CAST(a AS DOUBLE)) * sum(CAST(a AS DOUBLE))) * sqrt(count(*) * sum(CAST(b AS DOUBLE) * b) - sum(CAST(b AS DOUBLE)) * sum(CAST(b AS DOUBLE))), 0), 6), 0.0) AS rho FROM rk GROUP BY feature"""

CONTRAST = f"""WITH lng AS (SELECT quality, toxic, feature, v FROM ({LONG}) f JOIN {{labels}} l ON f.doc_id = l.doc_id) SELECT quality, toxic, feature, count(*) AS n, round(avg(v), 6) AS mean FROM lng GROUP BY quality, toxic, feature"""

ENVELOPE = f"""WITH lim AS (SELECT lang, {_percentile(0.95).replace("(n - 1)", "(CAST(n AS DOUBLE) - 1)")} AS p95 FROM {{xrank}} GROUP BY lang) SELECT a.doc_id, a.lang, a.x AS distance, round(b.p95, 5) AS p95, CASE WHEN a.x <= b.p95 + 1e-9 THEN 'within' ELSE 'beyond' END AS envelope FROM {{dist}} a JOIN lim b ON {_SAME}"""

SUMMARY = """SELECT e.lang, CAST(e.n AS BIGINT) AS points, CAST(e.signals AS BIGINT) AS ewma_signals, CAST(c.signals AS BIGINT) AS cusum_signals, CAST(i.signals AS BIGINT) AS exceedances, e.first AS ewma_first, c.first AS cusum_first, i.first AS exceedance_first,
  CASE WHEN e.signals > 0 OR c.signals > 0 THEN 'sustained_shift_signal' WHEN i.signals > 0 THEN 'isolated_exceedance' ELSE 'in_control' END AS state
FROM (SELECT lang, count(*) AS n, sum(CASE WHEN beyond THEN 1 ELSE 0 END) AS signals, min(CASE WHEN beyond THEN i END) AS first FROM {ewma} GROUP BY lang) e
JOIN (SELECT lang, sum(CASE WHEN signal THEN 1 ELSE 0 END) AS signals, min(CASE WHEN signal THEN i END) AS first FROM {cusum} GROUP BY lang) c ON e.lang IS NOT DISTINCT FROM c.lang
JOIN (SELECT lang, sum(CASE WHEN exceeds THEN 1 ELSE 0 END) AS signals, min(CASE WHEN exceeds THEN i END) AS first FROM {individuals} GROUP BY lang) i ON e.lang IS NOT DISTINCT FROM i.lang"""
