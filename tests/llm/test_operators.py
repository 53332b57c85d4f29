"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegauge.llm import ann, bpe, html, langid, licenses, mixing, neardup, queries, quality, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"
LONG = " ".join(f"w{k}" for k in range(3000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "x"),
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "b", 0, "x"),
    (4, " \t\n ", None, "b", 3, "x"),
    (5, LONG, "en", None, 9, "x"),
    (None, "no id at all here", "fr", "c", 1, "x"),
    (6, "été — naïve ½ 😀", "fr", "é", 1, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def duck(sql, data):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = con.execute(sql)
    return [c[0] for c in got.description], sorted(map(repr, got.fetchall()))


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_mix_sources"])
def test_sql(spark, data, name):
    df = queries.queries()[name](spark, data)
    columns, rows = duck(queries.oracle_sql()[name], data)
    assert columns == df.columns
    assert sorted(repr(tuple(r)) for r in df.collect()) == rows


# 1 licences


def test_licenses(spark, odd, none):
    mit = dict(licenses.known_texts())["MIT"]
    other = mit.upper().replace("LICENSE", "LICENCE").replace("COPYRIGHT (C) <YEAR> <COPYRIGHT HOLDERS>", "© 1999 Somebody Else\nCopyright 2001 Another").replace(",", " ,")
    rows = spark.createDataFrame([(1, mit), (2, other), (3, mit + " and more"), (4, None), (5, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in licenses.scan(rows).collect()} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None}
    assert licenses.scan(odd).count() == len(ODD)
    assert licenses.scan(none).count() == 0


def test_full_licences_are_known(spark):
    whole = ["Apache-2.0", "Artistic-1.0-Perl", "CC0-1.0", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"]
    texts = dict(licenses.known_texts())
    assert all(len(texts[n]) > 5_000 for n in whole)
    rows = spark.createDataFrame([(n, texts[n].upper().replace("  ", " ")) for n in whole], "doc_id string, text string")
    assert {r["doc_id"]: r["license_id"] for r in licenses.scan(rows).collect()} == {n: n for n in whole}


def test_licences_however_wrapped(spark):
    """Every shipped text at 15 widths, paragraphs filled, in capitals, as a comment and with other holders."""
    import textwrap

    texts, rows = dict(licenses.known_texts()), []
    for name, text in texts.items():
        parts = re.split(r"\n[ \t]*\n\s*", text.strip())
        for width in range(30, 180, 10):
            filled = "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in parts)
            rows += [(name, filled), (name, filled.upper()), (name, textwrap.indent(filled, " * ", lambda line: True))]
        rows += [(name, "Copyright (c) 2004, 2007-2012 Somebody Else <me@example.org>\n\n" + text)]
    body = dict(texts)["ISC"]
    rows += [("ISC", re.sub(r"(?i)copyright \(c\)[^\n]*", "Copyright 1998-2003 The\nSociety of Holders, and\nothers", body))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and not [r["doc_id"] for r in got if r["license_id"] != r["doc_id"]]
    other = [("1", body + "\n\nand more"), ("2", body.replace("copyright notice", "notice")), ("3", texts["BSD-3-Clause"].replace("COPYRIGHT HOLDERS", "HOLDERS").replace("COPYRIGHT HOLDER", "HOLDER"))]
    assert {r["license_id"] for r in licenses.scan(spark.createDataFrame(other, "doc_id string, text string")).collect()} == {None}


# 2 mixing


def brute_targets(sizes, weights, epochs=3):
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(epochs * sizes[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > epochs * sizes[i]]
        if not over:
            return [epochs * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped.update(over)


def test_mixing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    own = defaultdict(list)
    for r in rows:
        own[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    names = sorted(own)
    sizes = [sum(r["size"] for r in own[n]) for n in names]
    want = brute_targets(sizes, [k % 3 + 1 for k in range(len(names))])
    for n, t in zip(names, want, strict=True):
        assert own[n][0]["target"] == pytest.approx(t)
        assert sum(r["taken"] for r in own[n]) == round(t)


def test_mixing_odd(spark, odd, none):
    rows = {(r["doc_id"], r["source"]): r for r in mixing.mix(odd).collect()}
    assert rows[(2, None)]["size"] == 0 and rows[(2, None)]["taken"] == 0
    assert rows[(3, "b")]["target"] == 0
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_rows(odd)
    assert mixed.columns == odd.columns and mixing.mixed_rows(none).count() == 0


def test_mixed_rows_take_the_targets(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    same = spark.createDataFrame([(7, "seven words that are all the same " * 3, "en", "rep", 1)] * 400 + [(None, f"text {k} of a row without an id", "en", "rep", 1) for k in range(50)], docs.schema)
    docs = docs.unionByName(same)
    size = lambda t: len(WORD.findall(t or ""))
    before, after = Counter(map(tuple, docs.collect())), Counter(map(tuple, mixing.mixed_rows(docs).collect()))
    assert after == Counter(map(tuple, mixing.mixed_rows(docs.repartition(7)).collect()))
    own, got, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for row, n in before.items():
        own[row[3]] += n * size(row[1])
        longest[row[3]] = max(longest[row[3]], size(row[1]))
        assert after[row] <= 3 * n
    for row, n in after.items():
        assert row in before
        got[row[3]] += n * size(row[1])
    names = sorted(own)
    for name, target in zip(names, brute_targets([own[n] for n in names], [k % 3 + 1 for k in range(len(names))]), strict=True):
        assert abs(got[name] - target) <= longest[name] / 2 + 1


# 3 quality


def brute_base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    hit = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_base(spark, data, odd):
    extra = spark.createDataFrame([(100, "a b c " * 40, None, None, 1, None), (101, "x y z\n" * 90 + LONG, None, None, 1, None), (102, "\n".join([" ".join(f"v{k}" for k in range(j, j + 9)) for j in (*range(0, 2000, 9), *range(0, 2000, 9))]), None, None, 1, None)], DOCS)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(extra.select("doc_id", "text"))
    want = sorted(repr((r["doc_id"], *brute_base(r["text"]))) for r in docs.collect())
    got = sorted(repr(tuple(r)) for r in quality.base_rules(docs).select("doc_id", *NAMES).collect())
    assert got == want


def test_quality_verdict(spark, data, odd, none, labels):
    docs, truth = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = quality.quality(docs, truth).join(truth, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95
    assert not bad or sum(bad) / len(bad) < 0.3
    assert quality.quality(odd, labels).count() == len(ODD)
    assert quality.quality(none, labels).count() == 0
    assert quality.quality(odd, labels.limit(0)).count() == len(ODD)


def test_quality_of_good_rows_outside_the_fit(spark):
    import duckdb

    at = "/root/testdata/sf0.01"
    docs, truth = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    good = duckdb.sql(f"select doc_id, lang from '{at}/documents.parquet' join '{at}/labels.parquet' using (doc_id) where quality = 1 order by doc_id").fetchall()
    german = [i for i, lang in good if lang == "de"]
    for out in ({i for k, (i, _) in enumerate(good) if k % 5 == 0}, set(german[10:])):
        rows = quality.quality(docs, truth.where(~F.col("doc_id").isin(out))).where("not base_failed").join(docs.select("doc_id", "lang"), "doc_id").collect()
        kept = defaultdict(list)
        for r in rows:
            if r["doc_id"] in out:
                kept[r["lang"]].append(r["kept"])
        assert len(kept["de"]) >= 5 and all(sum(k) >= 0.85 * len(k) for k in kept.values())
        bad = [r["kept"] for r in docs.sparkSession.createDataFrame(rows).join(truth.where("quality = 0"), "doc_id").where("lang = 'en'").collect()]
        assert sum(bad) <= 0.3 * len(bad)


def test_quality_leaves_own_counts_out(spark):
    docs = spark.createDataFrame([(k, " ".join(f"{k}w{j}" for j in range(60)), "en") for k in range(4)], "doc_id long, text string, lang string")
    marks = lambda ids: spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    marked = lambda ids: quality.flagged(docs, marks(ids).select("doc_id"))
    ratio = {r["doc_id"]: r["ratio"] for r in quality.quality(docs, marks([0, 1])).collect()}
    cells = {r["cell"]: (r["good"], r["raw"]) for r in quality.weights(marked([0, 1])).collect()}
    assert sum(g for g, _ in cells.values()) == pytest.approx(sum(x for _, x in cells.values())) == 2 * 119
    assert all(r < 0.02 for r in ratio.values())  # no text shares its words with another, so none speaks for itself


def test_quality_is_native(spark, data):
    plan = queries.op3_quality_rules(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 4 neighbours


def test_nearest(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, size=(900, 1))
    rows = [(i, [float(np.float32(x)) for x in v[i]]) for i in range(900)] + [(901, None), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None]), (905, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), shard=300).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    x = np.float64(np.float32(v))
    hit = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s)[:20].tolist())
        assert [k for _, _, k in got[q]] == list(range(1, 21))
        assert all(score == pytest.approx(s[i]) for i, score, _ in got[q])
        assert [t for _, t, _ in got[q]] == sorted((t for _, t, _ in got[q]), reverse=True)
        hit += len(best & {i for i, _, _ in got[q]})
    assert hit >= 0.9 * 45 * 20
    assert set(got) == set(range(0, 900, 20))
    few = df.where("vec_id < 3 or vec_id = 20")
    assert ann.nearest(few.unionByName(few.where("vec_id = 1")), few.where("vec_id % 20 = 0")).count() == 8
    assert ann.nearest(few, few.where("vec_id % 20 = 0")).count() == 6
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_with_repeated_ids_and_vectors(spark):
    """Rows that share ids or vectors are candidates of their own; a query leaves out one row equal to it."""
    rng = np.random.default_rng(2)
    v = [[float(x) for x in rng.normal(size=8)] for _ in range(40)]
    rows = [(k, v[k % 40]) for k in range(80)] + [(0, v[3]), (0, v[0]), (20, v[20])] + [(k, v[5]) for k in range(100, 150)] + [(7, v[9])] * 30
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, shard int, query_id int")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), shard=60).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 9)))
    for q in {i for i, _ in rows if i % 20 == 0}:
        want = []
        for k, (i, x) in enumerate(rows):
            if i == q:
                own = sorted((-round(float(np.dot(x, y)), 9), j) for m, (j, y) in enumerate(rows) if m != k)[:20]
                want += [(n + 1, j, -s) for n, (s, j) in enumerate(own)]
        assert sorted(got[q]) == sorted(want)


# 5 toxicity


def test_fold():
    assert "idiot" in toxicity.fold("an 1d10t") and "idiot" in toxicity.fold("an іdiоt") and "idiot" in toxicity.fold("i.d-i_o.t!")
    assert toxicity.fold("in 2024 or 100") == "in 2024 or 100"
    assert toxicity.fold(None) == ""


def test_fold_of_long_runs_and_look_alikes():
    import time

    begun = time.time()
    for text in ("0" * 200_000, "|" * 200_000, "x" * 200_000 + "\u0430", "a." * 100_000, "\u0430a" * 100_000):
        toxicity.fold(text)
    assert time.time() - begun < 5
    assert toxicity.fold("you \u0455\u0441\u03c5\u043c of the earth") == "you scum of the earth"
    assert toxicity.fold("\u0441\u043e\u0440 \u0438 \u043f\u044b\u043b\u044c") == "\u0441\u043e\u0440 \u0438 \u043f\u044b\u043b\u044c"  # a Russian text stays


def test_exceptions_are_learned(spark):
    rows, marks = [], []
    for k in range(300):
        plain = " ".join(f"word{(k * 7 + j * j) % 97}" for j in range(40))
        rows.append((k, plain + (f" zlorf {'abcdef'[k % 6]}x" if k % 4 == 0 else " the zlorf  valve" if k % 25 == 1 else "")))
        marks.append((k, 1, int(k % 4 == 0)))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs, truth)
    assert "zlorf valve" in lexicon.exceptions and "pond scum" in lexicon.exceptions
    new = spark.createDataFrame([(1, "turn the zlorf\nvalve now"), (2, "you are a zlorf now"), (3, "a zlorf valve and a zlorf")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(new, lexicon).collect()}
    assert got[1] == 0 and got[2] > 0.5 and got[3] > 0.5


def test_toxicity_sample_and_tallies_are_bounded(spark):
    """Forty partitions, a third of the rows of one labelled id: few rows, few files, and counts equal to counting text by text."""
    import pathlib

    import pyarrow as pa

    from prosegauge.llm.common import materialise

    rows = [(0 if k % 3 == 0 else k, f"word{k % 11} grobnik{'s' * (k % 2)} text{k}") for k in range(600)] + [(601, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    truth = spark.createDataFrame([(k, 1, k % 2) for k in range(602)], "doc_id long, quality int, toxic int")
    sample = materialise(toxicity._sample(docs, truth, 100, "doc_id", "text"), "tox-sample")
    got = [(r["id"], r["text"], r["toxic"]) for r in sample.collect()]
    assert len(got) == len({i for i, _, _ in got}) <= 100 and {(i, t) for i, t, _ in got} <= set(rows)
    assert len(list(pathlib.Path(sample._written_at.removeprefix("file://")).glob("*.parquet"))) <= toxicity.FILES
    every = toxicity._sample(docs, truth, 10_000, "doc_id", "text")
    want = Counter((e, y) for _, t, y in (tuple(r) for r in every.collect()) for e in toxicity._features(t))
    tallies = every.select("text", "toxic").mapInArrow(toxicity._tallies, "e string, bad long, good long").groupBy("e").agg(F.sum("bad"), F.sum("good"))
    assert {e: (b, g) for e, b, g in tallies.collect()} == {e: (want[e, 1], want[e, 0]) for e, _ in want}
    part = pa.RecordBatch.from_pydict({"text": ["a stone wall"] * 500, "toxic": [0] * 500})
    assert sorted((r["e"], r["good"]) for b in toxicity._tallies([part]) for r in b.to_pylist()) == sorted((e, 500) for e in toxicity._features("a stone wall"))


def test_toxicity_of_every_text_by_brute_force(spark, data):
    """Scores again, without the automaton: every entry and exception searched in every folded text."""
    at = f"{data}/../sf0.01"
    docs, truth = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    lexicon = toxicity.fit(docs, truth)
    assert lexicon.entries
    for r, text in ((r, r["text"]) for r in toxicity.score(docs, lexicon).join(docs.select("doc_id", "text"), "doc_id").collect()):
        flat = " ".join(toxicity.fold(text).split())
        spared = [m.span() for e in lexicon.exceptions for m in re.finditer(rf"(?<![^\W_]){re.escape(e)}(?![^\W_])", flat)]
        best = {}
        for (entry, whole), w in lexicon.entries.items():
            for m in re.finditer(rf"(?<![^\W_]){re.escape(entry)}" + (r"(?![^\W_])" if whole else ""), flat):
                if not any(a <= m.start() < b for a, b in spared):
                    best[m.start()] = max(best.get(m.start(), (0,)), (w, (entry, whole)))
        x = lexicon.feature(sum(w for w, _ in best.values()), flat.count(" "))
        want = 1 / (1 + np.exp(-min(50, lexicon.slope * x + lexicon.bias))) if x > 0 else 0
        assert r["score"] == pytest.approx(want) and r["predicted"] == (want >= 0.7)


def test_lexicon_exceptions():
    lex = toxicity.Lexicon({("scum", True): 9.0, ("idio", False): 9.0}, ["pond scum"], 2.0, -3.0)
    auto = lex.automaton()
    assert lex.score(toxicity.fold("you are SCUM"), auto) > 0.7
    assert lex.score(toxicity.fold("the pond  scum grew"), auto) == 0
    assert lex.score(toxicity.fold("scummy videos"), auto) == 0
    assert lex.score(toxicity.fold("what idiocy"), auto) > 0.7


def test_toxicity(spark, odd, none, labels):
    rows, marks = [], []
    for k in range(300):
        bad = k % 4 == 0
        words = [f"word{(k * 7 + j * j) % 97}" for j in range(40)] + (["grobnik" + "abc"[k % 3], "zlorf"] if bad else [])
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(bad)))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, truth)).collect()}
    assert all(got[k]["predicted"] == t for k, _, t in marks)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    scored = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(scored) == len(ODD) and all(r["score"] == 0 for r in scored if not (r["score"] or 0))
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


# 6 WARC


def test_warc(spark):
    rows = [(5, "http://a/x y", "<p>é</p>"), (3, None, "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (1, "u\nv", ""), (7, "u", "z" * 300_000), (None, "u", "<p>é</p>"), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write(pages.repartition(3))
    got = warc.read(index).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["payload_bytes"]): r for r in got}
    assert sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 3) == [("response", None), ("revisit", 3)]
    assert by[(5, 9)]["refers_to"] == 3 and by[(None, 9)]["refers_to"] == 3
    assert by[(1, 0)]["record_type"] == "response" and by[(9, 0)]["refers_to"] == 1
    assert by[(7, 300_000)]["payload_digest"] == warc.base32_sha1(b"z" * 300_000)
    assert by[(None, 5)]["html"] == "alone"
    some = warc.read(index.where("page_id = 7")).collect()
    assert [r["html"] for r in some] == ["z" * 300_000]
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_by_brute_force(spark, data):
    """The table's pages and rows that repeat ids, urls and payloads: one response of each payload, all bytes back."""
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html")
    extra = [(1, "b", "same"), (1, "a", "same"), (1, "a", "same"), (1, None, "same"), (2, "a", "same"), (None, "a", "same"), (None, "n", "no id"), (None, "n", "no id")]
    pages = pages.unionByName(spark.createDataFrame(extra, pages.schema)).withColumn("refers_to", F.lit("clash")).withColumn("sha", F.lit(1)).withColumn("l", F.lit(2))
    got, rows = warc.read(warc.write(pages)).collect(), pages.collect()
    least = {}
    for r in rows:
        if r["page_id"] is not None:
            least[r["html"] or ""] = min(least.get(r["html"] or "", r["page_id"]), r["page_id"])
    sha = lambda r: warc.base32_sha1((r["html"] or "").encode())
    assert Counter((r["page_id"], r["url"], sha(r), len((r["html"] or "").encode())) for r in rows) == Counter((r["page_id"], r["url"], r["payload_digest"], r["payload_bytes"]) for r in got)
    digest = {warc.base32_sha1(h.encode()): (h, i) for h, i in least.items()}
    responses = Counter(r["payload_digest"] for r in got if r["record_type"] == "response")
    assert all(responses[d] == 1 for d in digest) and responses[warc.base32_sha1(b"no id")] == 2
    for r in got:
        html, i = digest.get(r["payload_digest"], ("no id", None))
        assert r["refers_to"] == (i if r["record_type"] == "revisit" else None) and r["page_id"] == (i if r["record_type"] == "response" else r["page_id"])
        assert r["html"] == (html if r["record_type"] == "response" else None)


def test_ranges():
    assert warc.ranges([(0, 10), (10, 5), (100, 5), (200_000, 5)], gap=100, most=1000) == [(0, 105, 3), (200_000, 200_005, 1)]


# 7 near duplicates


def brute_classes(rows, least=0.8):
    sets = {i: neardup.shingles(neardup.canonical(t)) for i, t in rows}
    head = {i: i for i, _ in rows}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(sets[a][0]) and len(sets[b][0]) and max(neardup.similarity(sets[a], sets[b])) >= least:
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, data):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        words = [f"t{g}x{j}" for j in range(150)]
        for c in range(8):
            own = list(words)
            for at in rng.integers(0, 150, size=(0, 1, 2, 3, 12, 40, 3, 0)[c]):
                own[at] = f"r{rng.integers(1e9)}"
            rows.append((g * 10 + c, " ".join(own)))
    rows += [(500, "one two"), (501, "one  two"), (502, ""), (503, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)
    kept = {r["doc_id"] for r in neardup.keep_one(docs).collect()}
    assert kept == set(got.values())
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.read.parquet(f"{data}/documents.parquet")).collect()} == brute_classes(real)


def test_near_duplicates_with_repeated_lines(spark):
    rows = []
    for g, times in enumerate((20, 40, 80)):
        text, line = " ".join(f"t{g}x{j}" for j in range(300)), " ".join(f"line{g}y{j}" for j in range(8))
        rows += [(2 * g, text), (2 * g + 1, text + f" {line}" * times)]
    want = brute_classes(rows)
    assert want == {k: k - k % 2 for k in range(6)}
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_near_duplicates_odd(spark, odd, none):
    assert neardup.near_duplicates(odd).count() == len(ODD)
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_of_shared_and_missing_ids(spark):
    one, two, three = (" ".join(f"{x}{j}" for j in range(80)) for x in "abc")
    near = one.replace("a79", "end")
    rows = [(1, one), (1, two), (1, two), (2, two), (None, one), (None, three), (None, three), (7, near), (3, three + " end"), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(set)
    for r in neardup.near_duplicates(docs).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert got.pop(None) == {None}
    assert got.pop(3) == {None, 3} and got.pop(7) == {1, None, 7}  # the least id that names one text only
    assert list(got.values()) == [{1, 2}]
    kept = neardup.keep_one(docs)
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.distinct().collect() if (r["doc_id"], r["text"]) in {(1, one), (1, two), (3, three + " end")}) + ["Row(doc_id=None, text='')"] * 2


def test_probability_jaccard():
    x, y = (np.array([1, 2, 3], np.uint64), np.array([1.0, 2.0, 4.0])), (np.array([2, 3, 9], np.uint64), np.array([2.0, 1.0, 1.0]))
    w = {1: (1, 0), 2: (2, 2), 3: (4, 1), 9: (0, 1)}
    want = sum(1 / sum(max(a / w[i][0], b / w[i][1]) for a, b in w.values()) for i in (2, 3))
    assert neardup.similarity(x, y)[0] == pytest.approx(want)
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = (h[:300], np.ones(300)), (h[60:], np.ones(340))
    s, t = (neardup.prob_min_hash(*v, m=2048) for v in (a, b))
    assert (s == t).mean() == pytest.approx(240 / 400, abs=0.05)


# 8 HTML

PAGE = '<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href="/">no</a></li></ul></nav><div class="ad">no</div><article class="post-%d"><h1>Head&amp;line</h1><p><b>First &amp; long paragraph of the article number %d.<br><p>Second   one &eacute;&#33; with some more text<aside>no</aside><div class="comments"><p>no</p></div></article><form>no</form><footer>&copy; no</footer></body></html>'


def test_html(spark):
    rows = [(k, f"http://www.h{k % 2}.example/x", PAGE % (k, k)) for k in range(6)] + [(10, "u", None), (11, None, ""), (12, "http://h1.example", "plain &am"), (13, "http://h0.example", "<p>cut off <b")]
    got = {r["page_id"]: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "Head&line First & long paragraph of the article number 3. Second one é! with some more text"
    assert got[3]["n_chars"] == len(got[3]["text"]) and got[3]["path"].endswith("article.post-#")
    assert got[10]["text"] == "" and got[11]["text"] == "" and got[12]["text"] == "plain &am" and got[13]["text"] == "cut off"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_by_brute_force(spark, data):
    """Votes summed in Python and every page read again with its host's path, on the table's pages, some twice, with clashing columns."""
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html")
    pages = pages.unionByName(pages.where("page_id % 7 = 0")).withColumn("path", F.lit("x")).withColumn("host", F.lit("h")).withColumn("text", F.lit(1))
    rows, cast = pages.collect(), defaultdict(lambda: defaultdict(float))
    name = lambda url: re.sub(r"^www\.", "", re.sub(r"^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*).*$", r"\1", url or "").lower())
    for r in rows:
        if vote := html.votes(r["html"]):
            cast[name(r["url"])][vote[0]] += round(vote[1], 4)
    winner = {h: min(v, key=lambda p: (-round(v[p], 3), p)) for h, v in cast.items()}
    want = sorted((r["page_id"], html.extract(r["html"], winner.get(name(r["url"])))) for r in rows)
    got = html.main_text(pages).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == want
    assert all(r["n_chars"] == len(r["text"]) and r["text"] == " ".join(r["text"].split()) for r in got)


def test_html_of_deep_nesting():
    import time

    begun = time.time()
    n = 20_000
    assert html.extract("<div>x" * n + "</div>" * n, None).count("x") == n
    html.votes("<b>" * n + "</i>" * n)
    assert time.time() - begun < 10


# 9 languages


def test_language(spark, data, odd, none):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r for r in langid.predict(odd, langid.fit(odd)).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[2]["score"] == 0
    assert langid.predict(none, langid.fit(none)).count() == 0


def test_language_by_brute_force(spark, data):
    """Evidence again with sets instead of bits; equal evidence goes to the language that sorts first."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs)
    for r in docs.limit(40).collect():
        code, total = langid.letters(r["text"]), np.zeros(len(model.names))
        for j, n in enumerate(langid.LENGTHS):
            grams = langid.grams(code, n)
            for k in range(len(model.names)):
                hits = sum(all(int(model.rows[j, k // 64, at[i]]) >> (k % 64) & 1 for at in model.places(grams)) for i in range(len(grams)))
                if len(grams):
                    total[k] += max(0.0, (hits / len(grams) - model.fp[j, k]) / (1 - min(model.fp[j, k], 0.99)))
        assert model.predict(r["text"])[0] == (model.names[int(np.argmax(total))] if len(code) else "und")
    tied = langid.Filters({name: {n: np.arange(9, dtype=np.uint64) for n in langid.LENGTHS} for name in ("b", "a")})
    assert tied.predict("some text")[0] == "a"


def test_language_sample_takes_repeated_rows_once(spark):
    docs = spark.createDataFrame([(2, "the same text", "en")] * 500 + [(k, f"text {k}", "en") for k in range(3, 40)], "doc_id long, text string, lang string")
    assert langid._sample(docs, 10**6, "doc_id", "text", "lang").where("text = 'the same text'").count() <= 1


def test_bloom_has_no_false_negatives():
    sets = {f"l{k}": {n: np.arange(k * 50, k * 50 + 40).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in langid.LENGTHS} for k in range(70)}
    model = langid.Filters(sets)
    for k, name in enumerate(model.names):
        at = model.places(sets[name][3])
        j = langid.LENGTHS.index(3)
        mask = model.rows[j, k // 64][at[0]] & model.rows[j, k // 64][at[1]]
        assert (mask >> np.uint64(k % 64) & np.uint64(1)).all()


# 10 encoding


def test_bpe(spark, data):
    pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    more = [(-1, None), (-2, " \t"), (-3, "Hello<|endoftext|>x <|startoftext|> it's WE'LL don't 'S 123 ½"), (-4, "aaaa" * 5000), (-5, "ΑΣ İ ﬁ Å x\x1cy\x85q 日本語😀 á́"), (-5, "twice")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = []
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in bpe.encode_digests(docs, path).collect())
    whole = bpe.encode(docs, path)
    assert bpe.decode(whole.select("doc_id", "ids", "decoded"), path, out_col="again").where("again <> decoded").count() == 0
    assert bpe.encode_digests(docs.limit(0), path).count() == 0


def test_bpe_on_any_character():
    """20,000 random texts, half of them of characters that the tables of the engines class otherwise, against the library."""
    import random

    pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(queries.tokenizer_path()), bpe.BatchedBpe(queries.tokenizer_path())
    rng = random.Random(5)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    low, odd, ascii_ = every[:0x3000], [c for c in every if bpe._UNLIKE.match(chr(c)) or bpe._MARKS.match(chr(c))], range(32, 127)
    texts = []
    for k in range(20_000):
        pool = (every, low, odd, ascii_)[k % 4]
        texts.append("".join(chr(rng.choice(pool if rng.random() < 0.6 else low)) for _ in range(rng.randrange(1, 60))))
    texts += ["".join(texts[k : k + 40]) + "<|endoftext|>" for k in range(0, 4_000, 40)]
    for block, stride in ((bpe.BLOCK, bpe.STRIDE), (300, 7)):  # then long texts are cut into parts
        bpe.BLOCK, kept = block, (bpe.BLOCK, bpe.STRIDE)
        bpe.STRIDE = stride
        some = texts if block > 300 else texts[-100:]
        for at in range(0, len(some), 500):
            for text, own in zip(some[at : at + 500], ours.encode(some[at : at + 500]), strict=True):
                parts, want = list(own), theirs.encode(text, add_special_tokens=False).ids
                assert " ".join(a for a, _ in parts) == " ".join(map(str, want)), repr(text)
                assert " ".join(b for _, b in parts) == theirs.decode(want, skip_special_tokens=False), repr(text)
        bpe.BLOCK, bpe.STRIDE = kept


# the pipeline


def test_pipeline(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, data)
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
            docs = docs.cache()
        after = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        assert set(after) <= before and after
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_odd(spark, odd, none, labels, tmp_path):
    import corpus_pipeline as P

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        for k, (_, stage) in enumerate(P.STAGES):
            columns = docs.columns
            docs = stage(spark, docs, str(tmp_path))
            assert k + 1 == len(P.STAGES) or docs.columns == columns
        # all but one text are too short, and that one is as long as the mix may take it three times
        ids = [r["doc_id"] for r in docs.collect()]
        assert set(ids) <= {5} and len(ids) <= 3


def test_pipeline_rejects_rows_not_ids(spark, tmp_path):
    import corpus_pipeline as P

    clean = [" ".join(f"word{(k * 7 + j * j) % 97}x{j}" for j in range(60)) for k in range(80)]
    rows = [(k, f"{x} grobnik zlorf" if k % 2 else x, "en", "a", 1) for k, x in enumerate(clean)]
    odd = [(None, clean[0], "en", "a", 1), (None, "too short", "en", "a", 1), (None, clean[2] + " grobnik zlorf", "en", "a", 1), (1000, clean[4], "en", "a", 1), (1000, "short too", "en", "a", 1), (1000, clean[6] + " grobnik zlorf", "en", "a", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, 0, k % 2) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = P.quality_stage(spark, docs, str(tmp_path)).cache()
    assert out.columns == docs.columns
    texts = lambda df, i: sorted(r["text"] for r in df.collect() if r["doc_id"] == i)
    assert texts(out, None) == sorted([odd[0][1], odd[2][1]]) and texts(out, 1000) == sorted([odd[3][1], odd[5][1]])
    out = P.toxicity_stage(spark, out, str(tmp_path)).cache()
    assert texts(out, None) == [odd[0][1]] and texts(out, 1000) == [odd[3][1]]
