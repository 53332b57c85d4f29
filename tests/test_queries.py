"""Shared queries against DuckDB, kernels against known answers, references and charts against direct formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegauge.functions import kernels as K
from prosegauge.functions import text as T
from prosegauge.operators import columns, reference
from prosegauge.plans import queries as Q
from prosegauge.streaming import charts

SAMPLE = ["joint_reading", "arc_summary", "slice_labels", "flags_of_views", "feature_bh", "quantile_grid", "spc_summary", "top_words", "script_counts", "structural_lines", "embedding_cosine", "conversation_register"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = Q.queries()[name](spark, data)
    got = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in got.description]
    plain = lambda v: float(v) if type(v).__name__ in ("Decimal", "float") else v
    order = sorted(df.columns)
    assert sorted(names) == order
    rows = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in got.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in df.collect()) == rows


TEXT = "﻿---\r\ntitle: x\r\n---\r\nDr. Smith can't go.  It's e.g. Here!\r\n\r\n\r\n\r\n```\ncode should vanish.\n```\nMust we? No’t.   \n"


def test_text(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "a\n```\nopen stays. Yes"), (3, ""), (4, None)], "doc_id long, text string")
    c = T.canonicalise(F.col("text"))
    got = {r[0]: r for r in df.select("doc_id", T.clean(c).alias("c"), T.words(T.clean(c)).alias("w"), T.paragraph_sentences(T.clean(c)).alias("s"), T.unclosed_fence(c).alias("u")).collect()}
    assert got[1]["s"] == ["Dr. Smith can't go.", "It's e.g. Here!", "Must we?", "No't."]
    assert got[1]["w"][:4] == ["dr", "smith", "can't", "go"] and "code" not in got[1]["w"]
    assert got[2]["u"] and "open" in got[2]["w"] and not got[1]["u"]
    assert got[3]["s"] == [] and got[3]["w"] == []


def test_kernels():
    assert K.phrase_rate("aaaaaa") == 3 / 6 and K.phrase_rate("") is None
    d = K.Draws("s")
    import hashlib

    assert d.word() == int.from_bytes(hashlib.sha256(b"s:0").digest()[:8], "big")
    assert K.canonical_json({"b": float("nan"), "a": [0.1 + 0.2, -0.0]}) == '{"a":[0.3,0.0],"b":null}'
    low, high = K.exact_interval(1, 11)
    assert round(low, 2) == 0.0 and round(high, 2) == 0.41
    s = [f"Sentence number {k} is here." for k in range(12)]
    for kind in K.PERTURBATIONS:
        assert K.perturb(kind, s, 0.0, "x") == s
        assert K.perturb(kind, s, 1.0, "x") == K.perturb(kind, s, 1.0, "x")


def test_slices():
    level, cut = K.structural_slices("few words")
    assert (level, cut) == ("document", [(0, 9)])
    para = " ".join(f"thing{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} think say is" for k in range(60))
    text = "\n\n".join([para] * 4)
    level, cut = K.structural_slices(text)
    assert level.startswith("paragraph") and len(cut) == 4 and cut[0][0] == 0 and cut[-1][1] == len(text)


def test_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 4.0], [1.0, 0.0, None, 2.0])], "a array<double>, b array<double>")
    row = df.select(columns.cosine(F.col("a"), F.col("b")).alias("c"), columns.euclidean(F.col("a"), F.col("b")).alias("e"), columns.midrank(F.col("a"), F.lit(2.0)).alias("m"), columns.interpolate(F.array(F.lit(0.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(3.0)), F.lit(0.5)).alias("i"), columns.band(F.lit(2.5), [("match", 2.3), ("drift", 2.8), ("break", None)]).alias("b")).first()
    assert row["c"] == pytest.approx(9 / math.sqrt(21 * 5)) and row["e"] == pytest.approx(math.sqrt(8)) and row["m"] == 50 and row["i"] == 1.5 and row["b"] == "drift"


def test_reference(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1.0]])
    df = spark.createDataFrame([(int(i), *map(float, v), 1.0) for i, v in enumerate(x)], "id long, a double, b double, c double, flat double")
    ref = reference.fit(df, ["a", "b", "c", "flat"], "r", components=3)
    assert ref["features"] == ["a", "b", "c"]
    z = (x - x.mean(0)) / x.std(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", z, np.linalg.inv(z.T @ z / 200), z))
    got = {r["id"]: r for r in reference.route(df, [ref]).collect()}
    assert np.allclose([got[i]["distance"] for i in range(200)], want)
    with pytest.raises(ValueError):
        reference.route(df, [ref], hint="other")


def test_charts_stream(spark, tmp_path):
    rows = [("k", i, float(1 + (i > 10) * 2 + (i % 3) * 0.1)) for i in range(20)]
    spark.createDataFrame(rows, "key string, seq long, x double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, x double").parquet(str(tmp_path / "in"))
    q = charts.chart(stream, 1.0, 0.5).writeStream.format("memory").queryName("charted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["seq"]: r for r in spark.sql("select * from charted").collect()}
    state = (0, 1.0, 0.0, 0.0, 0)
    for _, i, x in rows:
        state, values = charts.step(state, x, 1.0, 0.5, 0.2, 3.0, 0.5, 5.0)
        assert got[i]["z"] == pytest.approx(values[1]) and got[i]["c_plus"] == pytest.approx(values[2]) and got[i]["signal"] == values[5]
    assert got[19]["signal"] and not got[5]["signal"]


def test_reference_route_of_every_language(spark, data, tmp_path):
    from pyspark.sql import functions as F

    from prosegauge.plans import more

    docs = spark.read.parquet(f"{data}/documents.parquet").limit(130)
    k = F.row_number().over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy("doc_id"))
    two = docs.withColumn("lang", F.format_string("x%03d", k)).unionByName(docs.withColumn("lang", F.format_string("x%03d", k % 129 + 1)).withColumn("doc_id", F.col("doc_id") + 1_000_001))
    odd = docs.limit(2).withColumn("doc_id", F.col("doc_id") + 5_000_000).withColumn("lang", F.lit(None).cast("string"))
    two.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    rows = more._routed(more._register(spark, str(tmp_path)), more.REGISTER).collect()
    assert len(rows) == 262
    assert {r["match"] for r in rows if r["lang"] in (None, "x130")} == {"no_reference"}
    assert max(r["cohort"] for r in rows if r["cohort"]) > "x100"
    assert len(more.reference_route(spark, str(tmp_path)).collect()) == 262
    feat = more._register(spark, data).drop("rid").cache()
    refs = [reference.fit(feat.where(F.col("lang") == x), more.REGISTER, x) for x in ("de", "en", "es", "fr")]
    got = {r["doc_id"]: (r["cohort"], r["match"], r["distance"] and round(r["distance"], 6)) for r in reference.nearest(feat, more.REGISTER, reference.fit_groups(feat, more.REGISTER, "lang")).collect()}
    assert got == {r["doc_id"]: (r["cohort"], r["match"], r["distance"] and round(r["distance"], 6)) for r in reference.route(feat, refs).collect()}


def test_ranks_by_stretches(spark, monkeypatch):
    from prosegauge.operators import ranks

    monkeypatch.setattr(ranks, "SMALL", 10)
    rng = np.random.default_rng(1)
    rows = [(("a", "b", None)[k % 3], float(rng.integers(0, 400)) if k % 5 else 7.0) for k in range(3000)] + [("a", None)]
    got = {(r["g"], r["v"]): (r["c"], r["le"], r["n"]) for r in ranks.ranked(spark.createDataFrame(rows, "g string, v double"), ("g",), "v").collect()}
    for g in ("a", "b", None):
        own = np.array([v for h, v in rows if h == g and v is not None])
        assert all(got.pop((g, v)) == ((own == v).sum(), (own <= v).sum(), len(own)) for v in set(own.tolist()))
    assert not got


def test_charts_of_blocks(spark):
    from prosegauge.operators import charts as C

    rng = np.random.default_rng(2)
    rows = [(k, ("a", None)[k % 2], k // 2, k, float(rng.normal(1 + (k > 300))), 1.0, 0.8) for k in range(500)]
    got = {r["rid"]: r for r in C.charted(spark.createDataFrame(rows, "rid long, lang string, i long, doc_id long, x double, mu0 double, sigma0 double"), block=17).collect()}
    for g in ("a", None):
        z, up, down = 1.0, 0.0, 0.0
        for rid, _, _, _, x, mu, sigma in [r for r in rows if r[1] == g]:
            z, s = 0.2 * x + 0.8 * z, (x - mu) / sigma
            up, down = max(0.0, up + s - 0.5), max(0.0, down - s - 0.5)
            assert (got[rid]["z"], got[rid]["c_plus"], got[rid]["c_minus"]) == pytest.approx((z, up, down))


def test_the_pass_and_the_columns_read_alike(spark):
    from prosegauge.functions import measure as M

    texts = [TEXT, "", None, "a\n```\nopen stays. Yes", "See fig. Nine. Dr.  Mr. Who?  E.g. This... Oh!  No.\tYes\u00a0Sir.", "One. \n\n\n Two\n \nThree. dec. Four et al. Five", "---\nx\n---\nBody. Text", "~~~\na\n```\nb\n~~~\nC. D", "St. Mary st. Jude 'Vs. Them' (Mr. X) vs. Y.\u2003Z", "p. P. pp. Q approx........ R approx........... S"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c = T.clean(T.canonicalise(F.coalesce(F.col("text"), F.lit(""))))
    for r in df.select("text", c.alias("c"), T.paragraph_sentences(c).alias("s"), T.words(c).alias("w"), T.unclosed_fence(T.canonicalise(F.coalesce(F.col("text"), F.lit("")))).alias("u")).collect():
        raw = M.canonical(r["text"])
        clean = M.unfenced(raw)
        assert (clean, M.sentences(clean), M.tokens(clean), M.open_fence(raw)) == (r["c"], r["s"], r["w"], r["u"])


def test_odd_rows(spark, tmp_path):
    """Null ids, languages and texts, repeated rows and an empty table: every query gives a result."""
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} must not go." for k in range(90))
    rows = [(1, long, "en"), (1, long, "en"), (None, long + " More. Yes", "en"), (2, None, None), (3, "", None), (4, long[:900], None)]
    for at, some in (("some", rows), ("none", [])):
        spark.createDataFrame(some, "doc_id long, text string, lang string").write.parquet(str(tmp_path / at / "documents.parquet"))
        for name in ("joint_reading", "flags_summary", "distance_midrank", "feature_bh", "spc_summary", "reference_route", "trajectory_elegant"):
            n = Q.queries()[name](spark, str(tmp_path / at)).count()
            assert n >= len(some) - 5 and (some or not n), name
        assert Q.queries()["joint_reading"](spark, str(tmp_path / at)).count() == len(some)


def test_perturbed_words_without_copies(spark, data):
    """perturb_study counts each document once for all cells, as perturb()'s copies have it; it made 15 copies of each."""
    import hashlib
    import random

    from prosegauge.functions import measure as M
    from prosegauge.plans import more

    rng, bits = random.Random(3), ["Yes. ", "No! ", " -- ", "—", "–x", "a b. ", "Dr. Who? ", "\n\n", "it; Is. ", "É "]
    grid = (-1.0, 0.0, 0.3, 0.5, 1.0)
    for k in range(300):
        own = M.sentences(M.canonical("".join(rng.choices(bits, k=rng.randint(0, 40)))))
        assert K.perturbed_words(own, grid, str(k)) == [len(" ".join(K.perturb(kind, own, e, str(k))).split()) for kind in K.PERTURBATIONS for e in grid]
    df = more.perturb_study(spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "ArrowEvalPython" not in plan
    texts = [M.unfenced(M.canonical(r["text"])) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    for r in df.collect():
        want = [len(" ".join(K.perturb(r["kind"], M.sentences(t), r["intensity"], hashlib.sha256(t.encode()).hexdigest())).split()) for t in texts]
        assert (r["n"], r["words"]) == (len(want), round(sum(want) / len(want), 6))


def test_measuring_many_texts_at_once(monkeypatch):
    """measure_all() has the values of measure(), and asks it for odd texts only; the pass called it for every text before."""
    import random

    from prosegauge.functions import batch as B, measure as M
    from prosegauge.functions.lexicon import rows

    rng, listed = random.Random(4), [r[0] for r in rows()]
    bits = ["Dr. ", " e.g. ", " however, ", "But ", "but ", " -- ", "—", ": ", "￿", ". ", "! ", "? ", "A ", "İ ", "Kx ", "Σας ", "ß é ", "\U0001f600 ", "there is ", "There were ", "`x: y`", "\n\n", "\n# h\n", "| t |", "even though ", "as long as soon as ", "nothing but ", "'", "-", "For example, ", "in other words ", "“", '"', "I.e. this. "]
    texts = [None, "", "  ", "a", TEXT, "```\nx"] + ["".join(rng.choice(bits) if rng.random() < 0.35 else rng.choice(listed) + rng.choice([" ", ", ", ". "]) for _ in range(rng.choice([3, 20, 100, 400]))) for _ in range(300)]
    every, want = frozenset(M.PARTS), []
    for t in texts:
        want.append(M.measure(t, every))
    plain = [t for t in texts if not t or not B._ODD.search(t)]
    with monkeypatch.context() as m:
        m.setattr(M, "measure", None)
        assert len(B.measure_all(plain, every)["n_words"][0]) == len(plain)
    for size in (1 << 20, 2000, 1):  # the cuts between batches change nothing
        monkeypatch.setattr(B, "CHARACTERS", size)
        monkeypatch.setattr(B, "KNOWN", size)
        got = B.measure_all(texts, every)
        for k, row in enumerate(want):
            assert {c: None if null[k] else pytest.approx(v[k].item(), rel=1e-14) for c, (v, null) in got.items()} == {c: row.get(c) for c in got}
            assert set(row) <= set(got)
    assert B.measure_all([], every) == {}


def test_slices_of_many_texts_at_once(spark, data, monkeypatch):
    """Slices of a batch have the curves of measure.curves() and elegant(), which were called for every text before."""
    import random

    from prosegauge.functions import batch as B, measure as M
    from prosegauge.functions.lexicon import rows

    rng, listed = random.Random(5), [r[0] for r in rows()]
    bits = ["Dr. ", "￿", "A ", "İ", "K ", "there is ", "There were ", "\n\n", "\n# h\n", "it-there is "]
    texts = [None, "", "  "] + ["".join(rng.choice(bits) if rng.random() < 0.1 else rng.choice(listed) + rng.choice([" "] * 6 + [". ", ".  A "]) for _ in range(rng.choice([3, 160, 400, 1500]))) for _ in range(80)]
    texts += [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    want = [M.curves(t) for t in texts], [M.elegant(t) for t in texts]
    assert B.curves_all(texts) == want[0] and B.elegant_all(texts) == want[1] and {r[9] for own in want[1] for r in own} > {"document", "section"}
    monkeypatch.setattr(M, "curves", None)
    monkeypatch.setattr(M, "elegant", None)
    plain = [t for t in texts if not t or not B._ODD.search(t)]
    assert [len(x) for x in B.elegant_all(plain)] == [len(w) for t, w in zip(texts, want[1], strict=True) if not t or not B._ODD.search(t)]
    assert len(B.curves_all(plain)) == len(plain)


def test_bootstrap_draws_in_arrays(spark, data, monkeypatch):
    """resampled() sums over the draws of resample(), also in pieces and where a draw is refused; nothing is sent to Python but texts."""
    from prosegauge.operators import sequential

    rng = np.random.default_rng(0)
    for k in range(12):
        n, m = rng.integers(0, 30, size=9 + k), rng.integers(0, 3, size=9 + k)
        want = [100.0 * sum(int(m[i]) for i in d) / t if (t := sum(int(n[i]) for i in d)) else 0.0 for d in K.resample([""] * len(n), str(k), 20)]
        monkeypatch.setattr(K, "_AT_ONCE", (1 << 20, 30)[k % 2])
        assert K.resampled(n, m, str(k), 20) == want
    with monkeypatch.context() as c:
        c.setattr(K, "drawn", lambda seed, n, first=0: np.full(n, (1 << 64) - 1, np.uint64))
        assert K.resampled(n, m, str(k), 20) == want
    df = sequential.bootstrap(spark.read.parquet(f"{data}/documents.parquet"))
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.where("low <= point and point <= high or se = 0").count() >= 0.9 * df.count() > 0


def test_top_words_without_shuffle(spark, data, tmp_path):
    """Words of rows with an id of their own aren't shuffled; rows that share one, or have none, are still one document."""
    rows = [(1, "one two two three three Three."), (2, "alpha beta"), (2, "beta gamma gamma gamma"), (None, "zeta eta"), (None, "eta"), (3, None), (4, "İstanbul Kelvin the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in Q.run(spark, "top_words", docs).where("doc_id is not null").collect())
    assert [r for r in got if r[0] == 1] == [(1, "one", 1, 3), (1, "three", 3, 1), (1, "two", 2, 2)]
    assert [r[:3] for r in got if r[0] == 2 and r[1] != "alpha"] == [(2, "beta", 2), (2, "gamma", 3)]
    assert [r for r in got if r[0] == 4] == [(4, "elvin", 1, 3), (4, "stanbul", 1, 2), (4, "the", 2, 1)]
    assert {(r["word"], r["c"]) for r in Q.run(spark, "top_words", docs).where("doc_id is null").collect()} == {("eta", 2), ("zeta", 1)}
    plan = Q.run(spark, "top_words", spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan
