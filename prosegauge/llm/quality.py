"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed into BUCKETS cells.  Two counts over the cells,
one of trusted texts and one of the whole raw corpus (every row), give each cell
the weight log((trusted + SMOOTH) / (raw + SMOOTH)), where a language's raw
counts are scaled to the total of its trusted ones.  So a language is measured
against itself, however few of its rows are labelled, and cells with few counts
weigh near 0.  A document's ratio is the mean weight of its n-grams, so it is
length-normalised, and one fixed threshold decides every document.  A trusted
document is scored without its own trusted counts, as if it weren't trusted.

The trusted texts are a bounded sample (TRUSTED rows, a parameter) of documents
labelled good; the corpus side counts all rows.  The table of weights has
BUCKETS rows and that of shares TRUSTED rows at most, which is what makes their
broadcast safe at any scale, and the counts are combined before the shuffle, so
hot words cost nothing.

Defined results: a null or blank text has no words, zero in every count, no
ratio, and fails the base rules; repeated rows and null ids give one result row
each; an empty table gives an empty result; without trusted texts the ratio is
null and the base rules alone decide; a language with few trusted texts has
ratios near 0, so there the base rules decide nearly alone; a null language is a
language of its own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, plain_blanks, without, words

BUCKETS = 1 << 16
#: Most labelled documents that the trusted multinomial is fitted on.
TRUSTED = 20_000
#: A document is kept if its mean log-likelihood ratio reaches this.
THRESHOLD = -0.16
#: Counts added to both sides of a cell.
SMOOTH = 4
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = "#*$%&|<>"


def _hash_pair(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(F.shiftleft(b, 1))


def _cell(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _kept(column: Column, name: str) -> Column:
    """One generated row: later expressions read the value and don't compute it anew."""
    return F.explode(F.array(column)).alias(name)


def hashed_words(df: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """keep, doc_id, text, w: the 64-bit hash of each word, in order."""
    hashes = F.transform(words(F.col("text")), lambda x: F.xxhash64(x))
    return df.select(*keep, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(*keep, "doc_id", "text", _kept(hashes, "w"))


def base_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """keep, doc_id, w (hashed words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Repeats are found inside each row: the hashes of its three-word windows are
    sorted, those met twice are looked up at every position, and where they are
    many, (hash, position) pairs are sorted instead, so the work stays
    O(n log n).  Two different windows of one document share their 64-bit hash
    with a probability below 1e-9 even at 100,000 words.
    """
    w, n = F.col("w"), F.size("w")
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(" \t\x0b\x0c\r")) != "")
    length = F.length("text")
    step = hashed_words(df, id_col, text_col, *keep).select(
        *keep, "doc_id", "w", n.cast("long").alias("n_words"),
        F.length(F.replace(plain_blanks(F.col("text")), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (length - F.length(without(F.col("text"), _SYMBOLS))).cast("long").alias("n_symbols"),
        _kept(lines, "lines"),
    )
    rest = F.greatest(n, F.lit(1))
    zipped = F.arrays_zip(w.alias("a"), F.slice(w, 2, rest).alias("b"), F.slice(w, 3, rest).alias("c"))
    none = F.array().cast("array<bigint>")
    three = F.transform(zipped, lambda e: F.coalesce(_hash_pair(e["a"], _hash_pair(e["b"], e["c"])), F.lit(0).cast("long")))
    windows = F.when(n > 3, F.slice(three, 1, n - 2)).otherwise(none)
    step = step.select(*keep, "doc_id", "w", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _kept(windows, "h"))
    h = F.col("h")
    step = step.select(*step.columns, _kept(F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)).otherwise(none), "s"))
    s = F.col("s")
    twice = F.array_distinct(F.filter(s, lambda x, j: x == F.get(s, j + 1)))
    step = step.select(*[c for c in step.columns if c != "s"], _kept(twice, "d"))
    d, at = F.col("d"), F.sequence(F.lit(0), F.size(h) - 1)
    few = F.filter(at, lambda i: F.array_contains(d, F.get(h, i)))
    pairs = F.when(F.size(d) > 64, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    step = step.select(*step.columns, _kept(pairs, "q"))
    q = F.col("q")
    many = F.transform(F.filter(q, lambda e, j: (e["h"] == F.get(q, j - 1)["h"]) | (e["h"] == F.get(q, j + 1)["h"])), lambda e: e["i"])
    places = F.when(F.size(d) == 0, F.array().cast("array<int>")).when(F.size(d) <= 64, few).otherwise(many)
    step = step.select(*[c for c in step.columns if c not in ("h", "d", "q")], _kept(places, "p"))
    p = F.col("p")
    covered = F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))).cast("long")
    step = step.withColumn("n_repeat_words", F.when(F.size("p") > 0, covered).otherwise(F.lit(0).cast("long"))).drop("p")
    return step.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _ngrams(df: DataFrame, *keep: str) -> DataFrame:
    """One row per word: its own cell and the cell of the pair that it begins (null at the end)."""
    w = F.col("w")
    zipped = F.arrays_zip(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))))
    return df.select(*keep, F.inline_outer(zipped)).toDF(*keep, "a", "b").select(*keep, _cell(F.col("a")).alias("u"), _cell(_hash_pair(F.col("a"), F.col("b"))).alias("v"))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """At most `limit` ids of documents labelled good, chosen by hash."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def flagged(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with __t: 1 if the row's id is trusted, else 0."""
    mark = F.broadcast(trusted.select(F.col("doc_id").alias("__id"), F.lit(1).alias("__m")))
    return docs.join(mark, docs[id_col] == F.col("__id"), "left").select(*docs.columns, F.coalesce("__m", F.lit(0)).alias("__t"))


def shares(marked: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, share: trusted n-grams over all n-grams of each language that has trusted ones."""
    n = F.greatest(2 * F.size(words(F.col(text_col))) - 1, F.lit(0))
    sizes = marked.groupBy(F.col(lang_col).alias("lang")).agg(F.sum(n).alias("n"), F.sum(n * F.col("__t")).alias("good"))
    return sizes.where("good > 0").select("lang", (F.col("good") / F.col("n")).alias("share"))


def weights(marked: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """cell, good, raw: trusted counts and the raw counts on the same footing; no row if nothing is trusted."""
    share = F.broadcast(materialise(shares(marked, text_col, lang_col), "quality-shares").select(F.col("lang").alias("__lang"), "share"))
    part = marked.join(share, marked[lang_col].eqNullSafe(F.col("__lang")))  # a language without trusted texts weighs nothing
    cells = _ngrams(hashed_words(part, id_col, text_col, "__t", "share"), "__t", "share").select("__t", "share", F.explode(F.array("u", "v")).alias("cell")).where("cell is not null")
    return cells.groupBy("cell").agg(F.sum("__t").alias("good"), F.sum("share").alias("raw"))


def _ratio(good: Column, raw: Column) -> Column:
    return F.log((good + SMOOTH) / (raw + SMOOTH))


def score(marked: DataFrame, cells: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep and base_rules() without the hashes, then ratio (double) and kept (boolean)."""
    table = materialise(cells, "quality-cells")
    weight = table.select("cell", _ratio(F.col("good"), F.col("raw")).alias("weight"))
    one = F.broadcast(weight.select(F.col("cell").alias("u"), F.col("weight").alias("wu")))
    two = F.broadcast(weight.select(F.col("cell").alias("v"), F.col("weight").alias("wv")))
    known = not table.isEmpty()

    def base(t: int) -> tuple[DataFrame, list[str]]:
        rows = base_rules(marked.where(F.col("__t") == t), id_col, text_col, *keep).withColumn("row", F.monotonically_increasing_id())
        return rows, [c for c in rows.columns if c not in ("w", "row")]

    rows, names = base(0)
    grams = _ngrams(rows, "row", *names).join(one, "u", "left").join(two, "v", "left")
    # a cell without a count weighs 0; every n-gram counts
    total, n = F.sum(F.coalesce("wu", F.lit(0.0)) + F.coalesce("wv", F.lit(0.0))), F.nullif(F.count("u") + F.count("v"), F.lit(0))
    others = grams.groupBy("row").agg(*[F.first(c).alias(c) for c in names], (total / n).alias("ratio")).drop("row")
    rows, names = base(1)
    own = _ngrams(rows, "row", *names).select("row", *names, F.explode(F.array("u", "v")).alias("cell"))
    own = own.groupBy("row", "cell").agg(*[F.first(c).alias(c) for c in names], F.count("cell").alias("c")).join(F.broadcast(table), "cell", "left")
    total, n = F.sum(F.col("c") * _ratio(F.col("good") - F.col("c"), F.col("raw"))), F.nullif(F.sum("c"), F.lit(0))
    trusted = own.groupBy("row").agg(*[F.first(c).alias(c) for c in names], (total / n).alias("ratio")).drop("row")
    scored = others.unionByName(trusted)
    if not known:
        scored = scored.withColumn("ratio", F.lit(None).cast("double"))
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("ratio") >= threshold, F.lit(True)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trusted: int = TRUSTED, lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """The verdict on every document, with the columns in keep; see the module's text.  Without a column of languages all texts count as of one."""
    if lang_col not in docs.columns:
        docs = docs.withColumn(lang_col, F.lit(None).cast("string"))
    marked = flagged(docs, materialise(trusted_ids(labels, trusted), "quality-trusted"), id_col)
    return score(marked, weights(marked, id_col, text_col, lang_col), id_col, text_col, threshold, keep)
