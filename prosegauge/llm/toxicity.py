"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: compatibility forms, homoglyphs of other alphabets,
digits or signs that stand for letters beside letters, and letters spelled out
with dots or dashes become plain lower-case letters, so an evasive spelling
meets the same entry.  Accents stay, since they tell words apart.  Entries are whole words
and word beginnings (inflected insults share their beginning), each with a
weight learned as a smoothed log-odds of labelled texts.  Matches inside
exception phrases don't count: those of EXCEPTIONS, and pairs of a matched word
and its neighbour that at least SPARED clean labelled texts and no toxic one
hold.  The sum of weights, normalised by length, and
its calibration give a score from 0 to 1.

The lexicon is fitted on at most SAMPLE labelled rows outside the held-out
third (parameters), one text of an id, kept in at most FILES files.  It has at
most ENTRIES entries, which is what bounds what the driver collects and ships.
Scoring reads every whole text.

Defined results: null and blank texts score 0; repeated rows are scored
alike; without labels the lexicon is empty and everything scores 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise, small_batches

SAMPLE = 8_000
#: Files of the sample.  It doesn't grow with the table, and for each file and its checksum an executor forks a process.
FILES = 8
ENTRIES = 4_000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7)
_LOOKALIKE = dict(zip("аеорсухіјѕԁԛԝһӏαορτυνικωвкмт", "aeopcyxijsdqwhlaoptuvikwbkmt", strict=True))
_FOLD_LETTERS = {ord(k): v for k, v in _LOOKALIKE.items()} | dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_ODD = re.compile("[\xad\u200b-\u200d\u2060\ufeff\u0370-\u052f]")
_MIXED = re.compile(r"[a-z\xdf-\xff][\u0370-\u052f]|[\u0370-\u052f][a-z\xdf-\xff]|[\u0370-\u03ff][\u0400-\u052f]|[\u0400-\u052f][\u0370-\u03ff]")
_ALIKE = re.compile(f"[{''.join(_LOOKALIKE)}]+")
_LATIN = re.compile(r"[a-z\xdf-\xff]")
_DIGITS = dict(zip("0134578@$!|+€", "oieastbasilte", strict=True))
#: Runs of stand-ins beside a letter; a run is tried once, from its beginning.
_STANDS = re.compile(r"(?<![013-578@$!|+€])[013-578@$!|+€]++(?=[^\W\d_])|(?<=[^\W\d_])[013-578]++(?![\d])")
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-_*][^\W\d_]){2,}(?![^\W_])")
_WORDS = re.compile(r"[^\W\d_]+")
_OTHERS = re.compile("[\u0370-\u052f]")
#: Phrases in which a word of insult is none, whatever the labels say.
EXCEPTIONS = ("pond scum", "soap scum", "killer whale", "killer app", "kill switch", "kill time", "kill the process", "trash can", "trash bin", "garbage collection", "garbage collector", "garbage truck", "dumb terminal", "dumb bell", "village idiot", "idiot proof", "the idiot by", "guinea pig", "piggy bank", "rat race", "lab rat", "snake case", "crash test dummy", "dummy variable", "dummy text", "cheap skate", "fool proof", "april fool", "scunthorpe united", "moby dick", "cock a leekie", "cocktail", "bitch of the pack", "jackass penguin")
#: Clean labelled texts that must hold a pair of words around an entry, none of them toxic, for the pair to be an exception; and most pairs learned.
SPARED = 3
_BEFORE, _AFTER = re.compile(r"(?<!\w)(\w+)\s\Z"), re.compile(r"\s(\w+)(?!\w)")
PHRASES = 1_000


def fold(text: str | None) -> str:
    """The lower-case text in plain letters; only evasive spellings change otherwise."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()
        if _ODD.search(text):
            text = text.translate(dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]))
            # words that mix alphabets, and in a text of Latin letters also words wholly of look-alikes
            latin = len(_LATIN.findall(text)) > 4 * len(_OTHERS.findall(text))
            text = _WORDS.sub(lambda m: m[0].translate(_FOLD_LETTERS) if _MIXED.search(m[0]) or latin and _ALIKE.fullmatch(m[0]) else m[0], text)
    else:
        text = text.lower()
    text = _STANDS.sub(lambda m: "".join(map(_DIGITS.__getitem__, m[0])), text)
    return _SPELLED.sub(lambda m: re.sub(r"[.\-_*]", "", m[0]), text)


class Lexicon:
    """Entries ("word" with True, or a beginning with False, each with its weight), exceptions and the calibration (slope, bias)."""

    def __init__(self, entries: dict[tuple[str, bool], float], exceptions: Iterable[str] = (), slope: float = 1.0, bias: float = 0.0):
        self.entries, self.exceptions, self.slope, self.bias = dict(entries), sorted({" ".join(fold(e).split()) for e in exceptions} - {""}), slope, bias

    def automaton(self):
        import ahocorasick

        found: dict[str, list] = {}
        for (text, whole), w in self.entries.items():
            found.setdefault(text, [None, None, False])[0 if whole else 1] = w
        for e in self.exceptions:
            found.setdefault(e, [None, None, False])[2] = True
        a = ahocorasick.Automaton()
        for text, (whole, begins, spares) in found.items():
            a.add_word(text, (text, whole, begins, spares))
        if len(a):
            a.make_automaton()
        return a

    def matches(self, folded: str, automaton) -> dict[int, list[tuple[float, tuple[str, bool]]]]:
        """Start of each matched word -> its (weight, entry) pairs, outside exception phrases, of a folded text with single blanks."""
        out: dict[int, list[tuple[float, tuple[str, bool]]]] = {}
        if not folded or not len(automaton):
            return out
        spared: list[tuple[int, int]] = []
        size = len(folded)
        for end, (text, whole, begins, spares) in automaton.iter(folded):
            start = end - len(text) + 1
            if start and folded[start - 1].isalnum():
                continue
            ends = end + 1 == size or not folded[end + 1].isalnum()
            if spares and ends:
                spared.append((start, end))
            if begins:
                out.setdefault(start, []).append((begins, (text, False)))
            if whole and ends:
                out.setdefault(start, []).append((whole, (text, True)))
        return {s: w for s, w in out.items() if not any(a <= s <= b for a, b in spared)} if spared else out

    @staticmethod
    def feature(total: float, blanks: int) -> float:
        """The sum of weights, normalised by length, on a log scale."""
        return math.log1p(total) - 0.25 * math.log1p(total / 100 + blanks / 100) if total else 0.0

    def score(self, folded: str, automaton) -> float:
        folded = " ".join(folded.split())
        total = sum(max(w)[0] for w in self.matches(folded, automaton).values())
        x = self.feature(total, folded.count(" "))
        return 1 / (1 + math.exp(-min(50.0, self.slope * x + self.bias))) if x > 0 else 0.0


def _sample(docs: DataFrame, labels: DataFrame, limit: int, id_col: str, text_col: str) -> DataFrame:
    """id, text, toxic of at most `limit` labelled rows, half of them toxic if there are so many; of an id's texts that of the least hash."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    chosen = [known.where(f"toxic = {v}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit // 2) for v in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).withColumnRenamed("doc_id", "__id")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = slim.join(F.broadcast(ids), F.col("id") == F.col("__id"))
    one = found.groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    return one.select("id", F.col("one.text").alias("text"), "toxic").coalesce(FILES)


def _features(text: str | None) -> set[str]:
    """The distinct words (ending in a blank) and word beginnings of a text."""
    words = set(_WORDS.findall(fold(text)))
    return {f"{w} " for w in words if len(w) > 1} | {w[:n] for w in words for n in PREFIXES if len(w) >= n}


def _tallies(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """e, bad, good: the toxic and the clean texts of a batch that hold each feature, counted here, so that no list of every text's features is held."""
    for part in parts:
        bad, good = Counter(), Counter()
        for text, toxic in zip(part.column("text"), part.column("toxic"), strict=True):
            (bad if toxic.as_py() else good).update(_features(text.as_py()))
        names = list(bad.keys() | good.keys())
        for k in range(0, len(names), 50_000):
            some = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, "string"), pa.array([bad.get(e, 0) for e in some], "int64"), pa.array([good.get(e, 0) for e in some], "int64")], ["e", "bad", "good"])


def _pairs(folded: str, starts: Iterable[int]) -> set[str]:
    """The matched words with the word before and with the word after, each pair written with one blank."""
    out = set()
    for start in starts:
        end = next((k for k in range(start, len(folded)) if not folded[k].isalnum()), len(folded))
        word = folded[start:end]
        before, after = _BEFORE.search(folded, max(0, start - 60), start), _AFTER.match(folded, end, end + 60)
        out.update([f"{before[1]} {word}"] if before else [])
        out.update([f"{word} {after[1]}"] if after else [])
    return out


def fit(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = EXCEPTIONS, limit: int = SAMPLE, most: int = ENTRIES, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Learn the lexicon and its calibration from labelled rows outside the held-out third."""
    small_batches(docs.sparkSession)
    sample = materialise(_sample(docs, labels, limit, id_col, text_col), "tox-sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return Lexicon({}, exceptions)
    tallies = sample.select("text", "toxic").mapInArrow(_tallies, "e string, bad long, good long")
    counted = tallies.groupBy("e").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = F.col("bad") + F.col("good")
    odds = F.log((F.col("bad") + 0.1) / (bad + 0.2)) - F.log((F.col("good") + 0.1) / (good + 0.2))
    # evidence in nats against chance, to exceed what the best of all features shows by chance
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / total / (n / (bad + good)))).otherwise(F.lit(0.0))
    counted = materialise(counted.where("bad >= 3").withColumn("w", odds).withColumn("g", part("bad", bad) + part("good", good)), "tox-counts")
    need = math.log(max(2, counted.count())) + 2
    found = counted.where((F.col("w") > 3) & (F.col("g") > need)).orderBy(F.desc("g"), "e").limit(most).collect()
    weights = {r["e"]: (float(r["w"]), float(r["g"])) for r in found}
    kept = {}
    for e, (w, g) in weights.items():  # an entry covered by a beginning of at least its evidence and nearly its weight adds nothing
        if not any(len(e) > k and e[:k] in weights and weights[e[:k]][1] >= g and weights[e[:k]][0] >= w - 1.5 for k in PREFIXES):
            kept[(e.rstrip(" "), e.endswith(" "))] = w
    lexicon = Lexicon(kept, exceptions)
    auto = lexicon.automaton()
    seen = []
    clean, spoiled = Counter(), set()
    for row in sample.select("text", "toxic").toLocalIterator():  # at most `limit` rows, one partition at a time
        folded = " ".join(fold(row["text"]).split())
        hits = lexicon.matches(folded, auto)
        at = {start: _pairs(folded, [start]) for start in hits}
        pairs = set().union(*at.values())
        spoiled.update(pairs) if row["toxic"] else clean.update(pairs)
        seen.append((row["toxic"], folded.count(" "), [(at[start], found) for start, found in hits.items()]))
    learned = sorted((p for p, n in clean.items() if n >= SPARED and p not in spoiled), key=lambda p: (-clean[p], p))[:PHRASES]
    lexicon.exceptions = sorted({*lexicon.exceptions, *learned})
    spared = set(learned)
    seen = [(toxic, blanks, [found for pairs, found in hits if not pairs & spared]) for toxic, blanks, hits in seen]
    lexicon.entries = cover(kept, [[e for at in hits for _, e in at] for y, _, hits in seen if y])
    x, y = [], []
    for toxic, blanks, hits in seen:
        totals = [max([w for w, e in at if e in lexicon.entries], default=0.0) for at in hits]
        x.append(lexicon.feature(sum(totals), blanks))
        y.append(toxic)
    lexicon.slope, lexicon.bias = calibrate(np.array(x), np.array(y, float))
    return lexicon


def cover(entries: dict, texts: list[list], decay: float = 0.7, least: float = 2.5) -> dict:
    """The entries that explain toxic texts which stronger entries don't: greedily the one
    of most gain, a text counting decay ** (entries chosen that it holds)."""
    holds: dict = {}
    for i, found in enumerate(texts):
        for e in set(found):
            holds.setdefault(e, []).append(i)
    rows = {e: np.array(r) for e, r in holds.items()}
    share = np.ones(len(texts))
    chosen = {}
    while rows:
        e = max(rows, key=lambda k: (round(share[rows[k]].sum(), 6), k))
        if share[rows[e]].sum() < least:
            break
        chosen[e] = entries[e]
        share[rows.pop(e)] *= decay
    return chosen


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a ridge-damped logistic fit of y on x, by Newton steps."""
    a = np.stack([x, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + np.diag([0.05, 0.05])
        step = np.linalg.solve(h, a.T @ (y - p) - np.array([0.05, 0.05]) * b)
        b = b + step
        if abs(step).max() < 1e-9:
            break
    return float(max(b[0], 0.1)), float(b[1])


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, doc_id, score, predicted of every document."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for texts in parts:
            yield pd.Series([lexicon.score(fold(t), automaton) for t in texts], dtype="float64")

    got = docs.select(*keep, F.col(id_col).alias("doc_id"), scores(F.col(text_col)).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
