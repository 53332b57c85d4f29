"""Near duplicates by ProbMinHash, banding and verification.

Shingles are five consecutive words, weighted by how often they occur.  Each
shingle's arrivals form a Poisson process whose rate is its weight; an arrival
lands in a random register, which keeps the earliest, and a shingle stops as
soon as its next arrival is later than every register.  Two signatures agree
in a register with the probability Jaccard similarity of the weighted sets.  A
text with repeated shingles has a second signature of weights 1, whose registers
agree with the plain Jaccard similarity; without repeats both are the same.

Texts equal word for word are one node.  Registers of both signatures are banded;
nodes that agree in a band are candidates.  Links need the exact probability
Jaccard (or the plain one) of the shingles to reach SIMILARITY.  No bucket is expanded into all
its pairs: (1) every node is checked against the least node of its buckets;
(2) against the least node of each bucket where both are still in different
classes; (3) what is left in one bucket but different classes is compared in
blocks by signature, and what may be alike is verified.  As classes are
connected components, pairs inside one class need no check, so no link between
different texts is lost to the order or size of a bucket.  What chance can lose:
a pair of similarity 0.8 shares no band with a probability of 7e-5, and step 3
passes over a pair at five standard deviations (3e-7).

A node's number is the least doc_id of its text; texts without an id, and texts
whose least id another text has too, get one made of their digest.

Defined results: a text of one to four words is one shingle; null and blank
texts form classes of their own; class_id is the least doc_id of the class, or a
number made of a digest if the class has no doc_id; rows of one doc_id with
different texts are nodes of their own; repeated rows share a class; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, materialise, small_batches, words

WIDTH = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
#: Least share of equal registers that is verified in step 3: 0.8 less five standard deviations.
LIKELY = 0.62
#: Most numbers of candidate texts (8 bytes each) that are broadcast to pick texts; more are joined by shuffle.
BROADCAST = 2_000_000
#: Rows of one side of a block in step 3.
BLOCK = 4_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _A)

_STEP = mix(np.arange(301, 301 + WIDTH, dtype=np.uint64) * _A) | np.uint64(1)


def canonical(text: str | None) -> bytes:
    """The words joined by one space (bytes.split cuts at exactly the six blanks of a word)."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").split())


def word_hashes(flat: bytes) -> np.ndarray:
    """A 64-bit hash per word of a canonical text, without a Python loop over words."""
    if not flat:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(flat, np.uint8)
    gap = np.flatnonzero(b == 32)
    start = np.r_[0, gap + 1]
    size = np.diff(np.r_[start, len(b) + 1])
    place = np.arange(len(b)) - np.repeat(start, size)[: len(b)]
    power = np.multiply.accumulate(np.full(int(size.max()), _A | np.uint64(1), np.uint64))
    value = _BYTE[b] * power[place]
    value[gap] = 0
    return mix(np.add.reduceat(value, start))


def shingles(flat: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts."""
    w = word_hashes(flat)
    if not len(w):
        return w, np.zeros(0)
    width = min(WIDTH, len(w))
    total = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        total += w[k : len(w) - width + 1 + k] * _STEP[k]
    h, c = np.unique(mix(total), return_counts=True)
    return h, c.astype(np.float64)


def prob_min_hash(h: np.ndarray, weight: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """m registers: of each, 32 bits of the shingle that arrived first."""
    earliest, owner = np.full(m, np.inf), np.zeros(m, np.uint64)
    now, step = np.zeros(len(h)), 0
    while len(h):
        k = max(1, -(-2 * m // len(h)) if step else -(-m // len(h)))  # arrivals per shingle in one go
        seed = mix(h[:, None] + (np.arange(step, step + k, dtype=np.uint64) * _A)[None, :])
        gap = -np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[:, None]
        at = now[:, None] + np.cumsum(gap, axis=1)
        slot = (mix(seed ^ _C) % np.uint64(m)).astype(np.int64)
        flat_at, flat_slot = at.ravel(), slot.ravel()
        useful = np.flatnonzero(flat_at < earliest[flat_slot])
        if len(useful):
            order = useful[np.argsort(-flat_at[useful], kind="stable")]  # the earliest is written last
            earliest[flat_slot[order]] = flat_at[order]
            owner[flat_slot[order]] = h[order // k]
        now, step = at[:, -1], step + k
        alive = now < earliest.max()
        h, weight, now = h[alive], weight[alive], now[alive]
    return (owner >> np.uint64(32)).astype(np.uint32)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(probability Jaccard, plain Jaccard) of two weighted shingle sets, exact."""
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    union = len(x[0]) + len(y[0]) - len(both)
    if not len(both):
        return 0.0, 0.0
    a, b = x[1][i], y[1][j]
    ratio, place = np.unique(b / a, return_inverse=True)
    more = lambda v: np.bincount(place, v, len(ratio))
    xs = np.cumsum(more(a))  # of shared shingles up to each ratio; those only in y come after all ratios, those only in x before
    ys = more(b).sum() - np.cumsum(more(b))
    only_x, only_y = x[1].sum() - a.sum(), y[1].sum() - b.sum()
    total = (only_x + xs) + (only_y + ys) / ratio
    return float((a / total[place]).sum()), len(both) / union


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest (of the words; null if none), signature, plain (of weights 1; null if the same)."""

    def run(it):
        for batch in it:
            digests, signatures, plain = [], [], []
            for text in batch.column(1):
                flat = canonical(text.as_py())
                digests.append(hashlib.md5(flat).digest() if flat else None)
                h, weight = shingles(flat)
                signatures.append(prob_min_hash(h, weight).tobytes() if flat else None)
                plain.append(prob_min_hash(h, np.ones(len(h))).tobytes() if flat and weight.max() > 1 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in (digests, signatures, plain))], names=["doc_id", "digest", "signature", "plain"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, digest binary, signature binary, plain binary")


def digest_of(text):
    """The digest of sketch() as a column: MD5 of the words joined by one space, null if there are none."""
    flat = F.array_join(words(text), " ")
    return F.when(flat != "", F.unhex(F.md5(flat.cast("binary"))))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs a, b whose texts are alike.  Rows come sorted by a, whose shingles are kept from row to row."""

    def run(it):
        last, known = None, None
        for batch in it:
            a, b, s, t = (batch.column(k) for k in range(4))
            keep = []
            for k in range(batch.num_rows):
                if (key := a[k].as_py()) != last:
                    last, known = key, shingles(canonical(s[k].as_py()))
                if max(similarity(known, shingles(canonical(t[k].as_py())))) >= least:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], names=["a", "b"])

    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a").select("a", "b", "s", "t")
    return materialise(both.sortWithinPartitions("a").mapInArrow(run, "a long, b long"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of its connected component, for every node of a link.

    Labels fall to the least neighbour's and then jump to their label's label,
    so the rounds grow with the logarithm of a component's diameter.
    """
    edges = materialise(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "near-edges")
    labels = materialise(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "near-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.select("node", "label").join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        step = materialise(low.join(jump, "low").select("node", F.col("label").alias("old"), F.least("low", "far").alias("label")), "near-labels")
        discard(labels)
        labels = step
        if step.where("old <> label").isEmpty():
            discard(edges)
            return step


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after more links between nodes; links and old labels are discarded."""
    if links.isEmpty():
        discard(links)
        return labels
    if labels is None:
        found = components(links)
    else:
        top = components(_across(links, labels).select(F.col("la").alias("a"), F.col("lb").alias("b"))).select("node", "label")
        moved = labels.join(top.select(F.col("node").alias("label"), F.col("label").alias("x")), "label", "left").select("node", F.coalesce("x", "label").alias("label"))
        fresh = top.join(labels.select("node"), "node", "left_anti")
        found = materialise(moved.unionByName(fresh), "near-labels")
        discard(labels)
    discard(links)
    return found


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs a, b with the labels la, lb of both ends; a node without a link is its own label."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
    return pairs


def _left_over(banded: DataFrame, hubs: DataFrame, labels: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs of one bucket but different classes, none of them the bucket's hub, whose signatures may be alike."""
    rows = banded.join(hubs.where("n > 2").select("bucket", "hub"), "bucket").where("node <> hub").drop("hub")
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    rows = rows.join(split.select("bucket", (F.floor(F.col("n") / BLOCK) + 1).cast("int").alias("blocks")), "bucket")
    rows = materialise(rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(signatures, "node"), "near-left")
    many = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = rows.select("*", many).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i = group["i"].iloc[0]
        one, two = group[group["mine"] == i], group[group["mine"] == group["j"].iloc[0]]
        registers = lambda rows: np.frombuffer(b"".join(rows), np.uint32).reshape(len(rows), -1)
        s, t = (registers(x["signature"]) for x in (one, two))
        plain_s, plain_t = (registers([p if isinstance(p, bytes) else w for w, p in zip(x["signature"], x["plain"], strict=True)]) for x in (one, two))
        node, label = two["node"].to_numpy(), two["label"].to_numpy()
        found = []
        for k in range(len(one)):
            n, own = one["node"].iloc[k], one["label"].iloc[k]
            hit = np.flatnonzero((label != own) & (node != n))
            if len(hit):
                hit = hit[np.maximum((t[hit] == s[k]).mean(1), (plain_t[hit] == plain_s[k]).mean(1)) >= LIKELY]
                found += [(min(n, node[h]), max(n, node[h])) for h in hit]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return spread.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _nodes(rows: DataFrame) -> DataFrame:
    """digest, node, least_id, copies, signature, plain: one row per different text."""
    copies = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first(F.struct("signature", "plain")).alias("s"))
    copies = materialise(copies.select("digest", "least_id", "copies", "s.signature", "s.plain"), "near-copies")
    twice = copies.where("least_id is not null").groupBy("least_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("least_id").alias("twice"))
    twice = materialise(twice, "near-twice")
    n, named = twice.limit(BROADCAST + 1).count(), F.col("least_id")
    if n:  # texts that share their least id are told apart by digest
        copies = copies.join(F.broadcast(twice) if n <= BROADCAST else twice, F.col("least_id") == F.col("twice"), "left")
        named = F.when(F.col("twice").isNull(), named)
    return copies.select("digest", F.coalesce(named, F.xxhash64("digest")).alias("node"), "least_id", "copies", "signature", "plain")


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest of every row; digest, class_id, copies, least_id of every different text)."""
    rows = materialise(sketch(docs, id_col, text_col), "near-sketch")
    copies = _nodes(rows)
    signatures = copies.select("node", "signature", "plain")
    size = 4 * ROWS
    bands = lambda name: F.array(*[F.xxhash64(F.lit(k), F.substring(name, k * size + 1, size)) for k in range(BANDS)])
    # one name space for both: what agrees across them is just verified besides
    both = F.when(F.col("plain").isNull(), bands("signature")).otherwise(F.array_union(bands("signature"), bands("plain")))
    banded = copies.select("node", F.explode(both).alias("bucket"))
    hubs = materialise(banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"), "near-hubs")
    stars = lookup(banded.join(hubs.select("bucket"), "bucket", "left_semi"), hubs, ["bucket"], "n").where("node <> hub").groupBy("hub", "node").agg(F.count("*").alias("times"))
    stars = materialise(stars.select(F.col("hub").alias("a"), F.col("node").alias("b")), "near-stars")
    involved = materialise(stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct(), "near-involved")
    few = involved.limit(BROADCAST + 1).count() <= BROADCAST  # then only their texts are shuffled, not all
    texts = materialise(_texts(docs, copies.join(F.broadcast(involved) if few else involved, "node", "left_semi"), id_col, text_col, few), "near-texts")

    first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    labels = _relabel(None, _verified(first, texts, least))
    none = docs.sparkSession.createDataFrame([], "node long, label long")
    more = _across(stars.join(first, ["a", "b"], "left_anti"), none if labels is None else labels).where("la <> lb").select("a", "b")
    labels = _relabel(labels, _verified(more, texts, least))
    rest = _left_over(banded, hubs, none if labels is None else labels, signatures)
    labels = _relabel(labels, _verified(rest, texts, least))
    labels = none if labels is None else labels
    discard(stars, involved, texts, hubs)

    # the least number of a class is its least doc_id unless a node of it is named by digest
    made = copies.where("not (least_id <=> node)").select("node")
    heads = labels.select("node", "label").join(made, "node", "left_semi").select("label").distinct()
    ids = labels.select("node", "label").join(heads, "label", "left_semi").join(copies.where("least_id <=> node").select("node"), "node").groupBy("label").agg(F.min("node").alias("head"))
    ids = materialise(ids, "near-heads")
    named = copies.select("digest", "node", "least_id", "copies").join(labels.select("node", "label"), "node", "left")
    if not ids.isEmpty():
        named = named.join(ids, "label", "left").withColumn("label", F.coalesce("head", "label"))
    return rows.select("doc_id", "digest"), named.select("digest", F.coalesce("label", "node").alias("class_id"), "copies", "least_id")


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, few: bool) -> DataFrame:
    """node, text of the wanted nodes.  A node named by id is found by id and its digest is looked at then only; the others are found by digest."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    part = lambda made: (F.broadcast if few else lambda x: x)(wanted.where(~made).select("node", F.col("digest").alias("d")))
    plain = F.coalesce(F.col("least_id") == F.col("node"), F.lit(False))
    found = rows.join(part(~plain), F.col("doc_id") == F.col("node")).where(digest_of(F.col("text")) == F.col("d"))
    if not wanted.where(~plain).isEmpty():
        other = rows.withColumn("own", digest_of(F.col("text")))
        found = found.select("node", "text").unionByName(other.join(part(plain), F.col("own") == F.col("d")).select("node", "text"))
    return found.groupBy("node").agg(F.min("text").alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, copies (rows whose words are the same) for every document."""
    rows, named = _classes(docs, id_col, text_col, least)
    full = lookup(rows, named.select("digest", "class_id", "copies", F.col("copies").alias("weight")), ["digest"], "weight")
    return full.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The documents with one row per class: that of the least doc_id, ties by digest.  Blank texts are classes of their own and all stay.

    Rows are told by id and digest.  Those that go are broadcast if they are at
    most BROADCAST, so that no text is shuffled; of a row that repeats, copies
    are dropped after being combined where they lie.
    """
    rows, named = _classes(docs, id_col, text_col, least)
    first = F.min(F.struct(F.col("least_id").isNull(), F.col("least_id"), F.col("digest")))
    heads = named.groupBy("class_id").agg(first.alias("h")).select(F.col("h.least_id").alias("head"), F.col("h.digest").alias("digest"))
    # one head at most for each text, so joining by digest after counting equal rows is safe for hot texts
    counted = rows.where("digest is not null").groupBy("digest", "doc_id").agg(F.count("*").alias("n")).join(heads.withColumn("is_head", F.lit(True)), "digest", "left")
    stays = F.coalesce(F.col("is_head") & F.col("doc_id").eqNullSafe(F.col("head")), F.lit(False))
    told = materialise(counted.withColumn("stays", stays).where("not stays or n > 1").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__d"), "stays"), "near-told")
    few = told.limit(BROADCAST + 1).count() <= BROADCAST

    def matched(side: DataFrame, how: str) -> DataFrame:
        own = F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
        if few:
            return docs.join(F.broadcast(side), own & (digest_of(F.col(text_col)) == F.col("__d")), how)
        return docs.withColumn("__digest", digest_of(F.col(text_col))).join(side, own & (F.col("__digest") == F.col("__d")), how).drop("__digest")

    kept = matched(told.select("__id", "__d"), "left_anti")
    again = told.where("stays").select("__id", "__d")
    if again.isEmpty():
        return kept
    once = matched(again, "left_semi").withColumn("__digest", digest_of(F.col(text_col))).dropDuplicates([id_col, "__digest"]).drop("__digest")
    return kept.unionByName(once)
