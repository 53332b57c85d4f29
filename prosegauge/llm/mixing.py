"""Mixing sources to target weights by capped water-filling.

The budget is the size of everything.  Sources, ranked by code point with null
last, weigh 1, 2, 3, 1, 2, 3, ...  Sharing by weight, clamping at `epochs`
times a source's size and resharing the excess by weight until nothing is above
its clamp has one fixed point, target = min(clamp, level * weight), and sorting
the sources by clamp / weight gives the level in closed form by running sums.

A source's target is whole repetitions of all its documents plus a fractional
one: documents are taken in the order of a seeded hash until the words left
over are used up.  The order needs no sort of a whole source: words are first
summed per (source, 16 bits of hash), running sums find the one cell in which a
source's fraction ends, and only the rows of that cell are ordered.  Rows that
are equal in what the order reads are counted first and shared out by number, so
a repeated row or id never meets itself in one task.

Sources are counted: at most SOURCES share a task's windows; beyond that the
job stops with an error instead of overloading one task.

Defined results: null texts have size 0 and take 0; a null source is a source
of its own, ranked last; a source without words has target 0; repeated rows are
documents of their own; ties in the hash are broken by id and size; an empty
table gives an empty result; other columns are kept by mixed_rows and otherwise
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup, materialise, word_count

EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: Most sources (rows of about 100 bytes in one task); and most of them that are broadcast.
SOURCES = 5_000_000
BROADCAST = 200_000
#: Cells per source, a power of 16.
CELL = 4


def _order(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def targets(sizes: DataFrame, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, n_rows -> the same with target (double).  One row per source, so one task's windows suffice."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("clamp", F.col("source_size") * F.lit(float(epochs)))
    t = t.withColumn("ratio", F.col("clamp") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("clamp").over(up), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0))))
    # the level with the first k sources clamped; the right one is the first that clamps nothing further
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("level").alias("level")))).over(every)["level"]
    target = F.when(fits.isNull() | (F.col("ratio") < fits), F.col("clamp")).otherwise(fits * F.col("weight"))
    return t.withColumn("target", F.least(target, F.col("clamp"))).drop("level", "ratio", "clamp")


def _cell(o: Column) -> Column:
    return F.conv(F.substring(o, 1, CELL), 16, 10).cast("int")


def _plan(slim: DataFrame, epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """k (the source, never null), source_size, target, whole, rest, n_rows, last (the cell in which the fraction ends), before (words of the cells before it), from rows of source, cell and size."""
    cells = slim.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.count("*").alias("n_rows"))
    cells = materialise(cells, "mix-cells")
    sizes = materialise(cells.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n_rows").alias("n_rows")), "mix-sizes")
    if sizes.limit(SOURCES + 1).count() > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    plan = targets(sizes, epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target")) / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    key = F.struct("source").alias("k")
    plan = materialise(plan.select(key, "source_size", "target", "whole", "rest", "n_rows"), "mix-plan")
    before = F.sum("words").over(Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    ends = cells.select(key, "cell", "words").withColumn("before", F.coalesce(before, F.lit(0))).join(plan.select("k", "rest"), "k")
    ends = ends.where("before < rest and before + words >= rest").select("k", F.col("cell").alias("last"), "before")
    return materialise(plan.join(ends, "k", "left"), "mix-ends")


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with k) and the plan of their source."""
    if plan.limit(BROADCAST + 1).count() <= BROADCAST:
        return rows.join(F.broadcast(plan.drop("n_rows")), "k", "left")
    return lookup(rows, plan, ["k"], "n_rows")


_INSIDE = "coalesce(rest > 0 and cell = last, false)"
_OUTSIDE = "coalesce(rest > 0 and cell < last, false)"


def _ordered(inside: DataFrame, keys: list[str]) -> DataFrame:
    """Equal rows counted (c), in order, with the words still wanted when the first of them comes (left)."""
    groups = inside.groupBy("k", "rest", "before", "whole", "source_size", "target", *keys, "size").agg(F.count("*").alias("c"))
    line = Window.partitionBy("k").orderBy(*keys, "size").rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("c")).over(line), F.lit(0)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every document.

    The last document of a source's fraction gives just the words still wanted,
    so a source's taken words are its target, rounded.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _order(F.col(id_col), seed).alias("o"))
    slim = materialise(slim.withColumn("cell", _cell(F.col("o"))), "mix")
    plan = _plan(slim, epochs, weights)
    rows = _planned(slim.select(F.struct("source").alias("k"), "doc_id", "size", "o", "cell"), plan)
    names = ["doc_id", "k.source", "size", "source_size", "target"]
    outside = rows.where(f"not {_INSIDE}").select(*names, (F.col("whole") * F.col("size") + F.when(F.expr(_OUTSIDE), F.col("size")).otherwise(F.lit(0))).alias("taken"))
    groups = _ordered(rows.where(_INSIDE), ["o", "doc_id"])
    each = groups.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    extra = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("left") - F.col("i") * F.col("size")))
    inside = each.select(*names, (F.col("whole") * F.col("size") + extra).alias("taken"))
    return outside.unionByName(inside).withColumn("taken", F.col("taken").cast("long"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, whole documents only; those without words are never taken.

    The order hashes the id and a hash of the row, so that no two unlike rows
    share a place.  The last document is taken if that comes nearer to the
    target.  Every row decides by its source's plan; texts aren't shuffled.
    """
    whole_row = F.xxhash64(*[F.coalesce(docs[c].cast("string"), F.lit("\0")) for c in docs.columns])
    keyed = docs.withColumn("__o", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(docs[id_col].cast("string"), F.lit("null")), F.lit(":"), whole_row.cast("string")).cast("binary")))
    slim = keyed.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.col("__o").alias("o"), _cell(F.col("__o")).alias("cell"))
    slim = materialise(slim, "mix")
    plan = _plan(slim, epochs, weights)
    rows = _planned(slim.select(F.struct("source").alias("k"), "size", "o", "cell"), plan)
    groups = _ordered(rows.where(_INSIDE).where("size > 0"), ["o"])
    more = F.least(F.col("c"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("left") + F.col("size") / 2) / F.col("size")).cast("long")))
    ends = materialise(groups.select("o", "whole", "c", more.alias("more")), "mix-last")
    # of equal rows, those of one group at most aren't all taken alike: they are combined where they lie and written out by number
    uneven = ends.where("more > 0 and more < c")
    taken = ends.where("more = c").select(F.col("o").alias("__o"), F.lit(1).alias("__more"))
    few = ends.limit(BROADCAST + 1).count() <= BROADCAST
    hint = F.broadcast if few else lambda x: x
    told = _planned(keyed.select(F.struct(F.col(source_col).alias("source")).alias("k"), "__o", _cell(F.col("__o")).alias("__cell"), F.struct(*docs.columns).alias("__row"), word_count(F.col(text_col)).alias("__size")), plan)
    told = told.join(hint(taken), "__o", "left").where("__size > 0")
    n = F.col("whole") + F.when(F.expr("coalesce(rest > 0 and __cell < last, false)"), F.lit(1)).otherwise(F.coalesce("__more", F.lit(0)))
    copies = lambda df, n: df.withColumn("__i", F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<bigint>")))).select("__row.*")
    if uneven.isEmpty():
        return copies(told, n)
    apart = uneven.select(F.col("o").alias("__o"), (F.col("whole") * F.col("c") + F.col("more")).alias("__all"))
    even = copies(told.join(hint(apart.select("__o")), "__o", "left_anti"), n)
    odd = told.select("__o", "__row").join(hint(apart), "__o").groupBy("__o", "__all").agg(F.first("__row").alias("__row"))
    return even.unionByName(copies(odd, F.col("__all")))
