"""Exact ranks of values in groups of any size.

Equal values are counted first.  Approximate quantiles cut a group's different
values into stretches; counts of the stretches are summed in order, and inside a
stretch a window counts on.  Where the cuts lie changes no rank, so they may be
approximate, and no task holds more than about a stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written

STRETCHES = 512
#: Up to so many different values a group is one stretch.
SMALL = 200_000


def ranked(df: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """by, v, c (rows of that value), le (rows up to it), n (rows of the group); rows without a value have no rank."""
    by = list(by)
    counted = written(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c")), "ranks")
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    counted = counted.select(key.alias("k"), "v", "c")
    cuts = counted.groupBy("k").agg(F.count("*").alias("kinds"), F.percentile_approx("v", [k / STRETCHES for k in range(1, STRETCHES)], 10 * STRETCHES).alias("cuts"))
    cuts = cuts.select("k", F.when(F.col("kinds") > SMALL, F.array_distinct("cuts")).alias("cuts"))
    placed = counted.join(cuts, "k").select("k", "v", "c", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda x: x < F.col("v")))).alias("stretch"))
    sums = placed.groupBy("k", "stretch").agg(F.sum("c").alias("m"))
    every = Window.partitionBy("k")
    sums = sums.select("k", "stretch", (F.sum("m").over(every.orderBy("stretch")) - F.col("m")).alias("below"), F.sum("m").over(every).alias("n"))
    inside = F.sum("c").over(Window.partitionBy("k", "stretch").orderBy("v"))
    found = placed.join(sums, ["k", "stretch"]).select(*[F.col("k")[c].alias(c) for c in by], "v", "c", (F.col("below") + inside).alias("le"), "n")
    return written(found, "ranked")
