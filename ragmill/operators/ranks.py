"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Stretches that a group's values are cut into; a task sorts the different values of one.
STRETCHES = 256


def percentiles(rows: DataFrame, key: str, value: str, at: list[float]) -> DataFrame:
    """(key, p0, p1, ..): the linear percentiles of each group's values, as ``percentile`` gives them; null without any.

    Values are counted first. Approximate ones, in sketches of bounded size, cut a group into stretches; counts of
    stretches tell in which the wanted ranks lie, and these alone are sorted, so that no task holds a group. The
    sketch decides how the work is cut, never a result. Nulls do not count; a null key is a group like any other."""
    v = rows.select(F.struct(F.col(key).alias("key")).alias("g"), F.col(value).cast("double").alias("v"))  # a struct equals its like, null or not
    cuts = F.percentile_approx("v", [i / STRETCHES for i in range(1, STRETCHES)], 4 * STRETCHES)
    groups = v.groupBy("g").agg(F.count("v").alias("total"), F.array_distinct(cuts).alias("cuts"))
    counts = v.where("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("n"))
    stretch = F.size(F.filter("cuts", lambda c: c <= F.col("v")))
    counts = counts.join(groups, "g").select("g", "v", "n", "total", stretch.alias("stretch"))
    place = {i: F.lit(float(p)) * (F.col("total") - 1) for i, p in enumerate(at)}
    ranks = {i: (F.floor(x), F.ceil(x)) for i, x in place.items()}
    inside = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))
    any_rank = F.lit(False)
    for lo, hi in ranks.values():
        any_rank = any_rank | inside(lo) | inside(hi)

    def before(*by):
        return F.coalesce(F.sum("n").over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    sums = counts.groupBy("g", "total", "stretch").agg(F.sum("n").alias("n")).withColumn("before", before("g", "stretch"))
    hit = sums.where(any_rank).select("g", "stretch", F.col("before").alias("start"))
    found = counts.join(hit, ["g", "stretch"]).withColumn("before", F.col("start") + before("g", "stretch", "v")).where(any_rank)
    found = found.groupBy("g", "total").agg(*(F.max(F.when(inside(r), F.col("v"))).alias(f"{side}{i}") for i, pair in ranks.items() for side, r in zip(("lo", "hi"), pair, strict=True)))
    between = lambda i: F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise((ranks[i][1] - place[i]) * F.col(f"lo{i}") + (place[i] - ranks[i][0]) * F.col(f"hi{i}"))
    found = found.select("g", *(between(i).alias(f"p{i}") for i in place))
    return groups.select("g").join(found, "g", "left").select(F.col("g.key").alias(key), *(f"p{i}" for i in place))
