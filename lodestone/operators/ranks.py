"""Exact order statistics of groups of any size: distributed selection in rounds.

Each wanted rank has a range of values that holds it. A round counts the range's values in equal parts (partial aggregates of at most ``parts`` rows
for each rank) and keeps the part that holds the rank, cut down to its least and greatest value, until it has few values or a single one. No
task ever holds a group's values, and a skewed group takes part in counts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import scratch, written


def nearest_rank_of(percent: float) -> Callable[[Column], Column]:
    """The rank of a percentile that is one of the values: percent of the count, rounded up, one at least."""
    return lambda n: F.greatest(F.lit(1), F.ceil(F.round(n * F.lit(percent) / 100, 9)))


def select_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], parts: int = 1_024, small: int = 10_000) -> DataFrame:
    """(by..., one column for each of ``ranks``): the values at these ranks (from 1) of each group; null and NaN are no values, groups without any are left out.
    ``ranks`` gives a rank from the group's count. Infinite values count as the greatest and least double."""
    most = 1.7976931348623157e308
    spark = rows.sparkSession
    with scratch(spark) as keep:
        clean = rows.select(*by, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
        base = written(clean.withColumn("v", F.greatest(F.lit(-most), F.least(F.lit(most), F.col("v")))).groupBy(*by, "v").agg(F.count("*").alias("c")), "values")
        first = base.groupBy(*by).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("distinct"))
        wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items())))
        state = written(first.select(*by, wanted.alias("w"), F.lit(0).cast("long").alias("before"), "lo", "hi", "distinct").select(*by, "w.name", "w.rank", "before", "lo", "hi", "distinct"), "ranges")
        state = state.where("rank >= 1")
        while True:
            wide = state.where((F.col("distinct") > small) & (F.col("lo") < F.col("hi")))
            if wide.isEmpty():
                break
            state = written(state.where((F.col("distinct") <= small) | (F.col("lo") >= F.col("hi"))).unionByName(_narrowed(base, wide, by, parts)), "ranges")
        held = _in_ranges(base, state, by)
        upto = Window.partitionBy(*by, "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # ``small`` values at most
        at = held.withColumn("upto", F.col("before") + F.sum("c").over(upto)).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        return keep(at.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks)), "ranks")


def _in_ranges(base: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """The distinct values of each wanted rank's range, with their counts."""
    named = state.select(*(F.col(c).alias(f"__{c}") for c in by), "name", "rank", "before", "lo", "hi")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    if not by:
        named = F.broadcast(named)  # one row for each rank
    return base.join(named, same & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).select(*by, "v", "c", "name", "rank", "before", "lo", "hi")


def _narrowed(base: DataFrame, wide: DataFrame, by: list[str], parts: int) -> DataFrame:
    """One round: each range becomes the one of its ``parts`` that holds the rank."""
    half = lambda c: F.col(c) / 2  # noqa: E731  the width of a range may exceed the greatest double
    part = F.least(F.lit(parts - 1), F.floor((half("v") - half("lo")) / (half("hi") - half("lo")) * parts))
    counts = _in_ranges(base, wide, by).withColumn("part", part).groupBy(*by, "name", "rank", "before", "part").agg(F.sum("c").alias("n"), F.count("*").alias("distinct"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    order = Window.partitionBy(*by, "name").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # ``parts`` rows at most
    summed = counts.withColumn("upto", F.col("before") + F.sum("n").over(order)).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return summed.select(*by, "name", "rank", (F.col("upto") - F.col("n")).alias("before"), "lo", "hi", "distinct")


def nearest_ranks(rows: DataFrame, by: list[str], value: str, percents: list[float]) -> DataFrame:
    """(by..., p50, ...): percentiles that are values of the group."""
    return select_ranks(rows, by, value, {f"p{p:g}": nearest_rank_of(p) for p in percents})
