"""Exact quantiles of many groups without gathering a group: ranges of values are narrowed by counts.

Each round counts, for every group and rank at once, the rows in the buckets of the range in which the rank lies, and
goes on with the least and largest value of the bucket that holds it. Ranges are cut by sign first, then on a
logarithmic scale, then evenly, so that a few rounds reach any value a double can have. A range of few rows, or of one
value, needs no more rounds. Counts are summed where the rows are; no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.sources.files import written

#: Buckets of a range, and rows of a range that are sorted.
BUCKETS, FEW = 1024, 4096


def _bucket(x: Column, low: Column, high: Column) -> Column:
    """A number that grows with x, from 0 to ``BUCKETS``."""
    even = F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * BUCKETS)
    span = lambda v, a, b: F.floor((F.log(v) - F.log(a)) / (F.log(b) - F.log(a)) * BUCKETS)
    place = F.when((low < 0) & (high > 0), F.signum(x) + 1).when((low > 0) & (high > 4 * low), span(x, low, high)).when((high < 0) & (low < 4 * high), BUCKETS - span(-x, -high, -low)).when((low == 0) | (high == 0), F.abs(F.signum(x))).otherwise(even)
    return F.least(F.greatest(place.cast("int"), F.lit(0)), F.lit(BUCKETS))


def order_statistics(long: DataFrame, by: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(by, k, value): the value of rank k (from 0, nulls don't count) of each group, for each row of ``wanted`` (by, k).

    Groups or ranks that aren't there have no row. Null keys are a group.
    """
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    own = [f"_g{i}" for i in range(len(by))]
    rows = written(long.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)"), "values")
    groups = rows.groupBy(*own).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))

    def meet(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        b = b.select(*(F.col(c).alias(f"r{c}") if c in own else F.col(c) for c in b.columns))
        on = [a[c].eqNullSafe(b[f"r{c}"]) for c in own]
        return a.join(b, on if on else F.lit(True), how).drop(*(f"r{c}" for c in own))

    ranks = wanted.select(*keys, F.col("k").cast("long").alias("k")).distinct()
    todo = written(meet(ranks, groups).filter("k >= 0 AND k < n").withColumn("below", F.lit(0).cast("long")), "ranges")
    done = todo.filter("low = high").select(*own, "k", F.col("low").alias("value"))
    todo = todo.filter("low < high")
    while not (open_ := todo.filter(F.col("n") > FEW)).isEmpty():
        inside = meet(rows, open_).filter(F.col("v").between(F.col("low"), F.col("high")))
        counts = inside.groupBy(*own, "k", "below", _bucket(F.col("v"), F.col("low"), F.col("high")).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*own, "k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))  # at most BUCKETS + 1 rows
        start = F.col("below") + F.coalesce(upto, F.lit(0))
        new = counts.withColumn("start", start).filter((F.col("start") <= F.col("k")) & (F.col("k") < F.col("start") + F.col("n")))
        new = new.select(*own, "k", "n", "low", "high", F.col("start").alias("below"))
        todo = written(new.unionByName(todo.filter(F.col("n") <= FEW)), "ranges")
        done = done.unionByName(todo.filter("low = high").select(*own, "k", F.col("low").alias("value")))
        todo = todo.filter("low < high")
    few = meet(rows, todo).filter(F.col("v").between(F.col("low"), F.col("high")))
    place = F.row_number().over(Window.partitionBy(*own, "k").orderBy("v")) - 1 + F.col("below")
    last = few.withColumn("at", place).filter("at = k").select(*own, "k", F.col("v").alias("value"))
    found = done.unionByName(last)
    return found.select(*(F.col(o).alias(c) for o, c in zip(own, by, strict=True)), "k", "value")


def exact_quantiles(long: DataFrame, by: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """(by, q): an array with the exact quantiles of each group that has a value, interpolated between neighbouring ranks."""
    rows = long.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = written(rows.groupBy(*by).agg(F.count("*").alias("n")), "counts")
    at = counts.withColumn("at", F.explode(F.transform(F.array(*(F.lit(float(p)) for p in probabilities)), lambda p, i: F.struct(i.alias("i"), (p * (F.col("n") - 1)).alias("h")))))
    at = at.select(*by, "at.i", "at.h")
    wanted = at.select(*by, F.explode(F.array(F.floor("h"), F.ceil("h"))).alias("k"))
    own = [f"_b{i}" for i in range(len(by))]
    found = order_statistics(rows, by, value, wanted).toDF(*own, "k", "value")
    for side, f in (("a", F.floor), ("b", F.ceil)):
        one = found.select(*own, "k", F.col("value").alias(side))
        at = at.join(one, [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(by, own, strict=True)] + [f("h") == F.col("k")]).drop(*own, "k")
    part = F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))
    ordered = F.sort_array(F.collect_list(F.struct("i", part.alias("x"))))
    return at.groupBy(*by).agg(F.transform(ordered, lambda s: s["x"]).alias("q"))
