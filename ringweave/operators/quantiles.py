"""Exact quantiles of large groups, by selection: no task holds a group's values.

The rank that a quantile asks for is bracketed by two values, from a sketch of the values between the last two, and the
rows below and inside are counted exactly. A round leaves a hundredth of them, so a few rounds reach a bracket whose values
can be counted one by one, whatever their distribution; a value that many rows share ends up as a bracket's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_stored, stored

#: Rows of a group up to which Spark's own exact percentile holds its distinct values in a task.
LARGE = 1_000_000
#: Parts of a sketch, and its accuracy: its ranks are off by less than half a part.
_PARTS, _ACCURACY = 400, 10_000


def exact_quantiles(rows: DataFrame, keys: list[str], probs: list[float], most: int = LARGE) -> DataFrame:
    """keys, n (long) and q (array, one for each of ``probs``) of each group's values v, linear between neighbours as
    ``percentile``. Nulls don't count; groups without values have no row.

    Groups of at most ``most`` values are one aggregation; larger ones are selected from in rounds. Both give the same.
    """
    own = rows.where("v is not null").select(*keys, F.col("v").cast("double").alias("v"))
    sizes = own.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    large = stored(sizes.where(F.col("n") > most), "large-groups")
    direct = lambda df: df.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, probs))).alias("q"))
    if large.isEmpty():
        return direct(own)
    many = own.join(large.select(*keys), keys, "left_semi")
    return direct(own.join(large.select(*keys), keys, "left_anti")).unionByName(_selected(many, large, keys, probs, most))


def _selected(rows: DataFrame, sizes: DataFrame, keys: list[str], probs: list[float], most: int) -> DataFrame:
    place = lambda p: F.col("n").cast("double").__sub__(1) * p
    ranks = F.array_distinct(F.array(*[f(place(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]))
    n_inside = (F.col("n") - 2).alias("between")
    state = stored(sizes.select(*keys, "lo", "hi", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), n_inside), "brackets")
    open_ = (F.col("between") > most) & (F.col("lo") < F.col("hi"))
    while state.where(open_).limit(1).count():
        at = [*keys, "rank"]
        wide = state.where(open_)
        met = rows.join(wide, keys).where("v >= lo and v <= hi")
        grid = F.percentile_approx("v", F.array(*[F.lit(k / _PARTS) for k in range(_PARTS + 1)]), F.lit(_ACCURACY))
        part = (F.col("rank") - F.col("below")) / (F.col("inside") - 1) * _PARTS
        ends = met.groupBy(*at, "below", "inside").agg(grid.alias("g"))
        ends = ends.select(*at, F.col("below").alias("was"), _end("g", F.floor(part) - 1).alias("lo"), _end("g", F.ceil(part) + 1).alias("hi"))
        ends = stored(ends, "bracket-ends")
        v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
        count = lambda on: F.count(F.when(on, 1))
        near = rows.join(ends, keys).join(wide.select(*at, F.col("lo").alias("from")), at).where("v >= `from` and v <= hi")
        told = near.groupBy(*at, "was", "lo", "hi").agg(count(v < lo).alias("less"), count(v >= lo).alias("inside"), count((v > lo) & (v < hi)).alias("between"))
        narrow = told.select(*keys, "lo", "hi", "rank", (F.col("was") + F.col("less")).alias("below"), "inside", "between")
        after = stored(state.where(~open_).unionByName(narrow.select(*state.columns)), "brackets")
        drop_stored(state)
        drop_stored(ends)
        state = after
    inside = rows.join(state.select(*keys, "rank", "lo", "hi", "below"), keys).where("v >= lo and v <= hi")
    counts = inside.groupBy(*keys, "rank", "below", "v").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*keys, "rank").orderBy("v"))
    values = counts.withColumn("upto", upto).where(F.col("upto") > F.col("rank")).groupBy(*keys, "rank").agg(F.min("v").alias("v"))
    held = sizes.select(*keys, "n").join(values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m")), keys)

    def value(p: float) -> Column:
        at = place(p)
        low, high = F.floor(at).cast("long"), F.ceil(at).cast("long")
        a, b = F.element_at("m", low), F.element_at("m", high)
        return F.when(low == high, a).when(a == b, a).otherwise((high - at) * a + (at - low) * b)

    return held.select(*keys, "n", F.array(*map(value, probs)).alias("q"))


def _end(grid: str, k: Column) -> Column:
    return F.get(F.col(grid), F.greatest(F.lit(0), F.least(F.lit(_PARTS), k.cast("int"))))
