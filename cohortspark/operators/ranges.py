"""Keys with more rows than a task should hold: ranges of a column, running sums across them, exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.sources.shared import kept

#: Ranges of a key at most.
MOST = 1024
#: Rows of a key up to which its quantiles are taken by one aggregate.
ONE_BUFFER = 1_000_000
#: Accuracy of the sketch that bounds the ranks of larger keys: it is off by one row in so many.
SKETCH = 10_000


def ranged(rows: DataFrame, keys: Sequence[str], order: Column, name: str, wanted: DataFrame) -> tuple[DataFrame, bool]:
    """The rows with a column of that name: the range of ``order`` they fall into (0 upwards), and whether any key has several.

    wanted: keys and _b, about how many ranges a key should have (other keys have one). Equal values share a range.
    """
    keys = list(keys)
    several = wanted.where(F.col("_b") > 1)
    if several.isEmpty():
        return rows.withColumn(name, F.lit(0)), False
    steps = [k / MOST for k in range(1, MOST)]
    bounds = rows.join(several, keys).groupBy(*keys).agg(F.percentile_approx(order, steps, 10 * MOST).alias("_bounds"), F.least(F.lit(MOST), F.max("_b")).cast("int").alias("_b"))
    # so many of the fine bounds
    bounds = bounds.select(*keys, F.expr("array_distinct(transform(sequence(1, _b - 1), k -> _bounds[CAST(floor(k * size(_bounds) / _b) AS INT)]))").alias("_bounds"))
    out = rows.withColumn("_order", order).join(bounds, keys, "left")
    return out.withColumn(name, F.when(F.col("_bounds").isNull(), 0).otherwise(F.size(F.filter("_bounds", lambda b: b < F.col("_order"))))).drop("_bounds", "_order"), True


def running(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], blocks: bool, later: bool = True, own: bool = True, order: str = "time", block: str = "block") -> DataFrame:
    """Sums of the columns over the rows with larger (or smaller) ``order``, with or without the row's own, in place of the columns.

    One row per key and value of ``order``; ``block`` grows with it. Within a block a window; the sums of whole other blocks come
    from a table of totals.
    """
    keys, by = list(keys), (F.desc(order) if later else F.asc(order))
    w = Window.partitionBy(*keys, block).orderBy(by).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    rest = [c for c in rows.columns if c not in columns]
    if not blocks:
        return rows.select(*rest, *(F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias(c) for c in columns))
    total = rows.groupBy(*keys, block).agg(*(F.sum(c).alias(c) for c in columns))
    beyond = Window.partitionBy(*keys).orderBy(F.desc(block) if later else F.asc(block)).rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*keys, block, *(F.coalesce(F.sum(c).over(beyond), F.lit(0.0)).alias("_of_" + c) for c in columns))
    return rows.join(total, [*keys, block]).select(*rest, *((F.coalesce(F.sum(c).over(w), F.lit(0.0)) + F.col("_of_" + c)).alias(c) for c in columns))


def quantiles(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float], one_buffer: int | None = None, stored: bool = False) -> DataFrame:
    """Exact quantiles of the non-null values per key: keys and q, an array (linear between ranks, as ``percentile``).

    The rows are kept once and read from there (``stored``: they are a table already). A key of more than ``one_buffer`` rows is
    not gathered: a sketch bounds each wanted rank from both sides, counts by the ranges between those bounds tell the range of each
    rank, and only the distinct values of those ranges are counted and ranked. A bound that is off makes a range larger, not a result wrong.
    """
    keys, limit = list(keys), ONE_BUFFER if one_buffer is None else one_buffer
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v"))
    rows = rows if stored else kept(rows).df
    whole = lambda x: x.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, probs))).alias("q"))
    sizes = kept(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))).df
    big, few = sizes.where(F.col("_n") > limit), not sizes.where(F.col("_n") <= limit).isEmpty()
    if big.isEmpty():
        return whole(rows)
    mine = rows.join(big, keys)
    # twice the error of the sketch on either side: a range has some 6 of SKETCH rows
    sides = [min(1.0, max(0.0, p + side * 2 / SKETCH)) for p in probs for side in (-1, 1)]
    bounds = kept(mine.groupBy(*keys).agg(F.percentile_approx("_v", sides, SKETCH).alias("_bounds"))).df
    place = reduce(add, ((F.get("_bounds", F.lit(k)) < F.col("_v")).cast("int") for k in range(len(sides))))
    found = mine.join(bounds, keys).select(*keys, "_n", "_v", place.alias("_r"))
    counts = found.groupBy(*keys, "_r", "_n").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = F.explode(F.array(*(F.struct(F.lit(i).alias("_i"), F.lit(side).alias("_side"), (F.floor(F.lit(float(p)) * (F.col("_n") - 1)) + side).alias("_rank")) for i, p in enumerate(probs) for side in (0, 1))))
    need = before.select("*", ranks.alias("_x")).select(*keys, "_r", "_n", "_before", "_c", "_x.*").withColumn("_rank", F.least("_rank", F.col("_n") - 1))
    need = kept(need.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))).df
    values = found.join(need.select(*keys, "_r").distinct(), [*keys, "_r"], "left_semi").groupBy(*keys, "_r", "_v").agg(F.count(F.lit(1)).alias("_c"))
    at = values.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_r").orderBy("_v")))
    at = at.join(need.select(*keys, "_r", "_i", "_side", "_rank", "_before"), [*keys, "_r"]).where((F.col("_rank") - F.col("_before") >= F.col("_upto") - F.col("_c")) & (F.col("_rank") - F.col("_before") < F.col("_upto")))
    ends = at.groupBy(*keys, "_i").agg(F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_low"), F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_high")).join(big, keys)
    place = F.element_at(F.array(*(F.lit(float(p)) for p in probs)), F.col("_i") + 1) * (F.col("_n") - 1)
    share = place - F.floor(place)
    mixed = ends.withColumn("_q", F.when(share == 0, F.col("_low")).otherwise(F.col("_low") + share * (F.col("_high") - F.col("_low"))))
    lists = mixed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias("q"))
    return lists.unionByName(whole(rows.join(big.select(*keys), keys, "left_anti"))) if few else lists
