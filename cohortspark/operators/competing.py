"""Competing risks (CR1-CR4). Status 0 is censored, other codes are causes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.cox import cox
from cohortspark.operators.cox_frame import Design, censoring, judged, sandwich, without_fit
from cohortspark.operators.ranges import quantiles
from cohortspark.sources.shared import kept

Z = 1.959963984540054


def cumulative_incidence(df: DataFrame, keys: Sequence[str], causes: Sequence[int], z: float = Z) -> DataFrame:
    """CR1: Aalen-Johansen curve per key (a cohort, a group) and cause: time, n_risk, n_event, cif, se, lower, upper.

    The variance is that of the infinitesimal jackknife, as sums over distinct times; the interval is on the log scale, at
    most 1, and null where the estimate is 0.
    """
    keys = list(keys)
    codes = [F.sum((F.col("status") == c).cast("int")).alias(f"d{c}") for c in causes]
    g = df.groupBy(*keys, "time").agg(F.sum((F.col("status") != 0).cast("int")).alias("d"), F.count(F.lit(1)).alias("m"), *codes)
    down = Window.partitionBy(*keys).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("n", F.sum("m").over(down).cast("double"))
    g = g.withColumn("s", F.exp(F.coalesce(F.sum(F.when(F.col("d") < F.col("n"), F.ln(1 - F.col("d") / F.col("n")))).over(prior), F.lit(0.0))))
    long = g.select(*keys, "time", "n", "s", "d", F.explode(F.array(*[F.struct(F.lit(c).alias("cause"), F.col(f"d{c}").alias("dk")) for c in causes])).alias("k")).select(*keys, "time", "n", "s", "d", "k.*")
    by = Window.partitionBy(*keys, "cause").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    x = long.withColumn("cif", F.sum(F.col("s") * F.col("dk") / F.col("n")).over(by))
    # a time u adds (cif(t) - cif(u))^2 g + h - 2 (cif(t) - cif(u)) j to the variance at t
    left = F.when(F.col("d") < F.col("n"), F.col("d") / (F.col("n") * (F.col("n") - F.col("d")))).otherwise(0.0)
    x = x.withColumn("g", left).withColumn("j", F.col("s") * F.col("dk") / F.col("n") ** 2).withColumn("h", F.col("s") ** 2 * F.col("dk") * (F.col("n") - F.col("dk")) / F.col("n") ** 3)
    total = lambda e: F.sum(e).over(by)
    cif = F.col("cif")
    var = cif**2 * total(F.col("g")) - 2 * cif * total(F.col("g") * cif) + total(F.col("g") * cif**2) + total(F.col("h")) - 2 * (cif * total(F.col("j")) - total(F.col("j") * cif))
    x = x.withColumn("se", F.sqrt(F.greatest(var, F.lit(0.0))))
    half = F.when(cif > 0, F.col("se") / cif * z)
    return x.select(*keys, "cause", "time", F.col("n").cast("long").alias("n_risk"), F.col("dk").alias("n_event"), "cif", "se", (cif * F.exp(-half)).alias("lower"), F.when(half.isNotNull(), F.least(cif * F.exp(half), F.lit(1.0))).alias("upper"))


def event_times(df: DataFrame, keys: Sequence[str], probs: Sequence[float] = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """CR1: the times at which curves are read by default: distinct positive quantiles of the event times per key."""
    keys = list(keys)
    q = quantiles(df.where("status <> 0"), keys, "time", probs)
    return q.select(*keys, F.explode(F.array_distinct("q")).alias("horizon")).where("horizon > 0")


def cif_at(curves: DataFrame, keys: Sequence[str], times: Sequence[float] | DataFrame, extend: bool = False) -> DataFrame:
    """CR1 at given times, or at those of a table (some of the keys, horizon): step lookup, 0 before the first time.

    Past the last time of a curve there is no row or, with ``extend``, the last value with nobody at risk. n_risk counts
    who is there just before the time.
    """
    by = [*keys, "cause"]
    if isinstance(times, DataFrame):
        long = curves.join(times, [c for c in times.columns if c != "horizon"])
    else:
        long = curves.withColumn("horizon", F.explode(F.array(*[F.lit(float(t)) for t in times])))
    hit = F.when(F.col("time") <= F.col("horizon"), F.col("time"))
    ahead = F.when(F.col("time") >= F.col("horizon"), F.col("time"))
    step = [F.max_by(c, hit).alias(c) for c in ("se", "lower", "upper")]
    g = long.groupBy(*by, "horizon").agg(F.max("time").alias("last"), F.coalesce(F.min_by("n_risk", ahead), F.lit(0)).alias("n_risk"), F.coalesce(F.max_by("cif", hit), F.lit(0.0)).alias("cif"), *step)
    g = g.withColumn("se", F.coalesce("se", F.lit(0.0)))
    return (g if extend else g.where(F.col("horizon") <= F.col("last"))).drop("last")


def group_by_cuts(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float], max_levels: int = 20) -> DataFrame:
    """CR2: a numeric column with more than max_levels values per key becomes right-open bins at its quantiles."""
    probs = list(probs)
    q = df.groupBy(*keys).agg(F.countDistinct(column).alias("levels")).join(quantiles(df, keys, column, probs).withColumnRenamed("q", "qs"), list(keys))
    bins = sum(((F.col(column) >= F.col("qs")[k]).cast("int") for k in range(1, len(probs))), (F.col(column) >= F.col("qs")[0]).cast("int"))
    return df.join(q, list(keys)).withColumn("group", F.when(F.col("levels") > max_levels, F.concat(F.lit("Q"), (bins + 1).cast("string"))).otherwise(F.col(column).cast("string"))).drop("qs", "levels")


def cause_specific(df: DataFrame, keys: Sequence[str], cause: int, cont: Sequence[str], cate: Sequence[str] = ()) -> DataFrame:
    """CR3: Cox model of one cause, the others censored."""
    return cox(df.withColumn("status", (F.col("status") == cause).cast("int")), keys, cont, cate)


def fine_gray(df: DataFrame, keys: Sequence[str], cause: int, cont: Sequence[str], cate: Sequence[str] = ()) -> DataFrame:
    """CR4: subdistribution hazard ratios of one cause with patient-clustered errors; ties after Efron.

    After a competing event a patient stays at risk with weight G(t-) / G(its time-), G the Kaplan-Meier curve of censoring. No row is
    expanded: at each event time the sums of such patients are scaled by G(t-). Rows: keys, time, status (0 censored).
    A key may have any number of rows.
    """
    keys = list(keys)
    coded = df.where("time >= 0 AND status IS NOT NULL").withColumn("code", F.col("status")).withColumn("status", (F.col("status") == cause).cast("int"))
    d = Design(coded, keys, cont, cate, extra=["code"])
    g = censoring(d.rows, keys, d.blocks)
    other = (F.col("code") != 0) & (F.col("code") != cause)
    rows = kept(d.rows.join(g, [*keys, "block", "time"]).withColumn("cw", F.when(other, 1 / F.col("g")).otherwise(0.0))).df
    fits = kept(d.fitted(weighted=rows)).df
    robust = sandwich(rows, fits, keys, d.p, d.blocks)
    seen = judged(fits.join(robust, keys), keys, d.p, robust=True, z=Z)
    out = seen.select(*keys, F.explode("rows").alias("_t")).select(*keys, "_t.*").drop("parameters", "epv")
    return out.unionByName(without_fit(d).drop("parameters", "epv"))
