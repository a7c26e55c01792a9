"""Kaplan-Meier curves, log-rank tests and cut-points, keyed by any columns (KM1-KM11).

Rows are first summed to distinct times per key; windows then run over those.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortspark.functions.stats import chi2_sf, lausen_schumacher
from cohortspark.operators.marker_parts import greatest_logrank
from cohortspark.operators.ranges import quantiles

Z975 = 1.959963984540054
#: Candidate cut-points: percentiles 0.20 to 0.80 by 0.05.
CANDIDATES = tuple(round(0.2 + 0.05 * k, 2) for k in range(13))


@F.pandas_udf(DoubleType())
def chisq_p(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom; null for null."""
    return x.map(lambda v: None if pd.isna(v) else chi2_sf(float(v), 1.0))


def cutpoints(df: DataFrame, keys: Sequence[str], rule: str, top_pct: float | None = None, value: float | None = None) -> DataFrame:
    """The cut of each key: median, mean, top (the (100-x)th percentile), or a fixed value."""
    if rule in ("median", "top"):
        return quantiles(df, keys, "value", [0.5 if rule == "median" else 1 - top_pct / 100]).select(*keys, F.col("q")[0].alias("cut"))
    if rule not in ("mean", "value"):
        raise ValueError(f"unknown cut rule {rule}")
    return df.groupBy(*keys).agg((F.avg("value") if rule == "mean" else F.max(F.lit(float(value)))).alias("cut"))


def split(df: DataFrame, keys: Sequence[str], rule: str = "median", **how) -> DataFrame:
    """KM1: adds cut and high (1 if value > cut, so ties are low), with the cut of each key."""
    return df.join(cutpoints(df, keys, rule, **how), list(keys)).withColumn("high", (F.col("value") > F.col("cut")).cast("int"))


def at_risk(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and distinct time: events d, leaving m, and n at risk."""
    byt = df.groupBy(*keys, "time").agg(F.sum("status").alias("d"), F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*keys).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    return byt.withColumn("n", F.sum("m").over(w))


def curve(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """KM2: n_risk, n_event, n_censor, survival, its standard error and the log-type interval at each time."""
    w = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    d, n = F.col("d").cast("double"), F.col("n").cast("double")
    out = at_risk(df, keys).withColumn("gone", F.max((F.col("d") == F.col("n")).cast("int")).over(w))
    out = out.withColumn("log_s", F.sum(F.when(F.col("d") < F.col("n"), F.ln(1 - d / n)).otherwise(0.0)).over(w))
    out = out.withColumn("green", F.sum(F.when(F.col("d") < F.col("n"), d / (n * (n - d))).otherwise(0.0)).over(w))
    s, g = F.exp("log_s"), F.sqrt("green")
    alive = F.col("gone") == 0
    return out.select(
        *keys, "time", F.col("n").alias("n_risk"), F.col("d").alias("n_event"), (F.col("m") - F.col("d")).alias("n_censor"),
        F.when(alive, s).otherwise(0.0).alias("surv"), F.when(alive, s * g).alias("se"),
        F.when(alive, F.exp(F.col("log_s") - Z975 * g)).alias("lower"), F.when(alive, F.least(F.lit(1.0), F.exp(F.col("log_s") + Z975 * g))).alias("upper"),
    )


def surv_at(curves: DataFrame, keys: Sequence[str], times: Sequence[float]) -> DataFrame:
    """KM3: survival at given times as a step lookup; no row past the last follow-up, 1 with error 0 before the first time."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in times])).alias("horizon")
    long = curves.select("*", at)
    hit = F.col("time") <= F.col("horizon")
    out = long.groupBy(*keys, "horizon").agg(
        F.max("time").alias("last"), F.max_by("surv", F.when(hit, F.col("time"))).alias("s"), F.max_by("se", F.when(hit, F.col("time"))).alias("e"),
        F.max(F.when(hit, 1).otherwise(0)).alias("any"), F.sum(F.when(F.col("time") >= F.col("horizon"), F.col("n_event") + F.col("n_censor")).otherwise(0)).alias("n_risk"),
    )
    return out.where(F.col("horizon") <= F.col("last")).select(*keys, "horizon", F.when(F.col("any") == 1, F.col("s")).otherwise(1.0).alias("surv"), F.when(F.col("any") == 1, F.col("e")).otherwise(0.0).alias("se"), "n_risk")


def logrank(df: DataFrame, keys: Sequence[str], strata: Sequence[str] = (), p: bool = True) -> DataFrame:
    """KM4/KM5: observed and expected events of the high group, variance, chi-square; strata are summed over."""
    by = [*keys, *strata]
    g = df.groupBy(*by, "time").agg(F.sum("status").alias("d"), F.sum(F.col("status") * F.col("high")).alias("d1"), F.count(F.lit(1)).alias("m"), F.sum("high").alias("m1"))
    w = Window.partitionBy(*by).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    r = g.withColumn("n", F.sum("m").over(w).cast("double")).withColumn("n1", F.sum("m1").over(w).cast("double")).withColumn("d", F.col("d").cast("double"))
    z = r.groupBy(*keys).agg(
        F.sum("d1").alias("obs_high"), F.sum(F.col("d") * F.col("n1") / F.col("n")).alias("exp_high"),
        F.sum(F.when(F.col("n") > 1, F.col("d") * F.col("n1") / F.col("n") * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)).alias("var_high"),
    )
    chi = F.when(F.col("var_high") > 0, (F.col("obs_high") - F.col("exp_high")) ** 2 / F.col("var_high"))
    z = z.withColumn("chisq", chi)
    return z.withColumn("p", chisq_p("chisq")) if p else z


def group_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """KM6: patients and events by group, median follow-up, small-group (<5) and few-events (<10) flags."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("high").alias("n_high"), F.sum(1 - F.col("high")).alias("n_low"), F.sum("status").alias("events"),
        F.sum(F.col("status") * F.col("high")).alias("events_high"), F.percentile("time", F.lit(0.5)).alias("median_follow_up"),
        ((F.sum("high") < 5) | (F.sum(1 - F.col("high")) < 5)).alias("small_group"), (F.sum("status") < 10).alias("few_events"),
    )


def best_cut(df: DataFrame, keys: Sequence[str], probs: Sequence[float] = CANDIDATES, min_group: int = 5, min_n: int = 20, p: bool = True) -> DataFrame:
    """KM8: the candidate percentile with the greatest chi-square (the first of ties), both groups of min_group at least."""
    enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all")).where(F.col("n_all") >= min_n)
    cuts = quantiles(df, keys, "value", probs).withColumnRenamed("q", "cuts").join(enough, list(keys))
    cand = df.join(cuts.select(*keys, F.posexplode("cuts").alias("cand", "cut")), list(keys)).withColumn("high", (F.col("value") > F.col("cut")).cast("int"))
    by = [*keys, "cand", "cut"]
    sizes = cand.groupBy(*by).agg(F.sum("high").alias("n_high"), F.sum(1 - F.col("high")).alias("n_low")).where((F.col("n_high") >= min_group) & (F.col("n_low") >= min_group))
    tested = logrank(cand, by, p=p).join(sizes, by).where("chisq IS NOT NULL")
    first = Window.partitionBy(*keys).orderBy(F.desc(F.round("chisq", 9)), "cand")
    count = Window.partitionBy(*keys)
    return tested.withColumn("candidates", F.count(F.lit(1)).over(count)).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def adjusted_cut_p(df: DataFrame, keys: Sequence[str], low: float = 0.1, high: float = 0.9, **how) -> DataFrame:
    """KM9: maximally selected log-rank over all cut-points between two quantiles, p by the 1992 approximation.

    A key may have any number of rows: its cut-points are dealt to tasks, each starting from the sums of the greater ones.
    """
    found = greatest_logrank(df.where("value IS NOT NULL AND NOT isnan(value)"), keys, low, high, **how)

    @F.pandas_udf(DoubleType())
    def p(x: pd.Series) -> pd.Series:
        return x.map(lambda v: lausen_schumacher(float(v), low, high))

    return found.withColumn("p_adjusted", p("max_stat"))


def pool_ledger(df: DataFrame, min_rows: int = 10) -> DataFrame:
    """KM10: per dataset the rows, distinct values and sizes of both groups, and why it is skipped (null: it is used)."""
    g = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("values"), F.sum("high").alias("n_high"))
    return g.withColumn("reason", F.when(F.col("n") < min_rows, "fewer than 10 complete rows").when(F.col("values") < 2, "a single marker value").when((F.col("n_high") == 0) | (F.col("n_high") == F.col("n")), "one-sided split"))


def pooled_ipd(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """KM10: ledger, pooled curve by group, plain and stratified log-rank over the usable cohorts."""
    ledger = pool_ledger(df)
    used = df.join(ledger.where("reason IS NULL").select("dataset"), "dataset", "left_semi")
    whole = used.withColumn("pool", F.lit("all"))
    return ledger, curve(whole, ["high"]), logrank(whole, ["pool"], p=False), logrank(whole, ["pool"], ["dataset"], p=False)


def landmark_estimates(df: DataFrame, times: Sequence[float]) -> DataFrame:
    """KM11: log(-log S) and its error per dataset, group and time; S of 0 or 1 and zero errors are left out."""
    at = surv_at(curve(df, ["dataset", "high"]), ["dataset", "high"], times).where("surv > 0 AND surv < 1 AND se > 0")
    return at.select("dataset", "high", "horizon", F.ln(-F.ln("surv")).alias("b"), (F.col("se") / (F.col("surv") * F.abs(F.ln("surv")))).alias("se"))
