"""Time-dependent ROC curves per key (RC1-RC3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.marker_parts import area_km, area_nne
from cohortspark.sources.shared import kept


def counts_at(df: DataFrame, keys: Sequence[str], horizon: float) -> DataFrame:
    """RC1: cases (event by the horizon), controls (followed past it) and censored before, and why there is no curve."""
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(((F.col("time") <= horizon) & (F.col("status") == 1)).cast("int")).alias("cases"),
        F.sum((F.col("time") > horizon).cast("int")).alias("controls"), F.sum(((F.col("time") <= horizon) & (F.col("status") == 0)).cast("int")).alias("censored"), F.max("time").alias("last"),
    )
    return g.withColumn("refusal", F.when(F.col("last") < horizon, "horizon beyond follow-up").when(F.col("cases") == 0, "no case").when(F.col("controls") == 0, "no control")).drop("last")


def auc(df: DataFrame, keys: Sequence[str], horizon: float, method: str = "KM", span: float | None = None, **how) -> DataFrame:
    """RC1-RC3: area and number of cuts for every key (a cohort, or a cohort and gene) that counts_at does not refuse.

    ``KM``: shares above each cut by Kaplan-Meier estimates; ``NNE``: survival smoothed over neighbours in rank. Rows with a null value
    count in none. A key may have any number of rows: its cuts are dealt to tasks.
    """
    keys = list(keys)
    df = kept(df.where("value IS NOT NULL AND NOT isnan(value)").select(*keys, "time", "status", "value")).df
    usable = counts_at(df, keys, horizon).where("refusal IS NULL").select(*keys)
    rows = df.join(usable, keys, "left_semi")
    return area_km(rows, keys, horizon, **how) if method == "KM" else area_nne(rows, keys, horizon, span, **how)
