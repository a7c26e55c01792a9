"""Adjudication sampling and rater agreement (AG1-AG4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def records(grid: DataFrame, source: Column) -> DataFrame:
    """AG1: numbered records over the sorted grid, with the stratum family x source.

    The grid has five rows per cohort; the numbering is one window over it.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("accession", "family")
    return grid.withColumn("record_id", F.concat(F.lit("R"), F.lpad(F.row_number().over(w).cast("string"), 4, "0"))).withColumn("stratum", F.concat_ws(" / ", "family", source))


def allocate(sizes: DataFrame, target: int) -> DataFrame:
    """AG2: seats per stratum by largest remainders, capped at its size; ties by stratum name. sizes: stratum, size.

    Some dozens of strata.
    """
    every = Window.partitionBy(F.lit(1))
    total = F.sum("size").over(every)
    want = F.least(F.lit(target), total)
    q = sizes.withColumn("quota", want.cast("double") * F.col("size") / total).withColumn("seats", F.floor("quota"))
    left = F.least(F.lit(target), total) - F.sum("seats").over(every)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("quota") - F.col("seats"), 9)), "stratum"))
    q = q.withColumn("_left", left).withColumn("_rank", rank)
    return q.select("stratum", "size", (F.col("seats") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("seats"))


def draw(rec: DataFrame, target: int, seed: int = 1) -> DataFrame:
    """AG2: the allocated number of records of each stratum, first by the MD5 sum of record and seed."""
    seats = allocate(rec.groupBy("stratum").agg(F.count(F.lit(1)).alias("size")), target)
    w = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws(":", F.col("record_id"), F.lit(str(seed))).cast("binary")), "record_id")
    return rec.withColumn("_r", F.row_number().over(w)).join(seats.select("stratum", "seats"), "stratum").where("_r <= seats").drop("_r", "seats")


def ratings_long(sheet: DataFrame, raters: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """record_id, field, rater, rating of every filled cell of rater<r>_<field> columns."""
    cells = [F.struct(F.lit(f).alias("field"), F.lit(r).alias("rater"), F.col(f"rater{r}_{f}").cast("string").alias("rating")) for r in raters for f in fields]
    return sheet.select("record_id", F.explode(F.array(*cells)).alias("c")).select("record_id", "c.*").where("rating IS NOT NULL AND trim(rating) <> ''")


def kappa(long: DataFrame) -> DataFrame:
    """AG3: Cohen's kappa per field and pair of raters over records both rated; null when chance agreement is 1."""
    a = long.select("record_id", "field", F.col("rater").alias("r1"), F.col("rating").alias("x1"))
    b = long.select("record_id", "field", F.col("rater").alias("r2"), F.col("rating").alias("x2"))
    both = a.join(b, ["record_id", "field"]).where("r1 < r2").groupBy("field", "r1", "r2", "x1", "x2").agg(F.count(F.lit(1)).alias("n"))
    key = ["field", "r1", "r2"]
    m1 = both.groupBy(*key, F.col("x1").alias("x")).agg(F.sum("n").alias("c1"))
    m2 = both.groupBy(*key, F.col("x2").alias("x")).agg(F.sum("n").alias("c2"))
    chance = m1.join(m2, [*key, "x"]).groupBy(*key).agg(F.sum(F.col("c1") * F.col("c2")).cast("double").alias("chance"))
    g = both.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x1") == F.col("x2"), F.col("n")).otherwise(0)).alias("same")).join(chance, key, "left")
    po, pe = F.col("same").cast("double") / F.col("n"), F.coalesce("chance", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    g = g.withColumn("agreement", po).withColumn("pe", pe).withColumn("kappa", F.when(F.col("pe") < 1, (F.col("agreement") - F.col("pe")) / (1 - F.col("pe"))))
    label = F.when(F.col("kappa").isNull(), F.lit(None)).when(F.col("kappa") < 0, "poor").when(F.col("kappa") <= 0.2, "slight").when(F.col("kappa") <= 0.4, "fair").when(F.col("kappa") <= 0.6, "moderate").when(F.col("kappa") <= 0.8, "substantial").otherwise("almost perfect")
    return g.select(*key, "n", "agreement", "kappa", label.alias("label"))


def disagreements(long: DataFrame) -> DataFrame:
    """AG4: records and fields whose raters differ, with what each said."""
    return long.groupBy("record_id", "field").agg(F.countDistinct("rating").alias("k"), F.array_join(F.array_sort(F.collect_list(F.concat("rater", F.lit("="), "rating"))), "; ").alias("detail")).where("k > 1").drop("k")


def adjudication_rate(long: DataFrame) -> DataFrame:
    """AG4: disagreeing over comparable records by field."""
    g = long.groupBy("record_id", "field").agg(F.countDistinct("rating").alias("k"), F.countDistinct("rater").alias("raters")).where("raters > 1")
    return g.groupBy("field").agg(F.count(F.lit(1)).alias("comparable"), F.sum((F.col("k") > 1).cast("int")).alias("disagreeing"), F.avg((F.col("k") > 1).cast("double")).alias("rate"))
