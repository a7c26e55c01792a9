"""Run audit (AU1, AU2)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.cohorts import first_of

#: Rows of a table that its line of the audit spells out; the others are counted.
SPELLED = 6


def _lines(parts: Mapping[str, tuple[DataFrame, Column]], none: str = "none") -> DataFrame:
    """One row for each field: its value spells the first of the distinct texts in order and counts the rest."""
    found = None
    for field, (rows, text) in parts.items():
        one = rows.select(F.lit(field).alias("field"), text.alias("x")).where("x IS NOT NULL")
        found = one if found is None else found.unionByName(one)
    more = F.col("different") - SPELLED
    value = F.concat(F.array_join("first", " | "), F.when(more > 0, F.concat(F.lit(" | ... (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
    names = found.sparkSession.createDataFrame([(f,) for f in parts], "field string")
    return names.join(first_of(found, ["field"], SPELLED), "field", "left").select("field", F.coalesce(value, F.lit(none)).alias("value"))


def run_audit(
    rows: DataFrame, run_id: str, said: Mapping[str, object], ledger: DataFrame, n_input: DataFrame, endpoints: DataFrame,
    overlap: DataFrame | None = None, dropped_covariates: DataFrame | None = None,
) -> DataFrame:
    """AU1: run_id, field, value of one analysis, always with the same fields.

    rows: what was analysed (dataset, status). said: plain fields (analysis, marker, estimator, cut rule, ...). ledger:
    dataset, reason of exclusions (null: used). n_input: dataset, n before any loss. endpoints: dataset, family, token,
    token_role, pooling_class. overlap: accession, dropped_for, reason of the overlap policy. dropped_covariates: dataset, variable,
    reason. Tables are one per cohort; each becomes a line that spells its first rows.
    """
    sums = rows.agg(F.countDistinct("dataset").alias("n_cohorts"), F.count(F.lit(1)).alias("n_analyzed"), F.coalesce(F.sum("status"), F.lit(0)).alias("events"))
    given = n_input.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_input"))
    one = sums.crossJoin(F.broadcast(given)).withColumn("n_excluded", F.col("n_input") - F.col("n_analyzed"))  # one row each
    names = ["n_cohorts", "n_input", "n_analyzed", "n_excluded", "events"]
    spell = {k: ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) for k, v in said.items()}
    plain = [F.struct(F.lit(k).alias("field"), F.lit(v).alias("value")) for k, v in spell.items()]
    out = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in names], *plain)).alias("x")).select("x.*")
    left = n_input.join(rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("_used")), "dataset", "left").withColumn("lost", F.col("n") - F.coalesce("_used", F.lit(0))).where("lost > 0")
    used = endpoints.join(rows.select("dataset").distinct(), "dataset", "left_semi")
    name, nothing = F.col("dataset"), (rows.select("dataset").limit(0), F.col("dataset"))
    lines = _lines({
        "cohorts": (rows.select("dataset").distinct(), name),
        "endpoint_family": (used, F.col("family")), "resolved_tokens_per_cohort": (used, F.concat("dataset", F.lit("="), "token")),
        "token_role": (used, F.col("token_role")), "pooling_classes_pooled": (used, F.col("pooling_class")),
        "excluded_cohorts": (ledger.where("reason IS NOT NULL"), F.concat("dataset", F.lit(": "), "reason")),
        "rows_dropped": (left, F.concat("dataset", F.lit(": "), F.col("lost").cast("string"))),
        "overlap_dropped": nothing if overlap is None else (overlap.where("dropped_for IS NOT NULL"), F.concat("accession", F.lit(": "), "reason")),
        "covariates_dropped": nothing if dropped_covariates is None else (dropped_covariates, F.concat("dataset", F.lit(" "), "variable", F.lit(": "), "reason")),
    })
    out = out.unionByName(lines)
    return out.select(F.lit(run_id).alias("run_id"), "field", "value")


def content_hash(rows: DataFrame) -> DataFrame:
    """AU2: number of rows and an order-free hash of them per dataset: the sum of the first 60 bits of each row's MD5.

    A row is its columns in the order of their names, as text, joined by the unit separator; nulls are empty.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in sorted(rows.columns)])
    part = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.sum(part).cast("string").alias("hash"))
