"""Two-stage meta-analysis of one marker (MT1, MT8) and of a gene panel (MT6), with confounders and the gates before it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import cox_kernel as kernel
from cohortspark.functions.stats import normal_two_sided
from cohortspark.operators import cox
from cohortspark.operators.cohorts import overlap_policy
from cohortspark.operators.cox_frame import fit_models
from cohortspark.operators.meta import Z, adjust, pool_groups
from cohortspark.sources.shared import kept

#: Endpoint classes that a pooling mode takes.
ALLOWED = {"family": ("Exact-equivalent", "Clinically-related"), "exact": ("Exact-equivalent",)}
LEDGER = ("dataset", "stage", "reason")


class Gated(NamedTuple):
    """Rows of the cohorts that are left, why others are not, and the covariates that left cohorts of a repaired analysis."""

    rows: DataFrame
    ledger: DataFrame
    changes: DataFrame


def _said(df: DataFrame, stage: str, reason) -> DataFrame:
    return df.select("dataset", F.lit(stage).alias("stage"), reason.alias("reason"))


def gate(
    df: DataFrame, classes: DataFrame | None = None, pooling: str = "family", tokens: DataFrame | None = None, overlaps: tuple[DataFrame, DataFrame] | None = None, overlap: str = "warn",
    confounders: Sequence[str] = (), auto_repair: bool = False,
) -> Gated:
    """What keeps a cohort out before any fit: ledger of dataset, stage (overlap, pooling, model) and reason.

    overlaps: groups (accession, root) and pairs (a, b, shared) of cohorts that share patients; ``dedupe`` keeps the largest of
    each group, ``refuse`` raises, ``warn`` keeps all. classes: dataset, token, pooling_class; tokens: dataset, token that
    the analysis uses: a cohort whose recorded token differs stays out. A confounder that a cohort lacks or that does not vary in it keeps
    the cohort out, unless ``auto_repair``: then it leaves the model there (changes: dataset, variable, detail) and its column is constant.
    """
    spark = df.sparkSession
    # every gate and the fits read the rows, and the ledger reads the gates: each is made once
    df = kept(df).df
    notes, rows = [], df
    if overlaps is not None:
        sizes = df.groupBy(F.col("dataset").alias("accession")).agg(F.countDistinct("sample_id").alias("n"))
        fate = overlap_policy(sizes, *overlaps, mode=overlap)
        lost = kept(fate.where("NOT kept").withColumnRenamed("accession", "dataset")).df
        notes.append(_said(lost, "overlap", F.col("reason")))
        rows = rows.join(lost.select("dataset"), "dataset", "left_anti")
    if classes is not None:
        seen = rows.select("dataset").distinct().join(classes, "dataset", "left")
        conflict = F.lit(False)
        if tokens is not None:
            seen = seen.join(tokens.select("dataset", F.col("token").alias("_used")), "dataset", "left")
        seen = kept(seen).df
        if tokens is not None:
            conflict = F.coalesce(F.col("token") != F.col("_used"), F.lit(False))
            notes.append(_said(seen.where(conflict), "pooling", F.concat(F.lit("endpoint token conflict: analysis uses "), "_used", F.lit(", classification records "), "token")))
        fits = F.coalesce(F.col("pooling_class").isin(*ALLOWED[pooling]), F.lit(False))
        notes.append(_said(seen.where(~conflict & ~fits), "endpoint class", F.concat(F.lit("pooling class "), F.coalesce("pooling_class", F.lit("Unknown")))))
        rows = rows.join(seen.where(~conflict & fits).select("dataset"), "dataset", "left_semi")
    changes = spark.createDataFrame([], "dataset string, variable string, detail string")
    if confounders:
        text = [F.col(c).cast("string") for c in confounders]
        spread = rows.groupBy("dataset").agg(*(F.min(c).alias(f"_a{k}") for k, c in enumerate(text)), *(F.max(c).alias(f"_b{k}") for k, c in enumerate(text)))
        detail = lambda k: F.when(F.col(f"_a{k}").isNull(), "absent from the data").when(F.col(f"_a{k}") == F.col(f"_b{k}"), "constant in this cohort")
        faulty = F.filter(F.array(*(F.struct(F.lit(c).alias("variable"), detail(k).alias("detail")) for k, c in enumerate(confounders))), lambda x: x["detail"].isNotNull())
        bad = kept(spread.select("dataset", faulty.alias("_bad")).where(F.size("_bad") > 0)).df
        if auto_repair:
            changes = bad.select("dataset", F.explode("_bad").alias("_x")).select("dataset", "_x.*")
            out = F.transform("_bad", lambda x: x["variable"])
            rows = rows.join(bad.select("dataset", out.alias("_out")), "dataset", "left")
            still = lambda c: F.coalesce(F.array_contains("_out", c), F.lit(False))
            rows = rows.withColumns({c: F.when(still(c), F.lit("0").cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c in confounders}).drop("_out")
        else:
            said = F.array_join(F.transform("_bad", lambda x: F.concat(x["variable"], F.lit(" "), x["detail"])), "; ")
            notes.append(_said(bad, "model", F.concat(F.lit("not estimable without repair: "), said)))
            rows = rows.join(bad.select("dataset"), "dataset", "left_anti")
    ledger = notes[0] if notes else spark.createDataFrame([], "dataset string, stage string, reason string")
    for n in notes[1:]:
        ledger = ledger.unionByName(n)
    return Gated(rows, ledger, changes)


FITS = "n long, events long, b double, se double, hr double, lower double, upper double, p double, parameters int, epv double, reason string"
_NAMES = [c.split()[0] for c in FITS.split(", ")]


def _values(b, se, n, events, parameters, reason) -> list:
    good = [float(b), float(se), float(np.exp(b)), float(np.exp(b - Z * se)), float(np.exp(b + Z * se)), normal_two_sided(b / se)] if reason is None else [None] * 6
    return [int(n), int(events), *good, int(parameters), events / parameters, reason]


def _reason(n, events, flat, min_n, min_events):
    return f"fewer than {min_n} complete samples" if n < min_n else f"fewer than {min_events} events" if events < min_events else "no censored sample" if events == n else "constant marker" if flat else None


def adjusted_screen(df: DataFrame, cont: Sequence[str] = (), cate: Sequence[str] = (), min_n: int = 10, min_events: int = 5, large: int | None = None) -> DataFrame:
    """First stage with confounders: per dataset and gene the marker's estimate beside them, for a marker of deviation 1.

    Rows: dataset, sample_id, gene, time, status, value and the confounders (numbers, categories). Samples with a null count in
    none. A task fits all genes of a bucket at once, sharing the confounders' columns; a cohort of more than ``large`` samples is fitted
    by sums per distinct time. A confounder that is constant in a cohort is no column there.
    """
    cont, cate = list(cont), list(cate)
    ok = F.col("time").isNotNull() & (F.col("time") >= 0) & F.col("status").isin(0, 1) & F.col("value").isNotNull() & ~F.isnan("value")
    for c in [*cont, *cate]:
        ok = ok & F.col(c).isNotNull()
    rows = kept(df.where(ok).groupBy("dataset", "sample_id", "gene").agg(F.max("time").alias("time"), F.max("status").alias("status"), F.max("value").cast("double").alias("value"), *(F.max(F.col(c).cast("double")).alias(c) for c in cont), *(F.max(F.col(c).cast("string")).alias(c) for c in cate))).df
    most = cox.LARGE if large is None else large
    genes = cox.dealt(rows, 2 + len(cont) + len(cate))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot_table(index="sample_id", columns="_g", values="value", aggfunc="max")
        who = g.drop_duplicates("sample_id").set_index("sample_id").loc[wide.index]
        t, s, x = who["time"].to_numpy(float), who["status"].to_numpy(float), wide.to_numpy(float)
        columns = [who[c].to_numpy(float) for c in cont] + [(who[c] == lv).to_numpy(float) for c in cate for lv in sorted(who[c].unique())[1:]]
        columns = [(c - c.mean()) / c.std() for c in columns if np.ptp(c) > 0]
        z = np.stack(columns, axis=1) if columns else np.zeros((len(x), 0))
        use = np.isfinite(x)
        n, events = use.sum(axis=0), (use * s[:, None]).sum(axis=0)
        mean = np.where(use, x, 0).sum(axis=0) / np.maximum(n, 1)
        sd = np.sqrt(np.where(use, (x - mean) ** 2, 0).sum(axis=0) / np.maximum(n - 1, 1))
        flat = ~(sd > 1e-12 * np.maximum(1, np.abs(mean)))
        fit = kernel.fit_shared(t, s, (x - mean) / np.where(flat, 1, sd), z)
        out = []
        for j, name in enumerate(wide.columns):
            why = _reason(n[j], events[j], flat[j], min_n, min_events) or kernel.verdict(fit.beta[j], fit.se[j], bool(fit.converged[j]))
            out.append([g["_d"].iloc[0], name, *_values(fit.beta[j], fit.se[j], n[j], events[j], 1 + z.shape[1], why)])
        return pd.DataFrame(out, columns=["_d", "_g", *_NAMES])

    fits = cox.by_bucket(rows, genes.where(F.col("_samples") <= most), ["time", "status", "value", *cont, *cate], one, FITS)
    large_ones = genes.where(F.col("_samples") > most).select("dataset").distinct()
    if large_ones.isEmpty():
        return fits
    big = rows.join(large_ones, "dataset")
    about = big.groupBy("dataset", "gene").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("status").cast("long")).alias("events"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    flat = ~F.coalesce(F.col("_s") > 1e-12 * F.greatest(F.lit(1.0), F.abs("_m")), F.lit(False))
    why = F.when(F.col("n") < min_n, f"fewer than {min_n} complete samples").when(F.col("events") < min_events, f"fewer than {min_events} events").when(F.col("events") == F.col("n"), "no censored sample").when(flat, "constant marker")
    about = kept(about.withColumn("reason", why)).df
    z = big.join(about.where("reason IS NULL").select("dataset", "gene", "_m", "_s"), ["dataset", "gene"]).withColumn("value", (F.col("value") - F.col("_m")) / F.col("_s"))
    found = fit_models(z, ["dataset", "gene"], ["value", *cont], cate, skip_flat=True).where("variable = 'value'").withColumn("reason", F.regexp_replace("reason", "^not estimable: ", ""))
    null = {c: F.lit(None).cast("double") for c in ("b", "se", "hr", "lower", "upper", "p", "epv")}
    none = about.where("reason IS NOT NULL").withColumns(null | {"parameters": F.lit(1)})
    return fits.unionByName(found.select("dataset", "gene", *_NAMES)).unionByName(none.select("dataset", "gene", *_NAMES))


def two_stage(df: DataFrame, classes: DataFrame | None = None, pooling: str = "family", cont: Sequence[str] = (), cate: Sequence[str] = (), **gates) -> tuple[DataFrame, DataFrame]:
    """MT1/MT8: estimates per cohort of one marker and a ledger of exclusions (dataset, stage, reason).

    Rows as adjusted_screen takes them, with one gene; cont, cate: confounders; gates: tokens, overlaps, overlap and auto_repair of ``gate``.
    Estimates have covariates_used, parameters and events for each of them (epv).
    """
    g = gate(df.select("dataset", "sample_id", "gene", "time", "status", "value", *cont, *cate), classes, pooling, confounders=[*cont, *cate], **gates)
    fits = kept(adjusted_screen(g.rows, cont, cate)).df
    failed = fits.where("reason IS NOT NULL").select("dataset", F.lit("fit").alias("stage"), "reason")
    names = F.array(*map(F.lit, [*cont, *cate])) if [*cont, *cate] else F.array().cast("array<string>")
    lost = g.changes.groupBy("dataset").agg(F.collect_set("variable").alias("_lost"))
    used = F.array_join(F.array_except(names, F.coalesce("_lost", F.array().cast("array<string>"))), ", ")
    out = fits.where("b IS NOT NULL").join(lost, "dataset", "left").withColumn("covariates_used", used).drop("_lost")
    return out, g.ledger.unionByName(failed)


def ph_by_cohort(df: DataFrame, cont: Sequence[str] = (), cate: Sequence[str] = ()) -> DataFrame:
    """Proportional-hazards tests of the cohorts' models of one marker: dataset, term, level, chisq, df, p (GLOBAL included)."""
    ready = df.where("value IS NOT NULL AND NOT isnan(value)")
    return cox.ph(ready, ["dataset"], ["value", *cont], cate)


def panel(df: DataFrame, method: str = "REML", pi: str = "t", fdr: str = "BH", cont: Sequence[str] = (), cate: Sequence[str] = (), classes: DataFrame | None = None, pooling: str = "family", **gates) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MT6: per gene the pooled estimate over cohorts, with p adjusted over genes of two cohorts at least; the fits; the ledger.

    Confounders and gates as in two_stage. Failed fits count in n_failed. A gene without any fit has null estimates.
    """
    g = gate(df.select("dataset", "sample_id", "gene", "time", "status", "value", *cont, *cate), classes, pooling, confounders=[*cont, *cate], **gates)
    fits = kept(adjusted_screen(g.rows, cont, cate)).df if [*cont, *cate] else kept(cox.screen(g.rows)).df
    pooled = pool_groups(fits.where("b IS NOT NULL"), ["gene"], method, pi)
    counts = fits.groupBy("gene").agg(F.count(F.lit(1)).alias("cohorts"), F.sum(F.col("reason").isNotNull().cast("int")).alias("n_failed"))
    table = counts.join(pooled, "gene", "left").withColumn("p_family", F.when(F.col("k") >= 2, F.col("p")))
    return adjust(table, "p_family", fdr).drop("p_family").withColumnRenamed("p_adj", "fdr"), fits, g.ledger
