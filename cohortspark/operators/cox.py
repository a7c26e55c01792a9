"""Cox models per cohort and marker (CX1-CX9)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import cox_kernel as kernel
from cohortspark.functions.stats import normal_two_sided
from cohortspark.operators.cox_frame import Design, fit_models, residual_test
from cohortspark.operators.meta import Z
from cohortspark.sources.shared import kept

COX_SCHEMA = "variable string, level string, n long, events long, b double, se double, hr double, lower double, upper double, p double, reason string"
#: Events for each coefficient below which a joint model has a warning.
LEAST_EPV = 10
FIT_SCHEMA = "n long, events long, b double, se double, hr double, lower double, upper double, p double, reason string"


def _row(b, se, n, events, reason):
    bad = reason is not None
    b, se = (None, None) if bad else (float(b), float(se))
    return [int(n), int(events), b, se, *([None] * 4 if bad else [float(np.exp(b)), float(np.exp(b - Z * se)), float(np.exp(b + Z * se)), normal_two_sided(b / se)]), reason]


#: Cells (samples by genes) of a matrix that a task fits at once, and samples of a cohort from which its fits are sums over DataFrames.
CELLS, LARGE = 1_000_000, 500_000


def dealt(rows: DataFrame, width: int = 1, buckets: int | None = None) -> DataFrame:
    """A table with a row per cohort and gene of the rows: _d and _g stand for their names, _bucket for the task that fits the gene.

    Genes are dealt in order, so many to a bucket as CELLS takes of the samples of the fullest gene times ``width``: no bucket has more
    by chance. _n are a gene's rows, _samples those of the cohort's fullest gene: a gene has at most one row for each sample.
    """
    each = kept(rows.groupBy("dataset", "gene").agg(F.count(F.lit(1)).alias("_n"))).df
    cohorts = kept(each.groupBy("dataset").agg(F.max("_n").alias("_samples")).withColumn("_d", F.monotonically_increasing_id())).df
    place = F.row_number().over(Window.partitionBy("dataset").orderBy("gene")) - 1
    fit = F.greatest(F.lit(1), F.floor(F.lit(float(CELLS)) / (F.col("_samples") * width)))
    bucket = F.pmod(place, F.lit(buckets)) if buckets else F.floor(place / fit)
    return kept(each.join(cohorts, "dataset").select("dataset", "gene", "_n", "_samples", "_d", place.alias("_g"), bucket.cast("int").alias("_bucket"))).df


def by_bucket(rows: DataFrame, genes: DataFrame, columns: Sequence[str], one, schema: str) -> DataFrame:
    """What ``one`` makes of each bucket's rows (_g, sample_id, columns), with the names back. It returns _g and the schema's columns."""
    named = rows.join(genes.select("dataset", "gene", "_d", "_g", "_bucket"), ["dataset", "gene"])
    made = named.select("_d", "_bucket", "_g", "sample_id", *columns).groupBy("_d", "_bucket").applyInPandas(one, "_d long, _g int, " + schema)
    return made.join(genes.select("_d", "_g", "dataset", "gene"), ["_d", "_g"]).select("dataset", "gene", *(c.split()[0] for c in schema.split(", ")))


def screen(df: DataFrame, gene: str = "gene", buckets: int | None = None, scale: bool = True, min_n: int = 10, min_events: int = 5, joint: bool = False, large: int | None = None) -> DataFrame:
    """Univariable fits of every gene in every cohort (CX3, CX4, the first stage of MT6): dataset, gene, n, events, estimate, reason.

    Rows: dataset, sample_id, gene, time, status, value. Only complete rows count; ``joint`` keeps the samples complete for
    all genes that the rows have for the cohort. With ``scale`` a marker has mean 0 and sample deviation 1 within its cohort. Genes
    of a cohort are dealt to buckets (as many as its cells ask for); a bucket is one task's matrix of samples by genes, fitted in one
    batch. A cohort with more than ``large`` samples (LARGE) is fitted by sums per distinct time instead, with the same
    results. Failures stay as rows with null estimates and a reason.
    """
    df = kept(df.select("dataset", "sample_id", F.col(gene).alias("gene"), "time", "status", "value")).df
    gene = "gene"
    ok = df.where(F.col("time").isNotNull() & (F.col("time") >= 0) & F.col("status").isin(0, 1) & F.col("value").isNotNull() & ~F.isnan("value"))
    if joint:
        listed = df.where(F.col(gene).isNotNull()).groupBy("dataset").agg(F.countDistinct(gene).alias("_listed"))
        whole = kept(ok.groupBy("dataset", "sample_id").agg(F.countDistinct(gene).alias("_genes")).join(listed, "dataset").where("_genes = _listed").select("dataset", "sample_id")).df
        ok = ok.join(whole, ["dataset", "sample_id"], "left_semi")
    most = LARGE if large is None else large
    genes = dealt(ok, buckets=buckets)
    fits = _screen_matrices(ok, genes.where(F.col("_samples") <= most), scale, min_n, min_events)
    big = genes.where(F.col("_samples") > most).select("dataset").distinct()
    if not big.isEmpty():
        fits = fits.unionByName(_screen_sums(ok.join(big, "dataset"), scale, min_n, min_events))
    if not joint:
        return fits
    # genes of a cohort without a complete sample
    none = df.where(F.col(gene).isNotNull()).select("dataset", F.col(gene).alias("gene")).distinct().join(whole.select("dataset").distinct(), "dataset", "left_anti")
    null = [F.lit(None).cast("double").alias(c) for c in ("b", "se", "hr", "lower", "upper", "p")]
    return fits.unionByName(none.select("dataset", "gene", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("events"), *null, F.lit(f"fewer than {min_n} complete samples").alias("reason")))


def _screen_sums(ok: DataFrame, scale: bool, min_n: int, min_events: int) -> DataFrame:
    """The same fits by sums per distinct time: any number of samples."""
    one = kept(ok.groupBy("dataset", "sample_id", "gene").agg(F.max("time").alias("time"), F.max("status").alias("status"), F.max("value").alias("value"))).df
    k = one.groupBy("dataset", "gene").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("status").cast("long")).alias("events"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    flat = ~F.coalesce(F.col("_s") > 1e-12 * F.greatest(F.lit(1.0), F.abs("_m")), F.lit(False))
    why = F.when(F.col("n") < min_n, f"fewer than {min_n} complete samples").when(F.col("events") < min_events, f"fewer than {min_events} events").when(F.col("events") == F.col("n"), "no censored sample").when(flat, "constant marker")
    k = kept(k.withColumn("reason", why)).df
    z = one.join(k.where("reason IS NULL").select("dataset", "gene", "_m", "_s"), ["dataset", "gene"])
    z = z.select("dataset", "gene", "time", "status", ((F.col("value") - F.col("_m")) / F.col("_s") if scale else F.col("value")).alias("value"))
    names = [c.split()[0] for c in FIT_SCHEMA.split(", ")]
    fits = fit_models(z, ["dataset", "gene"], ["value"]).withColumn("reason", F.regexp_replace("reason", "^not estimable: ", "")).select("dataset", "gene", *names)
    null = [F.lit(None).cast("double").alias(c) for c in ("b", "se", "hr", "lower", "upper", "p")]
    return fits.unionByName(k.where("reason IS NOT NULL").select("dataset", "gene", "n", "events", *null, "reason"))


def _screen_matrices(ok: DataFrame, genes: DataFrame, scale: bool, min_n: int, min_events: int) -> DataFrame:
    """Fits of matrices of samples by genes, one a task; genes as ``dealt`` gives them."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot_table(index="sample_id", columns="_g", values="value", aggfunc="max")
        who = g.drop_duplicates("sample_id").set_index("sample_id").loc[wide.index]
        t, s = who["time"].to_numpy(float), who["status"].to_numpy(float)
        x = wide.to_numpy(float)
        n = np.isfinite(x).sum(axis=0)
        events = (np.isfinite(x) * s[:, None]).sum(axis=0)
        with np.errstate(all="ignore"):
            import warnings

            warnings.simplefilter("ignore")
            sd = np.nanstd(x, axis=0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1])
            mean = np.nanmean(x, axis=0) if len(x) else np.zeros(x.shape[1])
        flat = ~(sd > 1e-12 * np.maximum(1, np.abs(mean)))
        z = (x - mean) / np.where(flat, 1, sd) if scale else x
        fit = kernel.fit_many(t, s, z) if len(x) else None
        rows = []
        for j, name in enumerate(wide.columns):
            why = f"fewer than {min_n} complete samples" if n[j] < min_n else f"fewer than {min_events} events" if events[j] < min_events else "no censored sample" if events[j] == n[j] else "constant marker" if flat[j] else kernel.verdict(fit.beta[j], fit.se[j], bool(fit.converged[j]))
            rows.append([g["_d"].iloc[0], name, *_row(fit.beta[j] if fit else 0, fit.se[j] if fit else 0, n[j], events[j], why)])
        return pd.DataFrame(rows, columns=["_d", "_g", *(c.split()[0] for c in FIT_SCHEMA.split(", "))])

    return by_bucket(ok, genes, ["time", "status", "value"], one, FIT_SCHEMA)


def covariate_levels(df: DataFrame, keys: Sequence[str], min_level: int = 5, near: float = 0.95) -> DataFrame:
    """CX7: per covariate level its patients, events and what is wrong with it.

    Rows: keys, variable, level (string), status. Verdict: constant, near-constant (>= 95 % one level), small level, no
    events or all events; null where nothing is.
    """
    by = [*keys, "variable"]
    lev = df.where("level IS NOT NULL").groupBy(*by, "level").agg(F.count(F.lit(1)).alias("n"), F.sum("status").alias("events"))
    w = Window.partitionBy(*by)
    out = lev.withColumn("levels", F.count(F.lit(1)).over(w)).withColumn("total", F.sum("n").over(w)).withColumn("top", F.max("n").over(w))
    why = (
        F.when(F.col("levels") == 1, "constant").when(F.col("top").cast("double") / F.col("total") >= near, "near-constant")
        .when(F.col("n") < min_level, "fewer than 5 patients").when(F.col("events") == 0, "no events").when(F.col("events") == F.col("n"), "all events")
    )
    return out.withColumn("verdict", why)


def merge_levels(df: DataFrame, keys: Sequence[str], min_level: int = 5) -> DataFrame:
    """CX7: levels that the screen faults (size or events) become "Other"; merged tells which rows changed."""
    bad = covariate_levels(df, keys, min_level).where("verdict IN ('fewer than 5 patients', 'no events', 'all events')").select(*keys, "variable", "level", F.lit(True).alias("_bad"))
    return df.join(bad, [*keys, "variable", "level"], "left").withColumn("merged", F.coalesce("_bad", F.lit(False))).withColumn("level", F.when(F.col("merged"), "Other").otherwise(F.col("level"))).drop("_bad")


def cox(df: DataFrame, keys: Sequence[str], cont: Sequence[str], cate: Sequence[str] = (), joint: bool = True, auto_repair: bool = False) -> DataFrame:
    """CX1 (joint=False: one covariate at a time, its own complete rows), CX2 and CX8 (joint, rows complete for all).

    Categorical covariates take their first level in order as reference. A fit with a faulty term is not estimable as a
    whole, with the reason on every row; with ``auto_repair`` the worst covariate leaves until the rest can be estimated,
    and its row says so. A joint model also has parameters, epv (events for each of them) and a warning below 10. A key
    may have any number of rows.
    """
    keys, rows = list(keys), df.where("time >= 0 AND status IN (0, 1)")
    if joint:
        out = fit_models(rows, keys, cont, cate, auto_repair)
        few = F.when(F.col("reason").isNull() & (F.col("epv") < LEAST_EPV), F.lit("fewer than 10 events per variable"))
        return out.withColumn("warning", few)
    rows, parts = kept(rows.select(*keys, "time", "status", *cont, *cate)).df, []
    for names, kind, sort in ((list(cont), "double", True), (list(cate), "string", False)):
        if names:
            each = F.explode(F.array(*(F.struct(F.lit(c).alias("_variable"), F.col(c).cast(kind).alias("_x")) for c in names))).alias("_e")
            one = rows.select(*keys, "time", "status", each).select(*keys, "time", "status", "_e.*")
            fits = fit_models(one, [*keys, "_variable"], ["_x"] if sort else [], [] if sort else ["_x"])
            parts.append(fits.withColumn("variable", F.col("_variable")).select(*keys, *(c.split()[0] for c in COX_SCHEMA.split(", "))))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def screen_adjust(df: DataFrame, keys: Sequence[str], cont: Sequence[str], cate: Sequence[str] = (), threshold: float = 0.05) -> DataFrame:
    """CX5: univariable fits side by side with the joint model of the covariates below the threshold in any level.

    The chosen covariates differ by key; keys with the same choice are fitted together, on the rows complete for it.
    """
    keys, cont, cate = list(keys), list(cont), list(cate)
    df = kept(df.select(*keys, "time", "status", *cont, *cate)).df
    uni = kept(cox(df, keys, cont, cate, joint=False)).df
    order = [*cont, *cate]
    chosen = uni.where(F.col("p") < threshold).groupBy(*keys).agg(F.array_sort(F.collect_set("variable")).alias("_chosen"))
    multi = None
    for pick in [r[0] for r in chosen.select("_chosen").distinct().collect()]:  # at most one for each set of covariates
        mine = df.join(chosen.where(F.col("_chosen") == F.array(*map(F.lit, pick))).select(*keys), keys, "left_semi")
        part = fit_models(mine.where("time >= 0 AND status IN (0, 1)"), keys, [c for c in order if c in pick and c in cont], [c for c in order if c in pick and c in cate])
        multi = part if multi is None else multi.unionByName(part)
    shown = [*keys, "variable", "level"]
    uni = uni.select(*shown, "hr", "p", "reason")
    if multi is None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("hr_joint", "double"), ("p_joint", "double"), ("reason_joint", "string"))]
        return uni.select("*", *none)
    return uni.join(multi.select(*shown, F.col("hr").alias("hr_joint"), F.col("p").alias("p_joint"), F.col("reason").alias("reason_joint")), shown, "left")


def ph(df: DataFrame, keys: Sequence[str], cont: Sequence[str], cate: Sequence[str] = ()) -> DataFrame:
    """CX9: proportional-hazards test per term (term, level) and GLOBAL, with Kaplan-Meier time. A key may have any number of rows."""
    d = Design(df.where("time >= 0 AND status IN (0, 1)"), keys, cont, cate)
    fits = kept(d.fitted()).df
    tests = residual_test(d.rows, fits, d.keys, d.p, d.blocks)
    named = tests.join(fits.select(*d.keys, "terms"), d.keys)
    return named.select(*d.keys, F.when(F.col("j") < 0, "GLOBAL").otherwise(F.get("terms", F.col("j"))["variable"]).alias("term"), F.when(F.col("j") < 0, "").otherwise(F.get("terms", F.col("j"))["level"]).alias("level"), "chisq", "df", "p")


def score_at_zero(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score and information of a univariable Cox model at zero without tie correction (Breslow), by windows alone.

    What one Newton step over any number of rows takes: per distinct time the sums of x and x squared at risk.
    """
    g = df.groupBy(*keys, "time").agg(F.sum("status").cast("double").alias("d"), F.sum(F.col("status") * F.col("value")).alias("xd"), F.count(F.lit(1)).alias("m"), F.sum("value").alias("x"), F.sum(F.col("value") * F.col("value")).alias("xx"))
    w = Window.partitionBy(*keys).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    r = g.select(*keys, "d", "xd", *(F.sum(c).over(w).alias(c.upper()) for c in ("m", "x", "xx")))
    return r.groupBy(*keys).agg(F.sum(F.col("xd") - F.col("d") * F.col("X") / F.col("M")).alias("score"), F.sum(F.col("d") * (F.col("XX") / F.col("M") - (F.col("X") / F.col("M")) ** 2)).alias("info"))
