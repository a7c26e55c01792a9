"""Pooling of estimates over cohorts, multiplicity and forest tables (MT1-MT10)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import stats

#: Interval multiplier.
Z = 1.96


def pool_sums(df: DataFrame, keys: Sequence[str], method: str = "DL") -> DataFrame:
    """MT2 for FE and DL: k, pooled estimate, error, interval, Q, df, I2, tau2. Null or non-positive errors are left out.

    A key has one row per cohort: its estimates are gathered once, and all sums are taken over that short list.
    """
    lists = df.where("b IS NOT NULL AND se > 0").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("b").cast("double").alias("b"), F.col("se").cast("double").alias("se")))).alias("e"))
    total = lambda f: F.aggregate("e", F.lit(0.0), lambda s, x: s + f(x["b"], x["se"]))
    k = F.size("e").cast("long")
    one = lists.withColumn("k", k).withColumns({"sw": total(lambda b, se: 1 / se**2), "sw2": total(lambda b, se: 1 / se**4), "swb": total(lambda b, se: b / se**2)})
    one = one.withColumn("q", F.when(F.col("k") > 1, total(lambda b, se: (b - F.col("swb") / F.col("sw")) ** 2 / se**2)).otherwise(0.0))
    spread = F.col("sw") - F.col("sw2") / F.col("sw")
    tau = F.when((F.col("k") > 1) & (spread > 0), F.greatest(F.lit(0.0), (F.col("q") - F.col("k") + 1) / spread))
    one = one.withColumn("tau2", tau if method == "DL" else F.when(F.col("k") > 1, F.lit(0.0))).withColumn("_t", F.coalesce("tau2", F.lit(0.0)))
    one = one.withColumn("sv", total(lambda b, se: 1 / (se**2 + F.col("_t")))).withColumn("log_hr", total(lambda b, se: b / (se**2 + F.col("_t"))) / F.col("sv")).withColumn("se", F.sqrt(1 / F.col("sv")))
    return one.select(
        *keys, "k", "log_hr", "se", F.exp("log_hr").alias("hr"), F.exp(F.col("log_hr") - Z * F.col("se")).alias("lower"), F.exp(F.col("log_hr") + Z * F.col("se")).alias("upper"),
        "q", (F.col("k") - 1).alias("df"), F.when(F.col("k") > 1, F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("k") + 1) / F.col("q"))).otherwise(0.0)).alias("i2"), "tau2",
    )


def dl_tau2(b: np.ndarray, v: np.ndarray) -> float:
    w = 1 / v
    mu = (w * b).sum() / w.sum()
    c = w.sum() - (w**2).sum() / w.sum()
    return max(0.0, float(((w * (b - mu) ** 2).sum() - len(b) + 1) / c)) if c > 0 else 0.0


def reml_gap(t: float, b: np.ndarray, v: np.ndarray) -> float:
    """Estimating equation of the REML variance; its root is the estimate."""
    w = 1 / (v + t)
    mu = (w * b).sum() / w.sum()
    return float((w**2 * ((b - mu) ** 2 - v)).sum() / (w**2).sum() + 1 / w.sum() - t)


def reml_tau2(b: np.ndarray, v: np.ndarray) -> float:
    if reml_gap(0.0, b, v) <= 0:
        return 0.0
    low, high = 0.0, max(1.0, float(np.var(b)) * 4)
    while reml_gap(high, b, v) > 0:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if reml_gap(mid, b, v) > 0 else (low, mid)
    return (low + high) / 2


POOL_COLUMNS = ("k", "log_hr", "se", "hr", "lower", "upper", "p", "q", "df", "p_het", "i2", "tau2", "pi_lower", "pi_upper", "pi_alt_lower", "pi_alt_upper", "z_stouffer", "p_stouffer")
POOL_SCHEMA = "k int, " + ", ".join(f"{c} double" for c in POOL_COLUMNS[1:])


def pool(b: Sequence[float], se: Sequence[float], method: str = "REML", pi: str = "t", tau2: float | None = None) -> dict[str, float | None]:
    """MT2-MT4 of one set of estimates: FE, DL, REML or HK, with prediction interval and Stouffer's combined z.

    A single estimate passes through, with Q 0 and no tau2, I2 or prediction interval. tau2: where it is known already.
    """
    b, se = np.asarray(b, float), np.asarray(se, float)
    ok = np.isfinite(b) & np.isfinite(se) & (se > 0)
    b, se = b[ok], se[ok]
    k = len(b)
    out: dict = dict.fromkeys(POOL_COLUMNS) | {"k": k}
    if k == 0:
        return out
    v = se**2
    z = b / se
    out["z_stouffer"] = float(z.sum() / math.sqrt(k))
    out["p_stouffer"] = stats.normal_two_sided(out["z_stouffer"])
    if k == 1:
        mu, err, crit, p = b[0], se[0], Z, stats.normal_two_sided(z[0])
        out |= {"q": 0.0, "df": 0.0}
    else:
        w = 1 / v
        fixed = (w * b).sum() / w.sum()
        q = float((w * (b - fixed) ** 2).sum())
        tau2 = 0.0 if method == "FE" else dl_tau2(b, v) if method == "DL" else reml_tau2(b, v) if tau2 is None else tau2
        w = 1 / (v + tau2)
        mu = (w * b).sum() / w.sum()
        plain = err = math.sqrt(1 / w.sum())
        crit, p = Z, stats.normal_two_sided(mu / err)
        if method == "HK":
            num = float((w * (b - mu) ** 2).sum())
            if num > 0:
                err = math.sqrt(num / ((k - 1) * w.sum()))
                crit, p = stats.t_quantile(0.975, k - 1), stats.t_two_sided(mu / err, k - 1)
        out |= {"q": q, "df": float(k - 1), "p_het": stats.chi2_sf(q, k - 1), "i2": max(0.0, (q - k + 1) / q) if q > 0 else 0.0, "tau2": tau2}
        if method != "FE":
            hk = pi == "hk"
            df = k - 1 if hk else k - 2
            mult = stats.normal_quantile(0.975) if pi == "normal" else stats.t_quantile(0.975, df) if df >= 1 else None
            if mult is not None:
                half = mult * math.sqrt(tau2 + err**2)
                out |= {"pi_lower": math.exp(mu - half), "pi_upper": math.exp(mu + half)}
            if method == "HK" and k >= 3:
                half = stats.t_quantile(0.975, k - 2) * math.sqrt(tau2 + plain**2)
                out |= {"pi_alt_lower": math.exp(mu - half), "pi_alt_upper": math.exp(mu + half)}
    return out | {"log_hr": float(mu), "se": float(err), "hr": math.exp(mu), "lower": math.exp(mu - crit * err), "upper": math.exp(mu + crit * err), "p": float(p)}


def reml_many(b: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The root of the REML equation of every row of estimates and variances (NaN: no estimate), by one bisection for all."""
    ok = np.isfinite(b) & np.isfinite(v)
    k = ok.sum(axis=1)
    b, v = np.where(ok, b, 0.0), np.where(ok, v, 1.0)

    def gap(t: np.ndarray) -> np.ndarray:
        w = np.where(ok, 1 / (v + t[:, None]), 0.0)
        mu = (w * b).sum(axis=1) / w.sum(axis=1)
        return (w**2 * ((b - mu[:, None]) ** 2 - v)).sum(axis=1) / (w**2).sum(axis=1) + 1 / w.sum(axis=1) - t

    with np.errstate(all="ignore"):
        mean = b.sum(axis=1) / k
        low, high = np.zeros(len(b)), np.maximum(1.0, 4 * (ok * (b - mean[:, None]) ** 2).sum(axis=1) / k)
        high = np.where((k < 2) | ~(gap(low) > 0), 0.0, high)
        for _ in range(200):
            short = (high > 0) & (gap(high) > 0)
            if not short.any():
                break
            high = np.where(short, 2 * high, high)
        for _ in range(120):
            mid = (low + high) / 2
            up = gap(mid) > 0
            low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def pool_groups(df: DataFrame, keys: Sequence[str], method: str = "REML", pi: str = "t") -> DataFrame:
    """MT2-MT4 for every key; a key has one row per cohort. Estimates of a key are gathered to a list, keys go through in batches."""
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wide = max((len(x) for x in batch["_e"]), default=0)
            cells = np.full((len(batch), wide, 2), np.nan)
            for i, x in enumerate(batch["_e"]):
                for j, e in enumerate(x):
                    if e["b"] is not None and e["se"] is not None and e["se"] > 0:
                        cells[i, j] = e["b"], e["se"]
            tau2 = reml_many(cells[:, :, 0], cells[:, :, 1] ** 2) if method not in ("FE", "DL") and wide else [None] * len(batch)
            got = [pool(c[:, 0], c[:, 1], method, pi, t) for c, t in zip(cells, tau2, strict=True)]
            yield pd.concat([batch[names].reset_index(drop=True), pd.DataFrame([[g[c] for c in POOL_COLUMNS] for g in got], columns=POOL_COLUMNS, dtype=object)], axis=1)

    schema = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names) + ", " + POOL_SCHEMA
    listed = df.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct(F.col("b").cast("double").alias("b"), F.col("se").cast("double").alias("se")))).alias("_e"))
    return listed.mapInPandas(run, schema)


def adjust(df: DataFrame, p: str = "p", method: str = "BH", family: Sequence[str] = ()) -> DataFrame:
    """MT5: adds p_adj over the non-null p-values of each family: BH, BY, bonferroni, holm, hochberg, hommel or none.

    Without a family all rows are one; they are results (one row per test), not data.
    """
    if method == "hommel":
        return _hommel(df, p, list(family))
    some, none = df.where(F.col(p).isNotNull()), df.where(F.col(p).isNull()).withColumn("p_adj", F.lit(None).cast("double"))
    by = list(family) or [F.lit(1)]
    up = Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(p))).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    if method == "BH":
        adj = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down)
    elif method == "BY":
        harmonic = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
        adj = F.min(F.col(p) * F.col("_m") * harmonic / F.col("_r")).over(down)
    elif method == "bonferroni":
        adj = F.col(p) * F.col("_m")
    elif method == "holm":
        adj = F.max(F.col(p) * (F.col("_m") - F.col("_r") + 1)).over(up)
    elif method == "hochberg":
        adj = F.min(F.col(p) * (F.col("_m") - F.col("_r") + 1)).over(down)
    elif method == "none":
        adj = F.col(p)
    else:
        raise ValueError(f"unknown method {method}")
    return ranked.withColumn("p_adj", F.least(F.lit(1.0), adj)).drop("_r", "_m").unionByName(none)


def _hommel(df: DataFrame, p: str, family: list[str]) -> DataFrame:
    """Hommel's method has no closed form over windows: one numpy call per family of tests."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        out = g.assign(p_adj=np.nan)
        ok = g[p].notna().to_numpy()
        if ok.any():
            out.loc[ok, "p_adj"] = stats.hommel(g.loc[ok, p].to_numpy(float))
        return out

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns) + ", p_adj double"
    out = df.groupBy(*family).applyInPandas(one, schema)
    return out.withColumn("p_adj", F.when(~F.isnan("p_adj"), F.col("p_adj")))


def leave_one_out(df: DataFrame, keys: Sequence[str], method: str = "DL") -> DataFrame:
    """MT7: pooled estimate without each cohort in turn. A key has few cohorts, so the pairs within it are few."""
    out = df.select(*keys, F.col("dataset").alias("left_out"))
    rest = df.join(out, list(keys)).where("left_out <> dataset") if keys else df.crossJoin(out).where("left_out <> dataset")
    return pool_sums(rest, [*keys, "left_out"], method)


def concordance(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MT9: cohorts on the side of the pooled estimate, and the sign test of that count."""
    side = df.where("b IS NOT NULL").join(pool_sums(df, keys, "FE").select(*keys, F.signum("log_hr").alias("way")), list(keys))
    got = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum((F.signum("b") == F.col("way")).cast("int")).alias("same"))

    @F.pandas_udf("double")
    def sign_p(same: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([stats.binomial_two_sided(int(a), int(n)) for a, n in zip(same, k, strict=True)])

    return got.withColumn("p_sign", sign_p("same", "k"))


def forest(df: DataFrame, by_block: bool = False) -> DataFrame:
    """MT10: estimable rows sorted by ratio, or covariate blocks by their greatest ratio; a flag where the interval leaves 1."""
    ok = df.where("hr IS NOT NULL AND lower IS NOT NULL AND upper IS NOT NULL").withColumn("significant", (F.col("lower") > 1) | (F.col("upper") < 1))
    top = F.max("hr").over(Window.partitionBy("variable"))
    order = [F.desc("block"), F.asc("variable"), F.desc("hr")] if by_block else [F.desc("hr"), F.asc("variable")]
    return ok.withColumn("block", top).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
