"""Registered queries: survival estimation, pooling, and the gene panel (KM, RC, CX, CR, MT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.jobs import sql_models
from cohortspark.operators import competing, cox, km, meta, roc, two_stage
from cohortspark.sources.adapters import merged, surv, with_views

K = ["dataset", "gene"]


def r6(df, *cols):
    """Round floats, so that sums in another order compare equal."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


def one_gene(spark, d, gene="Brand#11"):
    return merged(spark, d).where(F.col("gene") == gene)


M = "m AS (SELECT s.*, e.gene, e.value FROM surv s JOIN expr e ON e.dataset = s.dataset AND e.sample_id = s.sample_id)"
ONE = M + ", o AS (SELECT * FROM m WHERE gene = 'Brand#11')"


def _split(src, keys="dataset", cut="quantile_cont(value, 0.5)"):
    return f"cuts AS (SELECT {keys}, {cut} AS cut FROM {src} GROUP BY {keys}), g AS (SELECT x.*, cut, CASE WHEN value > cut THEN 1 ELSE 0 END AS high FROM {src} x JOIN cuts USING ({keys}))"


def _logrank(src, keys, strata=""):
    by = f"{keys}{', ' + strata if strata else ''}"
    return f"""
t1 AS (SELECT {by}, time, sum(status)::DOUBLE AS d, sum(status * high)::BIGINT AS d1, count(*) AS m, sum(high) AS m1 FROM {src} GROUP BY {by}, time),
t2 AS (SELECT *, sum(m) OVER (PARTITION BY {by} ORDER BY time DESC)::DOUBLE AS n, sum(m1) OVER (PARTITION BY {by} ORDER BY time DESC)::DOUBLE AS n1 FROM t1),
lr AS (SELECT {keys}, sum(d1)::BIGINT AS obs_high, sum(d * n1 / n) AS exp_high, sum(CASE WHEN n > 1 THEN d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS var_high FROM t2 GROUP BY {keys})"""


_LR = "obs_high, round(exp_high, 6) AS exp_high, round(var_high, 6) AS var_high, CASE WHEN var_high > 0 THEN round((obs_high - exp_high) * (obs_high - exp_high) / var_high, 6) END AS chisq"


def _curve(src, keys):
    return f"""
c1 AS (SELECT {keys}, time, sum(status)::BIGINT AS d, count(*) AS m FROM {src} GROUP BY {keys}, time),
c2 AS (SELECT *, sum(m) OVER (PARTITION BY {keys} ORDER BY time DESC)::BIGINT AS n FROM c1),
c3 AS (SELECT *, max(CASE WHEN d = n THEN 1 ELSE 0 END) OVER w AS gone, sum(CASE WHEN d < n THEN ln(1 - d::DOUBLE / n) ELSE 0 END) OVER w AS ls,
       sum(CASE WHEN d < n THEN d::DOUBLE / (n::DOUBLE * (n - d)) ELSE 0 END) OVER w AS gr FROM c2 WINDOW w AS (PARTITION BY {keys} ORDER BY time)),
curve AS (SELECT {keys}, time, n AS n_risk, d AS n_event, m - d AS n_censor, CASE WHEN gone = 0 THEN exp(ls) ELSE 0.0 END AS surv,
       CASE WHEN gone = 0 THEN exp(ls) * sqrt(gr) END AS se, CASE WHEN gone = 0 THEN exp(ls - {km.Z975} * sqrt(gr)) END AS lower,
       CASE WHEN gone = 0 THEN least(1.0, exp(ls + {km.Z975} * sqrt(gr))) END AS upper FROM c3)"""


def _at(keys, times):
    return f"""
ca AS (SELECT c.*, a.horizon FROM curve c CROSS JOIN (SELECT unnest([{", ".join(f"{t:.1f}::DOUBLE" for t in times)}]) AS horizon) a),
cb AS (SELECT {keys}, horizon, max(time) AS last, arg_max(surv, time) FILTER (WHERE time <= horizon) AS s, arg_max(se, time) FILTER (WHERE time <= horizon) AS e,
        max(CASE WHEN time <= horizon THEN 1 ELSE 0 END) AS any_hit, sum(CASE WHEN time >= horizon THEN n_event + n_censor ELSE 0 END)::BIGINT AS n_risk FROM ca GROUP BY {keys}, horizon),
steps AS (SELECT {keys}, horizon, CASE WHEN any_hit = 1 THEN s ELSE 1.0 END AS surv, CASE WHEN any_hit = 1 THEN e ELSE 0.0 END AS se, n_risk FROM cb WHERE horizon <= last)"""


def _pool(src, keys, dl=True):
    part = f"PARTITION BY {keys}"
    tau = "CASE WHEN k > 1 AND sw - sw2 / sw > 0 THEN greatest(0.0, (q - k + 1) / (sw - sw2 / sw)) END" if dl else "CASE WHEN k > 1 THEN 0.0::DOUBLE END"
    return f"""
p1 AS (SELECT *, 1 / (se * se) AS w FROM {src} WHERE b IS NOT NULL AND se > 0),
p2 AS (SELECT *, sum(w * b) OVER ({part}) / sum(w) OVER ({part}) AS mu FROM p1),
p3 AS (SELECT {keys}, count(*) AS k, sum(w) AS sw, sum(w * w) AS sw2, CASE WHEN count(*) > 1 THEN sum(w * (b - mu) * (b - mu)) ELSE 0.0 END AS q FROM p2 GROUP BY {keys}),
p4 AS (SELECT *, {tau} AS tau2 FROM p3),
p5 AS (SELECT {keys}, sum(b / (se * se + coalesce(tau2, 0.0))) / sum(1 / (se * se + coalesce(tau2, 0.0))) AS log_hr, sqrt(1 / sum(1 / (se * se + coalesce(tau2, 0.0)))) AS pse
       FROM p1 JOIN p4 USING ({keys}) GROUP BY {keys}),
pooled AS (SELECT p4.*, log_hr, pse, exp(log_hr) AS hr, exp(log_hr - 1.96 * pse) AS lower, exp(log_hr + 1.96 * pse) AS upper, k - 1 AS df,
       CASE WHEN k > 1 THEN CASE WHEN q > 0 THEN greatest(0.0, (q - k + 1) / q) ELSE 0.0 END END AS i2 FROM p4 JOIN p5 USING ({keys}))"""


_POOL_OUT = "k, round(log_hr, 6) AS log_hr, round(pse, 6) AS se, round(hr, 6) AS hr, round(lower, 6) AS lower, round(upper, 6) AS upper, round(q, 6) AS q, df, round(i2, 6) AS i2, round(tau2, 6) AS tau2"
_POOL_ROUND = ("log_hr", "se", "hr", "lower", "upper", "q", "i2", "tau2")


#: Two-sided normal p-value of z: one minus Simpson's rule over the density, 400 intervals.
_P2 = "CASE WHEN abs({z}) > 9 THEN 0.0 ELSE 1 - sqrt(2 / pi()) * abs({z}) / 1200 * list_sum(list_transform(range(0, 401), lambda i: CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * power(abs({z}) * i / 400, 2)))) END"


def _fits(src, keys="dataset, gene", steps=8, scale=True, x="value"):
    """Univariable Cox fits (Efron ties) of a CTE as ``fits``: Newton steps one after another, on standardised values."""
    by = f"PARTITION BY {keys}"
    out = f"""
f0 AS (SELECT {keys}, time, status, {x}::DOUBLE AS v FROM {src} WHERE {x} IS NOT NULL AND time >= 0 AND status IN (0, 1)),
f1 AS (SELECT {keys}, count(*) AS n, sum(status)::BIGINT AS events, avg(v) AS mean, stddev_samp(v) AS sd FROM f0 GROUP BY {keys}),
f2 AS (SELECT *, CASE WHEN n < 10 THEN 'fewer than 10 complete samples' WHEN events < 5 THEN 'fewer than 5 events' WHEN events = n THEN 'no censored sample' WHEN NOT (sd > 1e-12 * greatest(1, abs(mean))) THEN 'constant marker' END AS reason FROM f1),
f3 AS (SELECT {keys}, time, status, (v - mean) / sd AS z FROM f0 JOIN f2 USING ({keys}) WHERE reason IS NULL),
b0 AS (SELECT {keys}, 0.0::DOUBLE AS b, NULL::DOUBLE AS info FROM f3 GROUP BY {keys})"""
    for k in range(steps):
        out += f""",
s{k} AS (SELECT {keys}, time, sum(status)::BIGINT AS d, sum(status * z) AS sz, sum(exp(b * z)) AS r0, sum(z * exp(b * z)) AS r1, sum(z * z * exp(b * z)) AS r2, sum(status * exp(b * z)) AS t0, sum(status * z * exp(b * z)) AS t1, sum(status * z * z * exp(b * z)) AS t2 FROM f3 JOIN b{k} USING ({keys}) GROUP BY {keys}, time),
w{k} AS (SELECT {keys}, d, sz, t0, t1, t2, sum(r0) OVER w AS s0, sum(r1) OVER w AS s1, sum(r2) OVER w AS s2 FROM s{k} WINDOW w AS ({by} ORDER BY time DESC)),
e{k} AS (SELECT {keys}, sz / d AS own, s0 - l / d::DOUBLE * t0 AS a0, s1 - l / d::DOUBLE * t1 AS a1, s2 - l / d::DOUBLE * t2 AS a2 FROM (SELECT *, unnest(range(d)) AS l FROM w{k} WHERE d > 0) x),
u{k} AS (SELECT {keys}, sum(own - a1 / a0) AS u, sum(a2 / a0 - (a1 / a0) * (a1 / a0)) AS i FROM e{k} GROUP BY {keys}),
b{k + 1} AS (SELECT {keys}, b + u / i AS b, i AS info FROM b{k} JOIN u{k} USING ({keys}))"""
    unit = "" if scale else " / sd"
    return out + f""",
f4 AS (SELECT {keys}, n, events, b{unit} AS b, 1 / sqrt(info){unit} AS se, reason FROM f2 LEFT JOIN b{steps} USING ({keys})),
fits AS (SELECT {keys}, n, events, round(b, 6) AS b, round(se, 6) AS se, round(exp(b), 6) AS hr, round(exp(b - 1.96 * se), 6) AS lower, round(exp(b + 1.96 * se), 6) AS upper, round({_P2.format(z='(b / se)')}, 6) AS p, reason, b AS b_full, se AS se_full FROM f4)"""


_FIT = ("b", "se", "hr", "lower", "upper", "p")


def _two_fits(src, x, y, steps=9, nested=False):
    """Cox model of two covariates per dataset (Efron ties), on standardised values, one row per covariate."""
    by = "PARTITION BY dataset"
    terms = {"0": "1", "x": "x", "y": "y", "xx": "x * x", "xy": "x * y", "yy": "y * y"}
    out = f"""{'WITH ' * nested}
g0 AS (SELECT dataset, time, status, {x} AS v, {y} AS u FROM {src}), g1 AS (SELECT dataset, count(*) AS n, sum(status)::BIGINT AS events, avg(v) AS mv, stddev_samp(v) AS sv, avg(u) AS mu, stddev_samp(u) AS su FROM g0 GROUP BY dataset),
g2 AS (SELECT dataset, time, status, (v - mv) / sv AS x, (u - mu) / su AS y FROM g0 JOIN g1 USING (dataset)), b0 AS (SELECT dataset, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q, NULL::DOUBLE AS vp, NULL::DOUBLE AS vq FROM g1)"""
    for k in range(steps):
        r, t = (", ".join(f"sum({w}{e} * exp(p * x + q * y)) AS {c}{i}" for i, e in terms.items()) for c, w in (("r", ""), ("t", "status * ")))
        over = ", ".join(f"t{i}, sum(r{i}) OVER w AS s{i}" for i in terms)
        at = ", ".join(f"s{i} - l / d::DOUBLE * t{i} AS a{i}" for i in terms)
        out += f""",
h{k} AS (SELECT dataset, time, sum(status)::BIGINT AS d, sum(status * x) AS ex, sum(status * y) AS ey, {r}, {t} FROM g2 JOIN b{k} USING (dataset) GROUP BY dataset, time), i{k} AS (SELECT dataset, d, ex, ey, {over} FROM h{k} WINDOW w AS ({by} ORDER BY time DESC)),
j{k} AS (SELECT dataset, ex / d AS ox, ey / d AS oy, {at} FROM (SELECT *, unnest(range(d)) AS l FROM i{k} WHERE d > 0) z),
k{k} AS (SELECT dataset, sum(ox - ax / a0) AS ux, sum(oy - ay / a0) AS uy, sum(axx / a0 - power(ax / a0, 2)) AS ixx, sum(axy / a0 - ax * ay / a0 / a0) AS ixy, sum(ayy / a0 - power(ay / a0, 2)) AS iyy FROM j{k} GROUP BY dataset),
b{k + 1} AS (SELECT dataset, p + (iyy * ux - ixy * uy) / (ixx * iyy - ixy * ixy) AS p, q + (ixx * uy - ixy * ux) / (ixx * iyy - ixy * ixy) AS q, iyy / (ixx * iyy - ixy * ixy) AS vp, ixx / (ixx * iyy - ixy * ixy) AS vq FROM b{k} JOIN k{k} USING (dataset))"""
    return out + f""",
z AS (SELECT dataset, unnest(['value', 'balance']) AS variable, n, events, unnest([p / sv, q / su]) AS b, unnest([sqrt(vp) / sv, sqrt(vq) / su]) AS se FROM b{steps} JOIN g1 USING (dataset))
SELECT dataset, variable, '' AS level, n, events, round(b, 6) AS b, round(se, 6) AS se, round(exp(b), 6) AS hr, round(exp(b - 1.96 * se), 6) AS lower, round(exp(b + 1.96 * se), 6) AS upper, round({_P2.format(z='(b / se)')}, 6) AS p, CAST(NULL AS VARCHAR) AS reason FROM z"""


def _remls(src):
    """``remls``: the root of the REML equation per gene of estimates (b, se), by bisection over lists of a gene's estimates."""
    gap = lambda t: f"list_sum(list_transform(range(1, k + 1), lambda i: (power(bs[i] - list_sum(list_transform(range(1, k + 1), lambda j: bs[j] / (vs[j] + {t}))) / list_sum(list_transform(vs, lambda v: 1 / (v + {t}))), 2) - vs[i]) / power(vs[i] + {t}, 2))) / list_sum(list_transform(vs, lambda v: 1 / power(v + {t}, 2))) + 1 / list_sum(list_transform(vs, lambda v: 1 / (v + {t}))) - {t}"
    return f"""
q0 AS (SELECT gene, count(*)::BIGINT AS k, list(b ORDER BY dataset) AS bs, list(se * se ORDER BY dataset) AS vs, greatest(1, 4 * var_pop(b)) AS top FROM {src} WHERE b IS NOT NULL AND se > 0 GROUP BY gene),
q1(gene, k, bs, vs, low, high, step) AS (SELECT gene, k, bs, vs, 0.0::DOUBLE, CASE WHEN k < 2 OR {gap('0.0')} <= 0 THEN 0.0 ELSE top END::DOUBLE, 0 FROM q0
  UNION ALL SELECT gene, k, bs, vs, CASE WHEN {gap('((low + high) / 2)')} > 0 THEN (low + high) / 2 ELSE low END, CASE WHEN {gap('((low + high) / 2)')} > 0 THEN high ELSE (low + high) / 2 END, step + 1 FROM q1 WHERE step < 60),
remls AS (SELECT gene, k, (low + high) / 2 AS tau2 FROM q1 WHERE step = 60)"""


#: Two-sided p-value of t, and quantile at 0.975, for the degrees of freedom of five cohorts (4 and 3).
_T4 = "(1 - abs({t}) / sqrt(4 + {t} * {t}) * (1 + 2 / (4 + {t} * {t})))"
_Q4, _Q3 = "2.7764451051977987", "3.182446305284263"


def _meta(src, hk=False):
    """``pools``: REML pooling per gene over five cohorts, all columns of the pooled table."""
    half = f"{_Q4} * sqrt(tau2 + err * err)" if hk else f"{_Q3} * sqrt(tau2 + err * err)"
    err = "sqrt(num / ((k - 1) * swr))" if hk else "1 / sqrt(swr)"
    crit, p = (_Q4, _T4.format(t="(mu / err)")) if hk else ("1.96", _P2.format(z="(mu / err)"))
    alt = [f"round(exp(mu {o} {_Q3} * sqrt(tau2 + 1 / swr)), 6)" if hk else "NULL::DOUBLE" for o in "-+"]
    return f"""{_remls(src)},
m1 AS (SELECT e.gene, r.k, tau2, sum(1 / (se * se)) AS sw, sum(b / (se * se)) AS swb, sum(1 / (se * se + tau2)) AS swr, sum(b / (se * se + tau2)) AS swrb, sum(b / se) AS zsum FROM {src} e JOIN remls r USING (gene) WHERE b IS NOT NULL AND se > 0 GROUP BY ALL),
m2 AS (SELECT m1.*, zsum / sqrt(k) AS zs, swrb / swr AS mu, q, num FROM m1 JOIN (SELECT e.gene, sum(power(b - swb / sw, 2) / (se * se)) AS q, sum(power(b - swrb / swr, 2) / (se * se + tau2)) AS num FROM {src} e JOIN m1 USING (gene) WHERE b IS NOT NULL AND se > 0 GROUP BY e.gene) y USING (gene)),
m3 AS (SELECT *, {err} AS err FROM m2),
pools AS (SELECT gene, k, round(mu, 6) AS log_hr, round(err, 6) AS se, round(exp(mu), 6) AS hr, round(exp(mu - {crit} * err), 6) AS lower, round(exp(mu + {crit} * err), 6) AS upper, round({p}, 6) AS p, round(q, 6) AS q, (k - 1)::DOUBLE AS df,
  round(exp(-q / 2) * (1 + q / 2), 6) AS p_het, round(CASE WHEN q > 0 THEN greatest(0.0, (q - k + 1) / q) ELSE 0.0 END, 6) AS i2, round(tau2, 6) AS tau2, round(exp(mu - {half}), 6) AS pi_lower, round(exp(mu + {half}), 6) AS pi_upper, {alt[0]} AS pi_alt_lower, {alt[1]} AS pi_alt_upper,
  round(zs, 6) AS z_stouffer, round({_P2.format(z='zs')}, 6) AS p_stouffer, {p} AS p_full FROM m3)"""


_META = "gene, k, log_hr, se, hr, lower, upper, p, q, df, p_het, i2, tau2, pi_lower, pi_upper, pi_alt_lower, pi_alt_upper, z_stouffer, p_stouffer"
_META_ROUND = [c for c in meta.POOL_COLUMNS if c not in ("k", "df")]


def _scaled(s, d):
    return one_gene(s, d).withColumn("value", F.col("value") / F.lit(10000.0)).withColumn("balance", F.col("balance") / F.lit(1000.0))


def peto(spark, d):
    """One-step estimates per gene and cohort from the median split: (O-E)/V and 1/sqrt(V)."""
    lr = km.logrank(km.split(merged(spark, d), K), K, p=False).where("var_high > 0")
    return lr.select(*K, ((F.col("obs_high") - F.col("exp_high")) / F.col("var_high")).alias("b"), (1 / F.sqrt("var_high")).alias("se"))


PETO = f"{M}, {_split('m', 'dataset, gene')}, {_logrank('g', 'dataset, gene')}, est AS (SELECT dataset, gene, (obs_high - exp_high) / var_high AS b, 1 / sqrt(var_high) AS se FROM lr WHERE var_high > 0)"

Q: dict = {}


def _q(name, fn, sql=None):
    Q[name] = (fn, with_views(sql) if sql else None)


def _km1(spark, d, rule, **how):
    out = km.split(one_gene(spark, d), ["dataset"], rule, **how).select("dataset", "sample_id", "value", "cut", "high")
    return r6(out, "cut")


for _rule, _how, _cut in (("median", {}, "quantile_cont(value, 0.5)"), ("mean", {}, "avg(value)"), ("top", {"top_pct": 30}, "quantile_cont(value, 0.7)"), ("value", {"value": 30000}, "30000.0::DOUBLE")):
    _q(f"km1_split_{_rule}", lambda s, d, r=_rule, h=_how: _km1(s, d, r, **h), f"WITH {ONE}, {_split('o', cut=_cut)} SELECT dataset, sample_id, value, round(cut, 6) AS cut, high FROM g")
_q("km2_curve", lambda s, d: r6(km.curve(km.split(one_gene(s, d), ["dataset"]), ["dataset", "high"]), "time", "surv", "se", "lower", "upper"),
   f"WITH {ONE}, {_split('o')}, {_curve('g', 'dataset, high')} SELECT dataset, high, round(time, 6) AS time, n_risk, n_event, n_censor, round(surv, 6) AS surv, round(se, 6) AS se, round(lower, 6) AS lower, round(upper, 6) AS upper FROM curve")
_q("km3_survival_at", lambda s, d: r6(km.surv_at(km.curve(km.split(one_gene(s, d), ["dataset"]), ["dataset", "high"]), ["dataset", "high"], [1, 3, 5]), "surv", "se"),
   f"WITH {ONE}, {_split('o')}, {_curve('g', 'dataset, high')}, {_at('dataset, high', (1, 3, 5))} SELECT dataset, high, horizon, round(surv, 6) AS surv, round(se, 6) AS se, n_risk FROM steps")
_q("km4_logrank", lambda s, d: r6(km.logrank(km.split(one_gene(s, d), ["dataset"]), ["dataset"], p=False), "exp_high", "var_high", "chisq"), f"WITH {ONE}, {_split('o')}, {_logrank('g', 'dataset')} SELECT dataset, {_LR} FROM lr")
_q("km5_stratified", lambda s, d: r6(km.logrank(km.split(merged(s, d), K), ["gene"], ["dataset"], p=False), "exp_high", "var_high", "chisq"),
   f"WITH {M}, {_split('m', 'dataset, gene')}, {_logrank('g', 'gene', 'dataset')} SELECT gene, {_LR} FROM lr")
_q("km6_summary", lambda s, d: r6(km.group_summary(km.split(one_gene(s, d), ["dataset"]), ["dataset"]), "median_follow_up"),
   f"WITH {ONE}, {_split('o')} SELECT dataset, count(*) AS n, sum(high)::BIGINT AS n_high, sum(1 - high)::BIGINT AS n_low, sum(status)::BIGINT AS events, sum(status * high)::BIGINT AS events_high, round(quantile_cont(time, 0.5), 6) AS median_follow_up, (sum(high) < 5 OR sum(1 - high) < 5) AS small_group, sum(status) < 10 AS few_events FROM g GROUP BY dataset")
_q("km7_many_genes", lambda s, d: r6(km.logrank(km.split(merged(s, d), K), K, p=False), "exp_high", "var_high", "chisq"), f"WITH {M}, {_split('m', 'dataset, gene')}, {_logrank('g', 'dataset, gene')} SELECT dataset, gene, {_LR} FROM lr")


def _km8(s, d):
    out = km.best_cut(one_gene(s, d), ["dataset"], p=False)
    return r6(out.select("dataset", F.col("cand").cast("long").alias("cand"), "cut", "chisq", "candidates", "n_high", "n_low"), "cut", "chisq")


_q("km8_best_cut", _km8, f"""WITH {ONE}, q AS (SELECT dataset, quantile_cont(value, [{", ".join(map(str, km.CANDIDATES))}]) AS cuts, count(*) AS n_all FROM o GROUP BY dataset HAVING count(*) >= 20),
qc AS (SELECT dataset, unnest(range(13)) AS cand, unnest(cuts) AS cut FROM q), g AS (SELECT o.*, cand, cut, CASE WHEN value > cut THEN 1 ELSE 0 END AS high FROM o JOIN qc USING (dataset)),
z AS (SELECT dataset, cand, sum(high)::BIGINT AS n_high, sum(1 - high)::BIGINT AS n_low FROM g GROUP BY dataset, cand HAVING sum(high) >= 5 AND sum(1 - high) >= 5), {_logrank('g', 'dataset, cand, cut')},
r AS (SELECT dataset, cand, cut, (obs_high - exp_high) * (obs_high - exp_high) / var_high AS chisq, n_high, n_low FROM lr JOIN z USING (dataset, cand) WHERE var_high > 0),
f AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS candidates, row_number() OVER (PARTITION BY dataset ORDER BY round(chisq, 9) DESC, cand) AS rn FROM r)
SELECT dataset, cand, round(cut, 6) AS cut, round(chisq, 6) AS chisq, candidates, n_high, n_low FROM f WHERE rn = 1""")
_DENSITY = "exp(-max_stat * max_stat / 2) / sqrt(2 * pi())"
_q("km9_adjusted_p", lambda s, d: r6(km.adjusted_cut_p(merged(s, d), K), "max_stat", "p_adjusted"), f"""WITH {M}, q AS (SELECT dataset, gene, quantile_cont(value, [0.1, 0.9]) AS qs FROM m GROUP BY ALL), ct AS (SELECT DISTINCT dataset, gene, value AS cut FROM m JOIN q USING (dataset, gene) WHERE value BETWEEN qs[1] AND qs[2]),
g AS (SELECT dataset, gene, cut, time, status, CASE WHEN value > cut THEN 1 ELSE 0 END AS high FROM m JOIN ct USING (dataset, gene)), {_logrank('g', 'dataset, gene, cut')}, st AS (SELECT dataset, gene, count(*) AS cuts, coalesce(max(CASE WHEN var_high > 0 THEN abs(obs_high - exp_high) / sqrt(var_high) END), 0) AS max_stat FROM lr GROUP BY dataset, gene)
SELECT dataset, gene, cuts, round(max_stat, 6) AS max_stat, round(CASE WHEN max_stat < 1e-9 THEN 1 ELSE least(1, greatest(0, {_DENSITY} * (max_stat - 1 / max_stat) * ln(0.9 * 0.9 / (0.1 * 0.1)) + 4 * {_DENSITY} / max_stat)) END, 6) AS p_adjusted FROM st""")
_q("km10_pooled_ledger", lambda s, d: km.pool_ledger(km.split(one_gene(s, d), ["dataset"])),
   f"WITH {ONE}, {_split('o')} SELECT dataset, count(*) AS n, count(DISTINCT value) AS \"values\", sum(high)::BIGINT AS n_high, CASE WHEN count(*) < 10 THEN 'fewer than 10 complete rows' WHEN count(DISTINCT value) < 2 THEN 'a single marker value' WHEN sum(high) = 0 OR sum(high) = count(*) THEN 'one-sided split' END AS reason FROM g GROUP BY dataset")
_q("km10_pooled_curve", lambda s, d: r6(km.pooled_ipd(km.split(one_gene(s, d), ["dataset"]))[1], "time", "surv", "se", "lower", "upper"),
   f"WITH {ONE}, {_split('o')}, {_curve('g', 'high')} SELECT high, round(time, 6) AS time, n_risk, n_event, n_censor, round(surv, 6) AS surv, round(se, 6) AS se, round(lower, 6) AS lower, round(upper, 6) AS upper FROM curve")
_q("km11_landmark", lambda s, d: r6(meta.pool_sums(km.landmark_estimates(km.split(one_gene(s, d), ["dataset"]), [1, 3]), ["high", "horizon"]).withColumn("surv", F.exp(-F.exp("log_hr"))), *_POOL_ROUND, "surv"),
   f"WITH {ONE}, {_split('o')}, {_curve('g', 'dataset, high')}, {_at('dataset, high', (1, 3))}, est AS (SELECT dataset, high, horizon, ln(-ln(surv)) AS b, se / (surv * abs(ln(surv))) AS se FROM steps WHERE surv > 0 AND surv < 1 AND se > 0), {_pool('est', 'high, horizon')} SELECT high, horizon, {_POOL_OUT}, round(exp(-exp(log_hr)), 6) AS surv FROM pooled")
_q("rc1_counts", lambda s, d: roc.counts_at(merged(s, d), K, 2.0),
   f"WITH {M} SELECT dataset, gene, count(*) AS n, sum(CASE WHEN time <= 2 AND status = 1 THEN 1 ELSE 0 END)::BIGINT AS cases, sum(CASE WHEN time > 2 THEN 1 ELSE 0 END)::BIGINT AS controls, sum(CASE WHEN time <= 2 AND status = 0 THEN 1 ELSE 0 END)::BIGINT AS censored, CASE WHEN max(time) < 2 THEN 'horizon beyond follow-up' WHEN sum(CASE WHEN time <= 2 AND status = 1 THEN 1 ELSE 0 END) = 0 THEN 'no case' WHEN sum(CASE WHEN time > 2 THEN 1 ELSE 0 END) = 0 THEN 'no control' END AS refusal FROM m GROUP BY dataset, gene")


def _km_to(src, keys, name, h=2.0):
    """``name``: Kaplan-Meier survival at the horizon of the rows of each key."""
    return f"""{name}1 AS (SELECT {keys}, time, sum(status) AS d, count(*) AS m FROM {src} GROUP BY {keys}, time), {name}2 AS (SELECT *, sum(m) OVER (PARTITION BY {keys} ORDER BY time DESC)::DOUBLE AS n FROM {name}1),
{name} AS (SELECT {keys}, CASE WHEN count(CASE WHEN time <= {h} AND d = n THEN 1 END) > 0 THEN 0.0 ELSE exp(coalesce(sum(CASE WHEN time <= {h} AND d < n THEN ln(1 - d / n) END), 0)) END AS s FROM {name}2 GROUP BY {keys})"""


def _area(points, keys):
    """Area under (f, t) points of ``cut`` from the greatest down, with (0, 0) before and (1, 1) after them."""
    return f"""pt AS (SELECT {keys}, f, t, row_number() OVER (PARTITION BY {keys} ORDER BY cut DESC) AS r FROM {points} UNION ALL SELECT DISTINCT {keys}, 0.0, 0.0, 0 FROM {points} UNION ALL SELECT DISTINCT {keys}, 1.0, 1.0, 1000000000 FROM {points}),
ar AS (SELECT {keys}, (t + lag(t) OVER w) / 2 * (f - lag(f) OVER w) AS a FROM pt WINDOW w AS (PARTITION BY {keys} ORDER BY r)) SELECT {keys}, count(*) AS points, round(sum(a), 6) AS auc FROM ar GROUP BY {keys}"""


def _auc_km(src, keys):
    on = " AND ".join(f"x.{k} = c.{k}" for k in keys.split(", "))
    return f"""uk AS (SELECT {keys} FROM {src} GROUP BY {keys} HAVING max(time) >= 2 AND count(CASE WHEN time <= 2 AND status = 1 THEN 1 END) > 0 AND count(CASE WHEN time > 2 THEN 1 END) > 0), us AS (SELECT * FROM {src} JOIN uk USING ({keys})),
ct AS (SELECT DISTINCT {keys}, value AS cut FROM us), ab AS (SELECT c.*, x.time, x.status FROM ct c JOIN us x ON {on} AND x.value > c.cut), {_km_to('ab', keys + ', cut', 'sc')}, {_km_to('us', keys, 'sa')},
nn AS (SELECT {keys}, count(*)::DOUBLE AS n FROM us GROUP BY {keys}), sh AS (SELECT {keys}, cut, count(*) AS above FROM ab GROUP BY {keys}, cut),
po AS (SELECT ct.*, coalesce(sc.s, 1) * coalesce(above, 0) / n / sa.s AS f, (1 - coalesce(sc.s, 1)) * coalesce(above, 0) / n / (1 - sa.s) AS t FROM ct JOIN nn USING ({keys}) JOIN sa USING ({keys}) LEFT JOIN sh USING ({keys}, cut) LEFT JOIN sc USING ({keys}, cut)), {_area('po', keys)}"""


def _nne(src, keys):
    same = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys.split(", "))
    of = lambda x: ", ".join(f"{x}.{k}" for k in keys.split(", "))
    return f"""us AS MATERIALIZED (SELECT {keys}, time, status, value, (rank() OVER w - 1) / count(*) OVER (PARTITION BY {keys})::DOUBLE AS place, count(*) OVER (PARTITION BY {keys})::DOUBLE AS n FROM {src} JOIN (SELECT {keys} FROM {src} GROUP BY {keys} HAVING max(time) >= 2 AND count(CASE WHEN time <= 2 AND status = 1 THEN 1 END) > 0 AND count(CASE WHEN time > 2 THEN 1 END) > 0) USING ({keys}) WINDOW w AS (PARTITION BY {keys} ORDER BY value)),
vs AS (SELECT DISTINCT {keys}, value AS cut, place, n FROM us), nb AS (SELECT {of('v')}, v.cut, x.time, x.status FROM vs v JOIN us x ON {same('x', 'v')} AND abs(x.place - v.place) < 0.25 * power(v.n, -0.2)), {_km_to('nb', keys + ', cut', 'sm')},
si AS (SELECT {of('us')}, us.value, us.n, s FROM us JOIN sm ON {same('sm', 'us')} AND sm.cut = us.value), tt AS (SELECT {keys}, avg(s) AS total FROM si GROUP BY {keys}),
jo AS (SELECT {of('v')}, v.cut, v.n, coalesce(sum(x.s), 0) / v.n AS joint, count(x.s) / v.n AS above FROM vs v LEFT JOIN si x ON {same('x', 'v')} AND x.value > v.cut GROUP BY {of('v')}, v.cut, v.n), po AS (SELECT {keys}, cut, joint / total AS f, (above - joint) / (1 - total) AS t FROM jo JOIN tt USING ({keys})), {_area('po', keys)}"""


_q("rc1_auc_km", lambda s, d: r6(roc.auc(one_gene(s, d), ["dataset"], 2.0), "auc"), f"WITH {ONE}, {_auc_km('o', 'dataset')}")
_q("rc2_auc_nne", lambda s, d: r6(roc.auc(one_gene(s, d), ["dataset"], 2.0, "NNE"), "auc"), f"WITH {ONE}, {_nne('o', 'dataset')}")
_q("rc2_many_genes", lambda s, d: r6(roc.auc(merged(s, d), K, 2.0, "NNE"), "auc"), f"WITH {M}, {_nne('m', 'dataset, gene')}")
_q("rc3_many_genes", lambda s, d: r6(roc.auc(merged(s, d), K, 2.0), "auc"), f"WITH {M}, {_auc_km('m', 'dataset, gene')}")
_ROUNDED = f"round(b, 6) AS b, round(se, 6) AS se, round(exp(b), 6) AS hr, round(exp(b - 1.96 * se), 6) AS lower, round(exp(b + 1.96 * se), 6) AS upper, round({_P2.format(z='(b / se)')}, 6) AS p"
#: Two numbers and a category of four levels, which all cohorts of the tables have; the first level is the reference.
_COLUMNS = [("value", ""), ("balance", ""), *(("nation", f"N{k}") for k in (1, 2, 3))]
_COVARIATES = f"oc AS MATERIALIZED (SELECT dataset, time, status, value / 10000.0::DOUBLE AS value, balance / 1000.0::DOUBLE AS balance, 'N' || (nation % 4) AS nation FROM o WHERE time >= 0)"
_DUMMIES = [f"(nation = '{lv}')::INT::DOUBLE" if lv else v for v, lv in _COLUMNS]


def _covariates(s, d):
    return _scaled(s, d).withColumn("nation", F.concat(F.lit("N"), F.col("nation") % 4))


_NATION = f"{sql_models.newton('oc', 'dataset', _DUMMIES[2:])}, {sql_models.terms('dataset', _COLUMNS[2:])}"
_UNI = f"""oz AS (SELECT dataset, unnest(['value', 'balance']) AS variable, time, status, unnest([value, balance]) AS value FROM oc), {_fits('oz', 'dataset, variable', scale=False)}, {_NATION},
uni AS (SELECT dataset, variable, '' AS level, * EXCLUDE (dataset, variable, b_full, se_full) FROM fits UNION ALL SELECT dataset, variable, level, n, events, {_ROUNDED}, NULL FROM qfit)"""
_q("cx1_univariable", lambda s, d: r6(cox.cox(_covariates(s, d), ["dataset"], ["value", "balance"], ["nation"], joint=False), *_FIT), f"WITH {ONE}, {_COVARIATES}, {_UNI} SELECT * FROM uni")
_q("cx1_continuous", lambda s, d: r6(cox.cox(_scaled(s, d), ["dataset"], ["value", "balance"], joint=False), *_FIT),
   f"WITH {ONE}, o2 AS (SELECT dataset, unnest(['value', 'balance']) AS variable, time, status, unnest([value / 10000.0::DOUBLE, balance / 1000.0::DOUBLE]) AS value FROM o), {_fits('o2', 'dataset, variable', scale=False)} SELECT dataset, variable, '' AS level, * EXCLUDE (dataset, variable, b_full, se_full) FROM fits")
_EPV = "CASE WHEN events / {p}::DOUBLE < 10 THEN 'fewer than 10 events per variable' END AS warning"
_q("cx2_two_covariates", lambda s, d: r6(cox.cox(_scaled(s, d), ["dataset"], ["value", "balance"]), *_FIT, "epv"), f"WITH {ONE}, two AS ({_two_fits('o', 'value / 10000.0::DOUBLE', 'balance / 1000.0::DOUBLE', nested=True)}) SELECT *, 2 AS parameters, round(events / 2.0::DOUBLE, 6) AS epv, {_EPV.format(p=2)} FROM two")
_q("cx2_multivariable", lambda s, d: r6(cox.cox(_covariates(s, d), ["dataset"], ["value", "balance"], ["nation"]), *_FIT, "epv"),
   f"WITH {ONE}, {_COVARIATES}, {sql_models.newton('oc', 'dataset', _DUMMIES)}, {sql_models.terms('dataset', _COLUMNS)} SELECT dataset, variable, level, n, events, {_ROUNDED}, CAST(NULL AS VARCHAR) AS reason, 5 AS parameters, round(events / 5.0::DOUBLE, 6) AS epv, {_EPV.format(p=5)} FROM qfit")
_JOINT = "jn AS (SELECT dataset, sample_id, count(DISTINCT gene) AS have FROM {m} WHERE value IS NOT NULL GROUP BY ALL), jl AS (SELECT dataset, count(DISTINCT gene) AS listed FROM {m} GROUP BY dataset), jk AS (SELECT dataset, sample_id FROM jn JOIN jl USING (dataset) WHERE have = listed), j AS (SELECT {m}.* FROM {m} JOIN jk USING (dataset, sample_id)), ja AS (SELECT DISTINCT dataset, gene FROM {m})"
_BH = "p_adj AS (SELECT dataset, gene, least(1.0, min(p_full * mm / r) OVER (PARTITION BY {part} ORDER BY r DESC)) AS p_adj FROM (SELECT dataset, gene, {p} AS p_full, row_number() OVER (PARTITION BY {part} ORDER BY {p}) AS r, count(*) OVER (PARTITION BY {part}) AS mm FROM fits WHERE reason IS NULL) x)"
_PF = _P2.format(z="(b_full / se_full)")


def _joint_sql(m):
    return f"{_JOINT.format(m=m)}, {_fits('j')}, {_BH.format(part='dataset', p=_PF)} SELECT ja.dataset, ja.gene, coalesce(n, 0)::BIGINT AS n, coalesce(events, 0)::BIGINT AS events, b, se, hr, lower, upper, p, round(p_adj, 6) AS p_adj, CASE WHEN n IS NULL THEN 'fewer than 10 complete samples' ELSE reason END AS reason FROM ja LEFT JOIN fits USING (dataset, gene) LEFT JOIN p_adj USING (dataset, gene)"


def _makers(s, d):
    """A small panel with holes: the greatest value per sample and maker (the first digit of a brand)."""
    m = merged(s, d).withColumn("gene", F.substring("gene", 1, 7)).groupBy("dataset", "sample_id", "gene", "time", "status").agg(F.max("value").alias("value"))
    return m.withColumn("value", F.when(F.pmod(F.col("sample_id"), F.lit(7)) != F.substring("gene", 7, 1).cast("int"), F.col("value")))


_MAKERS = M + ", mk AS (SELECT dataset, sample_id, gene, time, status, CASE WHEN sample_id % 7 <> CAST(right(gene, 1) AS INT) THEN value END AS value FROM (SELECT dataset, sample_id, substr(gene, 1, 7) AS gene, time, status, max(value) AS value FROM m GROUP BY ALL) x)"
_q("cx3_screen_joint", lambda s, d: r6(meta.adjust(cox.screen(merged(s, d), joint=True), "p", family=["dataset"]), *_FIT, "p_adj"), f"WITH {M}, {_joint_sql('m')}")
_q("cx3_small_panel", lambda s, d: r6(meta.adjust(cox.screen(_makers(s, d), joint=True), "p", family=["dataset"]), *_FIT, "p_adj"), f"WITH {_MAKERS}, {_joint_sql('mk')}")
_q("cx3_screen", lambda s, d: r6(cox.screen(merged(s, d)), *_FIT), f"WITH {M}, {_fits('m')} SELECT * EXCLUDE (b_full, se_full) FROM fits")
_q("cx3_any_size", lambda s, d: r6(cox.screen(merged(s, d), large=0), *_FIT), f"WITH {M}, {_fits('m')} SELECT * EXCLUDE (b_full, se_full) FROM fits")
_q("cx4_across_cohorts", lambda s, d: r6(meta.adjust(cox.screen(one_gene(s, d).withColumn("value", F.col("value") / F.lit(10000.0)), scale=False)), *_FIT, "p_adj"),
   f"WITH {ONE}, o2 AS (SELECT * REPLACE (value / 10000.0::DOUBLE AS value) FROM o), {_fits('o2', scale=False)}, {_BH.format(part='1', p=_PF)} SELECT fits.* EXCLUDE (b_full, se_full), round(p_adj, 6) AS p_adj FROM fits LEFT JOIN p_adj USING (dataset, gene)")
# covariates below the threshold differ by cohort: in SQL the columns of the others are zeros
_q("cx5_screen_adjust", lambda s, d: r6(cox.screen_adjust(_covariates(s, d), ["dataset"], ["value", "balance"], ["nation"], threshold=0.5), "hr", "p", "hr_joint", "p_joint"),
   f"""WITH {ONE}, {_COVARIATES}, {_UNI}, pick AS (SELECT dataset, variable, min(p) < 0.5 AS used FROM uni GROUP BY dataset, variable),
mask AS MATERIALIZED (SELECT dataset, {', '.join(f"max(CASE WHEN used AND variable = '{v}' THEN 1 ELSE 0 END) AS on{i}" for i, (v, _) in enumerate(_COLUMNS))} FROM pick GROUP BY dataset),
{sql_models.newton('oc', 'dataset', _DUMMIES, mask='mask', tag='j')}, {sql_models.terms('dataset', _COLUMNS, tag='j')}, both_ AS (SELECT f.dataset, f.variable, f.level, {_ROUNDED} FROM jfit f JOIN pick USING (dataset, variable) WHERE used)
SELECT uni.dataset, uni.variable, uni.level, uni.hr, uni.p, uni.reason, t.hr AS hr_joint, t.p AS p_joint, CAST(NULL AS VARCHAR) AS reason_joint FROM uni LEFT JOIN both_ t ON t.dataset = uni.dataset AND t.variable = uni.variable AND t.level = uni.level""")
_LEVELS = "SELECT dataset, sample_id, status, 'nation' AS variable, CASE WHEN nation % 5 = 4 THEN 'N4' ELSE 'N' || CAST(nation % 3 AS VARCHAR) END AS level FROM surv UNION ALL SELECT dataset, sample_id, status, 'rare' AS variable, CASE WHEN sample_id % 97 = 0 THEN 'rare' ELSE 'usual' END AS level FROM surv"


def levels(s, d):
    """Two categorical covariates in long form, one of them with a rare level."""
    x = surv(s, d)
    nation = F.when(F.col("nation") % 5 == 4, F.lit("N4")).otherwise(F.concat(F.lit("N"), (F.col("nation") % 3).cast("string")))
    rare = F.when(F.col("sample_id") % 97 == 0, "rare").otherwise("usual")
    both = F.explode(F.array(F.struct(F.lit("nation").alias("variable"), nation.alias("level")), F.struct(F.lit("rare").alias("variable"), rare.alias("level")))).alias("k")
    return x.select("dataset", "sample_id", "status", both).select("dataset", "sample_id", "status", "k.*")


_VERDICT = f"""lv AS ({_LEVELS}), l1 AS (SELECT dataset, variable, level, count(*) AS n, sum(status)::BIGINT AS events FROM lv GROUP BY ALL),
l2 AS (SELECT *, count(*) OVER w AS levels, sum(n) OVER w AS total, max(n) OVER w AS top FROM l1 WINDOW w AS (PARTITION BY dataset, variable)),
l3 AS (SELECT dataset, variable, level, n, events, CASE WHEN levels = 1 THEN 'constant' WHEN top::DOUBLE / total >= 0.95 THEN 'near-constant' WHEN n < 5 THEN 'fewer than 5 patients' WHEN events = 0 THEN 'no events' WHEN events = n THEN 'all events' END AS verdict FROM l2)"""
_q("cx6_estimable", lambda s, d: cox.screen(one_gene(s, d).withColumn("value", F.when(F.col("dataset") == "BUILDING", F.lit(1.0)).otherwise(F.col("value"))).withColumn("status", F.when(F.col("dataset") == "MACHINERY", 1).when((F.col("dataset") == "FURNITURE") & (F.col("sample_id") % 100 != 1), 0).otherwise(F.col("status")))).select("dataset", "gene", "n", "events", F.col("reason").isNull().alias("ok"), "reason"),
   f"WITH {ONE}, o2 AS (SELECT dataset, gene, time, CASE WHEN dataset = 'MACHINERY' THEN 1 WHEN dataset = 'FURNITURE' AND sample_id % 100 <> 1 THEN 0 ELSE status END AS status, CASE WHEN dataset = 'BUILDING' THEN 1.0 ELSE value END AS value FROM o), {_fits('o2', steps=1)} SELECT dataset, gene, n, events, reason IS NULL AS ok, reason FROM fits")
# a marker that is least for every event among those at risk has no finite coefficient
_q("cx6_separated", lambda s, d: cox.screen(one_gene(s, d).withColumn("value", F.when(F.col("dataset") < "F", F.col("time")).otherwise(F.col("value")))).select("dataset", "gene", "n", "events", F.col("reason").isNull().alias("ok"), "reason"),
   f"WITH {ONE}, sep AS (SELECT dataset, gene, status, time, CASE WHEN dataset < 'F' THEN time ELSE value END AS value FROM o), gap AS (SELECT dataset, gene, status, value - min(value) OVER (PARTITION BY dataset ORDER BY time RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM sep), h AS (SELECT dataset, gene, count(*) AS n, sum(status)::BIGINT AS events, max(CASE WHEN status = 1 THEN above END) > 0 AS ok FROM gap GROUP BY ALL) SELECT dataset, gene, n, events, ok, CASE WHEN NOT ok THEN 'did not converge' END AS reason FROM h")
_q("cx7_covariate_screen", lambda s, d: cox.covariate_levels(levels(s, d), ["dataset"]).select("dataset", "variable", "level", "n", "events", "verdict"), f"WITH {_VERDICT} SELECT * FROM l3")
_q("cx7_merged_levels", lambda s, d: cox.merge_levels(levels(s, d).where("variable = 'rare'").withColumn("level", F.when(F.col("sample_id") % 53 == 0, "odd").otherwise(F.when(F.col("sample_id") % 2 == 0, "even").otherwise("other half"))), ["dataset"], 12).groupBy("dataset", "variable", "level", "merged").agg(F.count(F.lit(1)).alias("n")),
   """WITH lv AS (SELECT dataset, 'rare' AS variable, status, CASE WHEN sample_id % 53 = 0 THEN 'odd' WHEN sample_id % 2 = 0 THEN 'even' ELSE 'other half' END AS level FROM surv),
l1 AS (SELECT dataset, level, count(*) AS n, sum(status) AS e, count(*) OVER (PARTITION BY dataset) AS levels, max(count(*)) OVER (PARTITION BY dataset)::DOUBLE / sum(count(*)) OVER (PARTITION BY dataset) AS top FROM lv GROUP BY dataset, level),
l2 AS (SELECT dataset, level, levels > 1 AND top < 0.95 AND (n < 12 OR e = 0 OR e = n) AS merged FROM l1)
SELECT dataset, variable, CASE WHEN merged THEN 'Other' ELSE level END AS level, merged, count(*) AS n FROM lv JOIN l2 USING (dataset, level) GROUP BY ALL""")
_q("cx8_repair", lambda s, d: r6(cox.cox(_scaled(s, d).withColumn("copy", F.col("value") * 2).withColumn("flat", F.lit(1.0)), ["dataset"], ["value", "copy", "flat"], auto_repair=True).drop("warning"), *_FIT, "epv"),
   f"""WITH {ONE}, {_COVARIATES}, cand AS (SELECT *, 2 * value AS copy, 1.0::DOUBLE AS flat FROM oc),
gone AS (SELECT dataset, count(*) AS n, sum(status)::BIGINT AS events, unnest(['flat', 'copy']) AS variable, unnest([stddev_samp(flat) < 1e-9, abs(corr(value, copy)) > 1 - 1e-9]) AS bad FROM cand GROUP BY dataset),
{_fits('oc', 'dataset', scale=False)}
SELECT dataset, 'value' AS variable, '' AS level, n, events, b, se, hr, lower, upper, p, reason, 1 AS parameters, round(events::DOUBLE, 6) AS epv FROM fits
UNION ALL SELECT dataset, variable, '', n, events, NULL, NULL, NULL, NULL, NULL, NULL, 'removed by repair', 0, NULL FROM gone WHERE bad""")
_q("cx9_ph_test", lambda s, d: r6(cox.ph(_covariates(s, d), ["dataset"], ["value", "balance"], ["nation"]), "chisq").drop("p"),
   f"WITH {ONE}, {_COVARIATES}, {sql_models.newton('oc', 'dataset', _DUMMIES)}, {sql_models.change_test('oc', 'dataset', 5)} SELECT dataset, coalesce([{', '.join(repr(v) for v, _ in _COLUMNS)}][j + 1], 'GLOBAL') AS term, coalesce([{', '.join(repr(lv) for _, lv in _COLUMNS)}][j + 1], '') AS level, round(chisq, 6) AS chisq, CASE WHEN j < 0 THEN 5.0 ELSE 1.0 END::DOUBLE AS df FROM ph")
_q("cx_score_windows", lambda s, d: r6(cox.score_at_zero(merged(s, d).withColumn("value", F.col("value") / F.lit(10000.0)), K), "score", "info"),
   f"WITH {M}, a AS (SELECT dataset, gene, time, sum(status)::DOUBLE AS d, sum(status * (value / 10000.0::DOUBLE)) AS xd, count(*) AS mm, sum(value / 10000.0::DOUBLE) AS x, sum((value / 10000.0::DOUBLE) * (value / 10000.0::DOUBLE)) AS xx FROM m GROUP BY ALL), b AS (SELECT dataset, gene, d, xd, sum(mm) OVER w AS m0, sum(x) OVER w AS x1, sum(xx) OVER w AS x2 FROM a WINDOW w AS (PARTITION BY dataset, gene ORDER BY time DESC)) SELECT dataset, gene, round(sum(xd - d * x1 / m0), 6) AS score, round(sum(d * (x2 / m0 - (x1 / m0) * (x1 / m0))), 6) AS info FROM b GROUP BY ALL")


def cr(s, d):
    return surv(s, d).select("dataset", "sample_id", F.col("cr_time").alias("time"), F.col("cr_status").alias("status"), "balance", "nation")


def _cr(src, keys):
    return f"""r1 AS (SELECT {keys}, time, sum(CASE WHEN status <> 0 THEN 1 ELSE 0 END) AS d, count(*) AS m, sum(CASE WHEN status = 1 THEN 1 ELSE 0 END) AS d1, sum(CASE WHEN status = 2 THEN 1 ELSE 0 END) AS d2 FROM {src} GROUP BY {keys}, time),
r2 AS (SELECT *, sum(m) OVER (PARTITION BY {keys} ORDER BY time DESC)::BIGINT AS n FROM r1), r3 AS (SELECT *, exp(coalesce(sum(CASE WHEN d < n THEN ln(1 - d::DOUBLE / n) END) OVER (PARTITION BY {keys} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS sb FROM r2),
r4 AS (SELECT {keys}, time, n, d, sb, unnest([1, 2]) AS cause, unnest([d1, d2]) AS dk FROM r3), r5 AS (SELECT *, sum(sb * dk / n) OVER (PARTITION BY {keys}, cause ORDER BY time) AS cif FROM r4),
r6 AS (SELECT u.*, t.time AS reached, t.cif AS c FROM r5 t JOIN r5 u USING ({keys}, cause) WHERE u.time <= t.time),
r7 AS (SELECT {keys}, cause, reached AS time, sqrt(greatest(0, sum(power(c - cif, 2) * CASE WHEN d < n THEN d / (n::DOUBLE * (n - d)) ELSE 0 END + power(sb, 2) * dk * (n - dk) / power(n, 3) - 2 * sb * (c - cif) * dk / power(n, 2)))) AS se FROM r6 GROUP BY {keys}, cause, reached),
cif AS (SELECT {keys}, cause, time, n AS n_risk, dk::BIGINT AS n_event, cif, se, CASE WHEN cif > 0 THEN cif * exp(-{competing.Z} * se / cif) END AS lower, CASE WHEN cif > 0 THEN least(1.0, cif * exp({competing.Z} * se / cif)) END AS upper FROM r5 JOIN r7 USING ({keys}, cause, time))"""


_RAW = "r AS (SELECT dataset, cr_time AS time, cr_status AS status, balance FROM surv)"
_CIF = ("cif", "se", "lower", "upper")
_CIF_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in _CIF)
_q("cr1_incidence", lambda s, d: r6(competing.cumulative_incidence(cr(s, d), ["dataset"], [1, 2]), "time", *_CIF), f"WITH {_RAW}, {_cr('r', 'dataset')} SELECT dataset, cause, round(time, 6) AS time, n_risk, n_event, {_CIF_SQL} FROM cif")
_q("cr1_incidence_at", lambda s, d: r6(competing.cif_at(competing.cumulative_incidence(cr(s, d), ["dataset"], [1, 2]), ["dataset"], [0.5, 1, 2]), *_CIF),
   f"WITH {_RAW}, {_cr('r', 'dataset')}, a AS (SELECT cif.*, horizon FROM cif CROSS JOIN (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS horizon)) SELECT dataset, cause, horizon, coalesce(arg_min(n_risk, time) FILTER (WHERE time >= horizon), 0)::BIGINT AS n_risk, round(coalesce(arg_max(cif, time) FILTER (WHERE time <= horizon), 0), 6) AS cif, round(coalesce(arg_max(se, time) FILTER (WHERE time <= horizon), 0), 6) AS se, round(arg_max(lower, time) FILTER (WHERE time <= horizon), 6) AS lower, round(arg_max(upper, time) FILTER (WHERE time <= horizon), 6) AS upper FROM a GROUP BY dataset, cause, horizon HAVING horizon <= max(time)")


def _grouped_incidence(s, d):
    """Curves by tertile of the balance, read at the default times of the cohort, past the end of a curve as well."""
    x = competing.group_by_cuts(cr(s, d), ["dataset"], "balance", [1 / 3, 2 / 3])
    return competing.cif_at(competing.cumulative_incidence(x, ["dataset", "group"], [1, 2]), ["dataset", "group"], competing.event_times(x, ["dataset"]), extend=True)


_q("cr1_grouped", lambda s, d: r6(_grouped_incidence(s, d), "horizon", *_CIF),
   f"""WITH {_RAW}, tq AS (SELECT dataset, quantile_cont(balance, [{1 / 3}, {2 / 3}]) AS qs FROM r GROUP BY dataset), rg AS (SELECT dataset, time, status, 'Q' || CAST(1 + (balance >= qs[1])::INT + (balance >= qs[2])::INT AS VARCHAR) AS "group" FROM r JOIN tq USING (dataset)), {_cr('rg', 'dataset, "group"')},
tt AS (SELECT DISTINCT dataset, unnest(quantile_cont(time, [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS horizon FROM r WHERE status <> 0 GROUP BY dataset), a AS (SELECT cif.*, horizon FROM cif JOIN tt USING (dataset) WHERE horizon > 0)
SELECT dataset, "group", cause, round(horizon, 6) AS horizon, coalesce(arg_min(n_risk, time) FILTER (WHERE time >= horizon), 0)::BIGINT AS n_risk, round(coalesce(arg_max(cif, time) FILTER (WHERE time <= horizon), 0), 6) AS cif, round(coalesce(arg_max(se, time) FILTER (WHERE time <= horizon), 0), 6) AS se, round(arg_max(lower, time) FILTER (WHERE time <= horizon), 6) AS lower, round(arg_max(upper, time) FILTER (WHERE time <= horizon), 6) AS upper FROM a GROUP BY dataset, "group", cause, horizon""")
_q("cr2_group_cuts", lambda s, d: competing.group_by_cuts(cr(s, d), ["dataset"], "balance", [0.25, 0.5, 0.75]).groupBy("dataset", "group").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == 1).cast("int")).alias("events")),
   "WITH q AS (SELECT dataset, quantile_cont(balance, [0.25, 0.5, 0.75]) AS qs, count(DISTINCT balance) AS levels FROM surv GROUP BY dataset) SELECT s.dataset, CASE WHEN levels > 20 THEN 'Q' || CAST(1 + (balance >= qs[1])::INT + (balance >= qs[2])::INT + (balance >= qs[3])::INT AS VARCHAR) ELSE CAST(balance AS VARCHAR) END AS \"group\", count(*) AS n, sum(CASE WHEN cr_status = 1 THEN 1 ELSE 0 END)::BIGINT AS events FROM surv s JOIN q ON q.dataset = s.dataset GROUP BY ALL")
_q("cr3_cause_specific", lambda s, d: r6(competing.cause_specific(cr(s, d).withColumn("balance", F.col("balance") / F.lit(1000.0)), ["dataset"], 1, ["balance"]), *_FIT, "epv"),
   f"WITH rc AS (SELECT dataset, cr_time AS time, CASE WHEN cr_status = 1 THEN 1 ELSE 0 END AS status, balance / 1000.0::DOUBLE AS value FROM surv), {_fits('rc', 'dataset', scale=False)} SELECT dataset, 'balance' AS variable, '' AS level, * EXCLUDE (dataset, b_full, se_full), CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS parameters, round(events::DOUBLE, 6) AS epv, {_EPV.format(p=1)} FROM fits")
_FG = f"""{_RAW}, r0 AS (SELECT s.dataset, cr_time AS time, cr_status AS code, (cr_status = 1)::INT AS status, balance / 1000.0::DOUBLE AS balance, nation::DOUBLE AS nation FROM surv s WHERE cr_time >= 0),
g0 AS (SELECT dataset, time, sum((code = 0)::INT) AS c, count(*) AS m FROM r0 GROUP BY ALL), g1 AS (SELECT *, sum(m) OVER (PARTITION BY dataset ORDER BY time DESC) - (m - c) AS left_ FROM g0),
g2 AS (SELECT dataset, time, exp(coalesce(sum(CASE WHEN left_ > 0 THEN ln(greatest(1 - c / left_::DOUBLE, 1e-300)) ELSE 0 END) OVER (PARTITION BY dataset ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS g FROM g1),
fg AS MATERIALIZED (SELECT r0.*, g, CASE WHEN code NOT IN (0, 1) THEN 1 / g ELSE 0 END AS cw FROM r0 JOIN g2 USING (dataset, time))"""
_FGZ = _ROUNDED.replace("1.96", str(competing.Z))
_q("cr4_fine_gray", lambda s, d: r6(competing.fine_gray(cr(s, d).withColumn("balance", F.col("balance") / F.lit(1000.0)), ["dataset"], 1, ["balance", "nation"]), *_FIT),
   f"WITH {_FG}, {sql_models.newton('fg', 'dataset', ['balance', 'nation'], weighted=True)}, {sql_models.terms('dataset', [('balance', ''), ('nation', '')])}, {sql_models.robust('dataset', 2)}, ff AS (SELECT f.dataset, variable, level, n, events, b, sqrt([k0, k1][j + 1]) / [s0, s1][j + 1] AS se FROM qfit f JOIN rob USING (dataset) JOIN (SELECT dataset, s0, s1 FROM qabout) USING (dataset)) SELECT dataset, variable, level, n, events, {_FGZ}, CAST(NULL AS VARCHAR) AS reason FROM ff")
_q("mt1_two_stage", lambda s, d: r6(two_stage.two_stage(one_gene(s, d))[0].drop('parameters', 'epv', 'covariates_used'), *_FIT), f"WITH {ONE}, {_fits('o')} SELECT * EXCLUDE (b_full, se_full) FROM fits WHERE reason IS NULL")
_q("mt2_pool_dl", lambda s, d: r6(meta.pool_sums(peto(s, d), ["gene"]), *_POOL_ROUND), f"WITH {PETO}, {_pool('est', 'gene')} SELECT gene, {_POOL_OUT} FROM pooled")
_q("mt2_pool_fe", lambda s, d: r6(meta.pool_sums(peto(s, d), ["gene"], "FE"), *_POOL_ROUND), f"WITH {PETO}, {_pool('est', 'gene', dl=False)} SELECT gene, {_POOL_OUT} FROM pooled")
_q("mt2_pool_reml", lambda s, d: r6(meta.pool_groups(peto(s, d), ["gene"]), *_META_ROUND), f"WITH RECURSIVE {{views}}, {PETO}, {_meta('est')} SELECT {_META} FROM pools")
_q("mt3_pool_hk", lambda s, d: r6(meta.pool_groups(peto(s, d), ["gene"], "HK", "hk"), *_META_ROUND), f"WITH RECURSIVE {{views}}, {PETO}, {_meta('est', hk=True)} SELECT {_META} FROM pools")
_q("mt4_stouffer", lambda s, d: r6(peto(s, d).groupBy("gene").agg((F.sum(F.col("b") / F.col("se")) / F.sqrt(F.count(F.lit(1)))).alias("z_stouffer"), F.count(F.lit(1)).alias("k")), "z_stouffer"),
   f"WITH {PETO} SELECT gene, round(sum(b / se) / sqrt(count(*)), 6) AS z_stouffer, count(*) AS k FROM est GROUP BY gene")
# multiplicity on a p-like column that both engines compute exactly: 1 / (1 + chi-square)
_P = f"{M}, {_split('m', 'dataset, gene')}, {_logrank('g', 'dataset, gene')}, pv AS (SELECT dataset, gene, round(1 / (1 + (obs_high - exp_high) * (obs_high - exp_high) / var_high), 9) AS p FROM lr WHERE var_high > 0), rk AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p) AS r, count(*) OVER (PARTITION BY dataset) AS mm FROM pv)"
_ADJ = {
    "BH": "min(p * mm / r) OVER (PARTITION BY dataset ORDER BY r DESC)", "holm": "max(p * (mm - r + 1)) OVER (PARTITION BY dataset ORDER BY r)",
    "hochberg": "min(p * (mm - r + 1)) OVER (PARTITION BY dataset ORDER BY r DESC)", "bonferroni": "p * mm",
    "BY": "min(p * mm * list_sum(list_transform(range(1, mm + 1), lambda i: 1.0 / i)) / r) OVER (PARTITION BY dataset ORDER BY r DESC)",
}


def _pv(s, d):
    lr = km.logrank(km.split(merged(s, d), K), K, p=False).where("var_high > 0")
    return lr.select(*K, F.round(1 / (1 + F.col("chisq")), 9).alias("p"))


for _m, _e in _ADJ.items():
    _q(f"mt5_adjust_{_m.lower()}", lambda s, d, m=_m: r6(meta.adjust(_pv(s, d), "p", m, ["dataset"]), "p", "p_adj"), f"WITH {_P} SELECT dataset, gene, round(p, 6) AS p, round(least(1.0, {_e}), 6) AS p_adj FROM rk")
_q("mt5_adjust_hommel", lambda s, d: r6(meta.adjust(_pv(s, d), "p", "hommel", ["dataset"]), "p", "p_adj"), f"""WITH {_P},
h0 AS (SELECT dataset, list(p ORDER BY r) AS ps, max(mm) AS mm FROM rk GROUP BY dataset), h1 AS (SELECT rk.dataset, gene, p, r, rk.mm, ps FROM rk JOIN h0 USING (dataset)),
h2 AS (SELECT dataset, gene, p, r, mm, ps, unnest(range(2, mm + 1)) AS k FROM h1),
h3 AS (SELECT *, list_min(list_transform(range(2, k + 1), lambda i: k * ps[mm - k + i] / i)) AS q FROM h2)
SELECT dataset, gene, round(p, 6) AS p, round(least(1.0, max(least(k * ps[least(r, mm - k + 1)], q))), 6) AS p_adj FROM h3 GROUP BY dataset, gene, p""")


def _classes(s, d):
    x = surv(s, d).select("dataset").distinct()
    return x.withColumn("token", F.when(F.col("dataset") < "C", "OS").otherwise("RFS")).withColumn("pooling_class", F.when(F.col("dataset") < "C", "Exact-equivalent").when(F.col("dataset") < "G", "Not-poolable").otherwise("Clinically-related"))


for _mode, _ok in (("family", "'Exact-equivalent', 'Clinically-related'"), ("exact", "'Exact-equivalent'")):
    _q(f"mt8_gate_{_mode}", lambda s, d, m=_mode: two_stage.two_stage(one_gene(s, d), _classes(s, d), m)[1].where("stage = 'endpoint class'"),
       f"WITH c AS (SELECT DISTINCT dataset, CASE WHEN dataset < 'C' THEN 'Exact-equivalent' WHEN dataset < 'G' THEN 'Not-poolable' ELSE 'Clinically-related' END AS pc FROM surv) SELECT dataset, 'endpoint class' AS stage, 'pooling class ' || pc AS reason FROM c WHERE pc NOT IN ({_ok})")
_q("mt6_panel", lambda s, d: r6(two_stage.panel(merged(s, d))[0], *_META_ROUND, "fdr"),
   f"""WITH RECURSIVE {{views}}, {M}, {_fits('m')}, fe AS (SELECT dataset, gene, b_full AS b, se_full AS se FROM fits WHERE reason IS NULL), {_meta('fe')}, fc AS (SELECT gene, count(*) AS cohorts, count(reason)::BIGINT AS n_failed FROM fits GROUP BY gene),
fd AS (SELECT gene, least(1.0, min(p_full * mm / r) OVER (ORDER BY r DESC)) AS fdr FROM (SELECT gene, p_full, row_number() OVER (ORDER BY p_full) AS r, count(*) OVER () AS mm FROM pools) x)
SELECT fc.gene, cohorts, n_failed, {_META.removeprefix('gene, ')}, round(fdr, 6) AS fdr FROM fc JOIN pools USING (gene) JOIN fd USING (gene)""")


def _marker(s, d):
    """One marker with confounders: a number, a category, and a number that one cohort lacks and that is constant in another."""
    x = _covariates(s, d)
    return x.withColumn("dose", F.when(F.col("dataset") == "BUILDING", F.lit(None).cast("double")).when(F.col("dataset") == "MACHINERY", 1.0).otherwise(F.pmod(F.col("sample_id"), F.lit(7)).cast("double")))


_PER_SD = f"qsd AS (SELECT dataset, n, events, b0 AS b, sqrt(c0_0) AS se FROM qb9 JOIN qcov USING (dataset) JOIN qabout USING (dataset))"  # noqa: F541
_q("mt1_confounders", lambda s, d: r6(two_stage.two_stage(_covariates(s, d), cont=["balance"], cate=["nation"])[0], *_FIT, "epv"),
   f"WITH {ONE}, {_COVARIATES}, {sql_models.newton('oc', 'dataset', _DUMMIES)}, {_PER_SD} SELECT dataset, 'Brand#11' AS gene, n, events, {_ROUNDED}, 5 AS parameters, round(events / 5.0::DOUBLE, 6) AS epv, CAST(NULL AS VARCHAR) AS reason, 'balance, nation' AS covariates_used FROM qsd")
_MASK = "mask AS (SELECT DISTINCT dataset, 1 AS on0, 1 AS on1, CASE WHEN dataset IN ('BUILDING', 'MACHINERY') THEN 0 ELSE 1 END AS on2 FROM oc)"
_q("mt1_repaired", lambda s, d: r6(two_stage.two_stage(_marker(s, d), cont=["balance", "dose"], auto_repair=True)[0], *_FIT, "epv"),
   f"WITH {ONE}, oc AS MATERIALIZED (SELECT dataset, time, status, value / 10000.0::DOUBLE AS value, balance / 1000.0::DOUBLE AS balance, (sample_id % 7)::DOUBLE AS dose FROM o WHERE time >= 0), {_MASK}, {sql_models.newton('oc', 'dataset', ['value', 'balance', 'dose'], mask='mask')}, {_PER_SD} SELECT dataset, 'Brand#11' AS gene, n, events, {_ROUNDED}, 2 + on2 AS parameters, round(events / (2 + on2)::DOUBLE, 6) AS epv, CAST(NULL AS VARCHAR) AS reason, CASE WHEN on2 = 1 THEN 'balance, dose' ELSE 'balance' END AS covariates_used FROM qsd JOIN mask USING (dataset)")


def _gates(s, d):
    """The gates of an analysis: recorded tokens, one of them in conflict; two cohorts with shared patients."""
    pairs = s.createDataFrame([("AUTOMOBILE", "FURNITURE", 7)], "a string, b string, shared long")
    groups = s.createDataFrame([("AUTOMOBILE", "AUTOMOBILE"), ("FURNITURE", "AUTOMOBILE")], "accession string, root string")
    classes = _classes(s, d).withColumn("pooling_class", F.lit("Exact-equivalent"))
    tokens = classes.select("dataset", F.when(F.col("dataset") == "HOUSEHOLD", "DFS").otherwise(F.col("token")).alias("token"))
    return {"classes": classes, "tokens": tokens, "overlaps": (groups, pairs), "overlap": "dedupe"}


_q("mt1_ledger", lambda s, d: two_stage.two_stage(_marker(s, d), cont=["balance", "dose"], **_gates(s, d))[1],
   f"""WITH {ONE}, size AS (SELECT dataset, count(DISTINCT sample_id) AS n FROM o GROUP BY dataset), two AS (SELECT *, row_number() OVER (ORDER BY n DESC, dataset) AS r, first(dataset) OVER w AS best, first(n) OVER w AS most FROM size WHERE dataset IN ('AUTOMOBILE', 'FURNITURE') WINDOW w AS (ORDER BY n DESC, dataset)),
lost AS (SELECT dataset, 'overlap' AS stage, 'shares patients with ' || best || ': ' || most || ' samples against ' || n AS reason FROM two WHERE r > 1),
conflict AS (SELECT dataset, 'pooling' AS stage, 'endpoint token conflict: analysis uses DFS, classification records RFS' AS reason FROM size WHERE dataset = 'HOUSEHOLD'),
conf AS (SELECT dataset, CASE WHEN dataset = 'BUILDING' THEN NULL WHEN dataset = 'MACHINERY' THEN 1 ELSE sample_id % 7 END AS dose FROM o WHERE dataset NOT IN (SELECT dataset FROM lost UNION SELECT dataset FROM conflict)),
bad AS (SELECT dataset, 'model' AS stage, 'not estimable without repair: dose ' || CASE WHEN max(dose) IS NULL THEN 'absent from the data' ELSE 'constant in this cohort' END AS reason FROM conf GROUP BY dataset HAVING max(dose) IS NULL OR max(dose) = min(dose))
SELECT * FROM lost UNION ALL SELECT * FROM conflict UNION ALL SELECT * FROM bad""")
_q("mt1_ph", lambda s, d: r6(two_stage.ph_by_cohort(_covariates(s, d), ["balance"]), "chisq").drop("p"),
   f"WITH {ONE}, {_COVARIATES}, {sql_models.newton('oc', 'dataset', ['value', 'balance'])}, {sql_models.change_test('oc', 'dataset', 2)} SELECT dataset, coalesce(['value', 'balance'][j + 1], 'GLOBAL') AS term, '' AS level, round(chisq, 6) AS chisq, CASE WHEN j < 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS df FROM ph")
_q("mt6_confounders", lambda s, d: r6(two_stage.panel(merged(s, d).withColumn("balance", F.col("balance") / F.lit(1000.0)), cont=["balance"])[0], *_META_ROUND, "fdr"),
   f"""WITH RECURSIVE {{views}}, {M}, mb AS MATERIALIZED (SELECT dataset, gene, time, status, value, balance / 1000.0::DOUBLE AS balance FROM m WHERE time >= 0), {sql_models.newton('mb', 'dataset, gene', ['value', 'balance'])},
fe AS (SELECT dataset, gene, b0 AS b, sqrt(c0_0) AS se FROM qb9 JOIN qcov USING (dataset, gene)), {_meta('fe')}, fc AS (SELECT gene, count(*) AS cohorts, 0::BIGINT AS n_failed FROM fe GROUP BY gene),
fd AS (SELECT gene, least(1.0, min(p_full * mm / r) OVER (ORDER BY r DESC)) AS fdr FROM (SELECT gene, p_full, row_number() OVER (ORDER BY p_full) AS r, count(*) OVER () AS mm FROM pools) x)
SELECT fc.gene, cohorts, n_failed, {_META.removeprefix('gene, ')}, round(fdr, 6) AS fdr FROM fc JOIN pools USING (gene) JOIN fd USING (gene)""")
_q("mt7_leave_one_out", lambda s, d: r6(meta.leave_one_out(peto(s, d), ["gene"]), *_POOL_ROUND),
   f"WITH {PETO}, lo AS (SELECT e.gene, e.dataset, e.b, e.se, x.dataset AS left_out FROM est e JOIN est x ON x.gene = e.gene AND x.dataset <> e.dataset), {_pool('lo', 'gene, left_out')} SELECT gene, left_out, {_POOL_OUT} FROM pooled")
_q("mt9_concordance", lambda s, d: meta.concordance(peto(s, d), ["gene"]).select("gene", "k", "same"),
   f"WITH {PETO}, {_pool('est', 'gene', dl=False)} SELECT gene, count(*) AS k, sum(CASE WHEN sign(b) = sign(log_hr) THEN 1 ELSE 0 END)::BIGINT AS same FROM est JOIN pooled USING (gene) GROUP BY gene")
_q("mt10_forest", lambda s, d: r6(meta.forest(meta.pool_sums(peto(s, d), ["gene"]).withColumn("variable", F.col("gene"))).select("gene", "hr", "lower", "upper", "significant", "place"), "hr", "lower", "upper"),
   f"WITH {PETO}, {_pool('est', 'gene')} SELECT gene, round(hr, 6) AS hr, round(lower, 6) AS lower, round(upper, 6) AS upper, (lower > 1 OR upper < 1) AS significant, row_number() OVER (ORDER BY hr DESC, gene) AS place FROM pooled")


def queries():
    return {n: f for n, (f, _) in Q.items()}


def oracle_sql():
    return {n: s for n, (_, s) in Q.items() if s}
