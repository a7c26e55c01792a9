import numpy as np
import pytest
from pyspark.sql import functions as F

import slow_cox as slow

from cohortspark.functions import cox_kernel as k
from cohortspark.operators import competing, cox, cox_frame, km, marker_parts, ranges, roc, two_stage
from cohortspark.sources.adapters import expr, surv

SF = "/root/testdata/sf0.01"
CHI = {"AUTOMOBILE": 0.43748, "BUILDING": 0.075503, "FURNITURE": 0.466782, "HOUSEHOLD": 0.637489, "MACHINERY": 0.132079}


def cohort(n=200, seed=1, ties=False):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 2))
    t = g.exponential(np.exp(-x[:, 0])) + 0.01
    return (np.round(t, 1) + 0.1 if ties else t), (g.random(n) < 0.7).astype(int), x


def test_logrank_known_values(spark):
    m = surv(spark, SF).join(expr(spark, SF), ["dataset", "sample_id"]).where("gene = 'Brand#11'")
    got = {r.dataset: r.chisq for r in km.logrank(km.split(m, ["dataset"]), ["dataset"]).collect()}
    assert {d: round(c, 6) for d, c in got.items()} == CHI


@pytest.mark.parametrize("ties", [False, True])
def test_batch_fit_equals_single_fit(ties):
    t, s, x = cohort(ties=ties)
    many = k.fit_many(t, s, x)
    for j in range(2):
        one = slow.fit_one(t, s, x[:, j : j + 1])
        assert many.beta[j] == pytest.approx(one.beta[0], abs=1e-7) and many.se[j] == pytest.approx(one.cov[0, 0] ** 0.5, abs=1e-7)
    assert many.beta[0] > 0.5


def test_joint_screen_is_complete_over_all_genes(spark):
    t, s, _ = cohort(120)
    g = np.random.default_rng(4)
    x = np.round(g.normal(size=(120, 9)), 3)
    x[g.random(x.shape) < 0.05] = np.nan
    cells = lambda d, skip: [(d, i, f"g{j}", float(t[i]), int(s[i]), None if skip(i, j) or np.isnan(x[i, j]) else float(x[i, j])) for i in range(120) for j in range(9)]
    rows = cells("A", lambda i, j: False) + cells("none", lambda i, j: i % 9 == j)
    df = spark.createDataFrame(rows, "dataset string, sample_id int, gene string, time double, status int, value double")
    df = df.where("value IS NOT NULL OR sample_id % 2 = 0")
    whole = np.isfinite(x).all(axis=1)
    z = (x[whole] - x[whole].mean(axis=0)) / x[whole].std(axis=0, ddof=1)
    fit = k.fit_many(t[whole], s[whole], z)
    for buckets in (1, 8):
        got = {(r.dataset, r.gene): r for r in cox.screen(df, joint=True, buckets=buckets).collect()}
        assert len(got) == 18
        for j in range(9):
            r = got["A", f"g{j}"]
            assert (r.n, r.events) == (whole.sum(), s[whole].sum()) and r.b == pytest.approx(fit.beta[j], abs=1e-8) and r.se == pytest.approx(fit.se[j], abs=1e-8)
            r = got["none", f"g{j}"]
            assert (r.n, r.b, r.reason) == (0, None, "fewer than 10 complete samples")


def test_missing_values_weigh_nothing():
    t, s, x = cohort()
    y = x.copy()
    y[::3, 0] = np.nan
    keep = np.isfinite(y[:, 0])
    a, b = k.fit_many(t, s, y), k.fit_many(t[keep], s[keep], x[keep])
    assert a.beta[0] == pytest.approx(b.beta[0], abs=1e-8) and a.n[0] == keep.sum()


def test_score_at_zero_is_logrank_without_ties():
    t, s, x = cohort()
    high = (x[:, 0] > np.median(x[:, 0])).astype(float)
    fit = k.fit_many(t, s, high[:, None])
    order = np.argsort(-t)
    n, n1 = np.arange(1, len(t) + 1), high[order].cumsum()
    expected = (s[order] * n1 / n).sum()
    assert fit.score0[0] == pytest.approx((s * high).sum() - expected, abs=1e-9)


def test_separation_is_not_estimable(spark):
    rows = [("A", i, float(i + 1), 1 if i < 30 else 0, 1.0 if i < 30 else 0.0) for i in range(60)]
    got = cox.cox(spark.createDataFrame(rows, "dataset string, sample_id int, time double, status int, x double"), ["dataset"], ["x"]).first()
    assert got.b is None and got.reason.startswith("not estimable")


def test_repair_leaves_one_of_equal_columns(spark):
    t, s, x = cohort(100)
    rows = [("A", float(a), int(b), float(c), float(2 * c), 1.0) for a, b, c in zip(t, s, x[:, 0], strict=True)]
    df = spark.createDataFrame(rows, "dataset string, time double, status int, x double, twice double, flat double")
    got = {r.variable: r.reason for r in cox.cox(df, ["dataset"], ["x", "twice", "flat"], auto_repair=True).collect()}
    assert got == {"x": None, "twice": "removed by repair", "flat": "removed by repair"}


def models(ties=True):
    """Two cohorts with two numbers, a category and two causes."""
    g = np.random.default_rng(1)
    rows, ref = [], {}
    for name, n in (("A", 160), ("B", 120)):
        x, c = g.normal(size=(n, 2)), g.choice(list("pqr"), n)
        t = g.exponential(np.exp(-x[:, 0] - 0.5 * (c == "q"))) + 0.05
        t = np.round(t, 1) + 0.1 if ties else t
        code = g.choice([0, 1, 2], n, p=[0.3, 0.4, 0.3])
        rows += [(name, float(a), int(e), float(u), float(1000 * v), str(w)) for a, e, u, v, w in zip(t, code, x[:, 0], x[:, 1], c, strict=True)]
        ref[name] = t, code, np.stack([x[:, 0], 1000 * x[:, 1], c == "q", c == "r"], axis=1).astype(float)
    return rows, ref


TERMS = [("x", ""), ("y", ""), ("c", "q"), ("c", "r")]
MODELS = "dataset string, time double, status int, x double, y double, c string"


@pytest.mark.parametrize("block_rows", [None, 40])
def test_joint_models_equal_plain_loops(spark, block_rows):
    rows, ref = models()
    df = spark.createDataFrame(rows, MODELS).withColumn("status", (F.col("status") == 1).cast("int"))
    odd = spark.createDataFrame([("A", 1.0, 1, None, 2.0, "p"), ("A", 1.0, 1, 1.0, float("nan"), "p"), ("A", 1.0, 1, 1.0, 2.0, None), ("none", 1.0, 0, 1.0, 2.0, "p"), ("none", 2.0, 0, 2.0, 2.0, "q")], MODELS)
    got = {(r.dataset, r.variable, r.level): r for r in cox_frame.fit_models(df.unionByName(odd), ["dataset"], ["x", "y"], ["c"], block_rows=block_rows).collect()}
    for name, (t, code, x) in ref.items():
        fit = slow.fit_one(t, (code == 1).astype(int), x)
        for j, term in enumerate(TERMS):
            r = got[name, *term]
            assert (r.n, r.events, r.parameters) == (len(t), (code == 1).sum(), 4) and r.epv == r.events / 4
            assert r.b == pytest.approx(fit.beta[j], rel=1e-7) and r.se == pytest.approx(fit.cov[j, j] ** 0.5, rel=1e-7)
    assert {r.reason for key, r in got.items() if key[0] == "none"} == {"no estimable term"}
    assert cox_frame.fit_models(df.limit(0), ["dataset"], ["x"]).count() == 0


def test_sums_and_matrices_give_the_same_screens(spark):
    m = surv(spark, SF).join(expr(spark, SF), ["dataset", "sample_id"]).where("gene IN ('Brand#11', 'Brand#12')")
    for how in ({"joint": True}, {"scale": False}):
        a, b = ({(r.dataset, r.gene): r for r in cox.screen(m.withColumn("value", F.col("value") / 1e4), large=large, **how).collect()} for large in (None, 0))
        assert set(a) == set(b)
        for key, r in a.items():
            assert (r.n, r.events, r.reason) == (b[key].n, b[key].events, b[key].reason) and (r.b is None or (r.b == pytest.approx(b[key].b, abs=1e-7) and r.se == pytest.approx(b[key].se, abs=1e-7)))
    m = m.withColumn("nation", F.concat(F.lit("N"), F.col("nation") % 3)).withColumn("flat", F.lit(1.0))
    a, b = ({(r.dataset, r.gene): r for r in two_stage.adjusted_screen(m, ["balance", "flat"], ["nation"], large=large).collect()} for large in (None, 0))
    for key, r in a.items():
        assert (r.n, r.events, r.parameters, r.reason) == (b[key].n, b[key].events, b[key].parameters, b[key].reason) and r.parameters == 4
        assert r.b == pytest.approx(b[key].b, abs=1e-6) and r.se == pytest.approx(b[key].se, abs=1e-6)


def test_shared_covariates_equal_plain_loops():
    t, s, x = cohort(150, ties=True)
    g = np.random.default_rng(7)
    z = np.stack([x[:, 1], g.integers(0, 2, 150)], axis=1).astype(float)
    markers = np.stack([x[:, 0], g.normal(size=150), np.where(g.random(150) < 0.2, np.nan, x[:, 0]), z[:, 0]], axis=1)
    got = k.fit_shared(t, s, markers, z)
    for j in range(3):
        on = np.isfinite(markers[:, j])
        one = slow.fit_one(t[on], s[on], np.column_stack([markers[on, j], z[on]]))
        assert got.converged[j] and got.beta[j] == pytest.approx(one.beta[0], abs=1e-7) and got.se[j] == pytest.approx(one.cov[0, 0] ** 0.5, abs=1e-7)
    assert not got.converged[3]  # the marker is one of the covariates


@pytest.mark.parametrize("block_rows", [None, 40])
def test_fine_gray_equals_every_patient_against_every_event(spark, monkeypatch, block_rows):
    if block_rows:
        monkeypatch.setattr(cox_frame, "BLOCK_ROWS", block_rows)
    rows, ref = models()
    got = {(r.dataset, r.variable): r for r in competing.fine_gray(spark.createDataFrame(rows, MODELS), ["dataset"], 1, ["x", "y"]).collect()}
    for name, (t, code, x) in ref.items():
        b, v = slow.fine_gray(t, code, x[:, :2], 1)
        for j, c in enumerate("xy"):
            assert got[name, c].b == pytest.approx(b[j], rel=1e-6) and got[name, c].se == pytest.approx(v[j, j] ** 0.5, rel=1e-6)


def test_fine_gray_without_competing_events_is_cox(spark):
    t, s, x = cohort(ties=True)
    df = spark.createDataFrame([("A", float(a), int(b), float(c), float(d)) for a, b, (c, d) in zip(t, s, x, strict=True)], "dataset string, time double, status int, x double, y double")
    one = slow.fit_one(t, s, x)
    assert [r.b for r in competing.fine_gray(df, ["dataset"], 1, ["x", "y"]).orderBy("variable").collect()] == pytest.approx(list(one.beta), abs=1e-6)


@pytest.mark.parametrize("block_rows", [None, 40])
def test_ph_test_equals_plain_loops(spark, monkeypatch, block_rows):
    if block_rows:
        monkeypatch.setattr(cox_frame, "BLOCK_ROWS", block_rows)
    rows, ref = models()
    df = spark.createDataFrame(rows, MODELS).withColumn("status", (F.col("status") == 1).cast("int"))
    got = {(r.dataset, r.term, r.level): r for r in cox.ph(df, ["dataset"], ["x", "y"], ["c"]).collect()}
    for name, (t, code, x) in ref.items():
        want = slow.ph_test(t, (code == 1).astype(int), x)
        for term, (chisq, df_, p) in zip([*TERMS, ("GLOBAL", "")], want, strict=True):
            r = got[name, *term]
            assert r.chisq == pytest.approx(chisq, rel=1e-6) and r.df == df_ and r.p == pytest.approx(p, abs=1e-8)


def test_ph_test_sees_a_changing_effect(spark):
    g = np.random.default_rng(5)
    x = g.integers(0, 2, 600).astype(float)
    t = np.where(x == 1, g.weibull(3, 600), g.weibull(0.7, 600)) + 1e-3
    rows = [("changes", float(a), 1, float(b)) for a, b in zip(t, x, strict=True)] + [("same", float(a), 1, float(b)) for a, b in zip(g.exponential(size=600), x, strict=True)]
    got = {(r.dataset, r.term): r for r in cox.ph(spark.createDataFrame(rows, "dataset string, time double, status int, x double"), ["dataset"], ["x"]).collect()}
    assert got["changes", "x"].p < 1e-4 and got["same", "x"].p > 1e-3 and got["same", "x"].chisq == pytest.approx(got["same", "GLOBAL"].chisq)


def km_to(t, s, h):
    out = 1.0
    for u in np.unique(t[(t <= h) & (s == 1)]):
        out *= 1 - ((t == u) & (s == 1)).sum() / (t >= u).sum()
    return out


def slow_area(t, s, x, h, nne):
    n, cuts = len(x), np.unique(x)[::-1]
    place = np.array([(x < v).mean() for v in x])
    si = {v: km_to(t[near], s[near], h) for v in cuts for near in [np.abs(place - (x < v).mean()) < 0.25 * n**-0.2]} if nne else {}
    whole = np.mean([si[v] for v in x]) if nne else km_to(t, s, h)
    tp, fp = [0.0], [0.0]
    for c in cuts:
        above = x > c
        joint = sum(si[v] for v in x[above]) / n if nne else (km_to(t[above], s[above], h) if above.any() else 1.0) * above.mean()
        tp.append((above.mean() - joint) / (1 - whole))
        fp.append(joint / whole)
    tp, fp = np.array([*tp, 1.0]), np.array([*fp, 1.0])
    return len(tp), ((tp[1:] + tp[:-1]) / 2 * np.diff(fp)).sum()


def slow_cut(t, s, x, low=0.1, high=0.9):
    lo, hi = np.quantile(x, [low, high])
    cuts, best = [c for c in np.unique(x) if lo <= c <= hi], 0.0
    for c in cuts:
        u = v = 0.0
        for at in np.unique(t):
            n, n1, d = (t >= at).sum(), ((t >= at) & (x > c)).sum(), ((t == at) & (s == 1)).sum()
            u += ((t == at) & (s == 1) & (x > c)).sum() - d * n1 / n
            v += d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) if n > 1 else 0
        best = max(best, abs(u) / v**0.5 if v > 1e-12 else 0)
    return len(cuts), best


def markers(spark):
    g = np.random.default_rng(3)
    keys = {"a": (90, 12), "b": (60, 60), "c": (25, 2), "one value": (20, 1)}
    data = {key: (np.round(g.exponential(2, n), 1) + 0.1, g.integers(0, 2, n), g.integers(0, levels, n).astype(float)) for key, (n, levels) in keys.items()}
    rows = [(key, float(a), int(b), float(c)) for key, xs in data.items() for a, b, c in zip(*xs, strict=True)]
    return data, spark.createDataFrame([*rows, ("a", 1.0, 1, None)], "dataset string, time double, status int, value double")


@pytest.mark.parametrize("part_cells", [None, 64, 700])
def test_areas_and_cuts_equal_plain_loops(spark, monkeypatch, part_cells):
    monkeypatch.setattr(marker_parts, "CELLS", part_cells or 1 << 20)
    data, df = markers(spark)
    how = {"part_cells": part_cells, "block_rows": 20 if part_cells else None}
    for method in ("KM", "NNE"):
        got = {r.dataset: r for r in roc.auc(df, ["dataset"], 2.0, method, **how).collect()}
        for key, (t, s, x) in data.items():
            points, area = slow_area(t, s, x, 2.0, method == "NNE")
            assert got[key].points == points and got[key].auc == pytest.approx(area, abs=1e-9)
    got = {r.dataset: r for r in km.adjusted_cut_p(df, ["dataset"], **how).collect()}
    for key, (t, s, x) in data.items():
        cuts, best = slow_cut(t, s, x)
        assert got[key].cuts == cuts and got[key].max_stat == pytest.approx(best, abs=1e-7)
    assert roc.auc(df.limit(0), ["dataset"], 2.0).count() == 0 and km.adjusted_cut_p(df.limit(0), ["dataset"]).count() == 0


def test_sums_over_earlier_rows_equal_all_pairs():
    g = np.random.default_rng(2)
    e, w, m = g.integers(0, 30, 900), g.random(900), g.integers(1, 4, 900).astype(float)
    low, high = marker_parts.dominance(e, w, m, 32)
    for i in range(0, 900, 7):
        assert low[i] == pytest.approx(w[:i][e[:i] <= e[i]].sum()) and high[i] == m[:i][e[:i] > e[i]].sum()


def test_roc_of_a_perfect_marker(spark):
    df = spark.createDataFrame([("A", float(i), 1, float(-i)) for i in range(1, 101)], "dataset string, time double, status int, value double")
    assert roc.auc(df, ["dataset"], 50.0).first().auc == pytest.approx(1.0, abs=0.02)
    assert roc.auc(df, ["dataset"], 50.0, "NNE", 0.02).first().auc > 0.95


def test_areas_of_every_gene(spark):
    m = surv(spark, SF).join(expr(spark, SF), ["dataset", "sample_id"])
    got = {(r.dataset, r.gene): (r.points, r.auc) for r in roc.auc(m, ["dataset", "gene"], 2.0).collect()}
    want = {(r.dataset, r.gene) for r in roc.counts_at(m, ["dataset", "gene"], 2.0).where("refusal IS NULL").collect()}
    assert set(got) == want and len({g for _, g in want}) > len({g for _, g in want if g.startswith("Brand#1")})
    rows = m.toPandas()
    for key in sorted(want)[::9]:
        g = rows[(rows["dataset"] == key[0]) & (rows["gene"] == key[1])]
        points, area = slow_area(*(g[c].to_numpy(float) for c in ("time", "status", "value")), 2.0, False)
        assert got[key] == (points, pytest.approx(area, abs=1e-9))


@pytest.mark.parametrize("one_buffer", [None, 50, 400])
def test_exact_quantiles(spark, one_buffer):
    g = np.random.default_rng(6)
    data = {"ties": g.integers(0, 5, 700).astype(float), "wide": g.normal(size=900), "few": np.array([3.0]), "hot": np.where(g.random(600) < 0.5, 1.0, g.random(600)), "two": np.array([1.0, 4.0])}
    df = spark.createDataFrame([(key, float(v)) for key, x in data.items() for v in x] + [("few", None)], "dataset string, value double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r.dataset: list(r.q) for r in ranges.quantiles(df, ["dataset"], "value", probs, one_buffer).collect()}
    assert set(got) == set(data) and all(got[key] == pytest.approx(list(np.quantile(x, probs)), abs=1e-12) for key, x in data.items())


def counted(df, seen):
    """The rows, counted each time a task makes them."""
    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    return df.mapInPandas(count, df.schema)


@pytest.mark.parametrize("one_buffer", [None, 50])
def test_quantiles_make_their_rows_once(spark, one_buffer):
    seen = spark.sparkContext.accumulator(0)
    df = counted(spark.range(700).selectExpr("CASE WHEN id < 30 THEN 'few' ELSE 'many' END AS dataset", "CAST(id * 37 % 701 AS DOUBLE) AS value"), seen)
    assert ranges.quantiles(df, ["dataset"], "value", [0.25, 0.9], one_buffer).count() == 2
    assert seen.value == 700


def test_screens_and_models_make_their_rows_once(spark):
    t, s, x = cohort(60)
    df = spark.createDataFrame([(d, i, g, float(t[i]), int(s[i]), float(x[i, k]), float(i * 5 % 7)) for d in "ab" for i in range(60) for k, g in enumerate(("g", "h"))], "dataset string, sample_id int, gene string, time double, status int, value double, dose double")
    runs = {
        "joint": lambda d: cox.screen(d, joint=True), "all": lambda d: cox.cox(d.where("gene = 'g'"), ["dataset"], ["value", "dose"]),
        "ledger": lambda d: two_stage.two_stage(d.where("gene = 'g'"), cont=["dose"])[1],
    }
    for name, run in runs.items():
        seen = spark.sparkContext.accumulator(0)
        run(counted(df, seen)).collect()
        assert (name, seen.value) == (name, 240)


def test_no_bucket_of_genes_is_larger_than_asked(spark, monkeypatch):
    monkeypatch.setattr(cox, "CELLS", 100)
    df = spark.range(2000).selectExpr("IF(id < 400, 'a', 'b') AS dataset", "id div 20 AS sample_id", "concat('g', id % 20) AS gene")
    genes = cox.dealt(df)
    most = genes.groupBy("dataset", "_bucket").agg(F.sum("_n").alias("n")).groupBy("dataset").agg(F.max("n").alias("n"), F.count("n").alias("buckets"))
    # 20 and 80 samples: five genes and one
    assert {r.dataset: (r.n, r.buckets) for r in most.collect()} == {"a": (100, 4), "b": (80, 20)}


def test_gates_of_the_two_stage_analysis(spark):
    t, s, x = cohort(200)
    rows = [(d, i, "g", float(t[i]), int(s[i]), float(x[i, 0]), None if d == "lacks" else 1.0 if d == "flat" else float(x[i, 1])) for d in ("fine", "lacks", "flat", "other token", "class", "small copy") for i in range(30 if d == "small copy" else 200)]
    df = spark.createDataFrame(rows, "dataset string, sample_id int, gene string, time double, status int, value double, dose double")
    names = ["fine", "lacks", "flat", "other token", "class", "small copy"]
    classes = spark.createDataFrame([(d, "OS", "Not-poolable" if d == "class" else "Exact-equivalent") for d in names], "dataset string, token string, pooling_class string")
    tokens = spark.createDataFrame([(d, "DSS" if d == "other token" else "OS") for d in names], "dataset string, token string")
    pairs = spark.createDataFrame([("fine", "small copy", 30)], "a string, b string, shared long")
    groups = spark.createDataFrame([("fine", "fine"), ("small copy", "fine")], "accession string, root string")
    gates = {"classes": classes, "tokens": tokens, "overlaps": (groups, pairs)}
    fits, ledger = two_stage.two_stage(df, cont=["dose"], overlap="dedupe", **gates)
    assert [r.dataset for r in fits.collect()] == ["fine"]
    assert {r.dataset: r.stage for r in ledger.collect()} == {"small copy": "overlap", "other token": "pooling", "class": "endpoint class", "lacks": "model", "flat": "model"}
    fits, ledger = two_stage.two_stage(df, cont=["dose"], auto_repair=True, overlap="warn", **gates)
    got = {r.dataset: r for r in fits.collect()}
    assert {d: (r.covariates_used, r.parameters) for d, r in got.items()} == {"fine": ("dose", 2), "small copy": ("dose", 2), "lacks": ("", 1), "flat": ("", 1)}
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    assert got["fine"].b == pytest.approx(slow.fit_one(t, s, z).beta[0], abs=1e-7) and got["lacks"].b == pytest.approx(slow.fit_one(t, s, z[:, :1]).beta[0], abs=1e-7)
    with pytest.raises(ValueError, match="share patients"):
        two_stage.two_stage(df, overlap="refuse", **gates)


def test_repair_takes_one_covariate_at_a_time(spark):
    t, s, x = cohort(120)
    rows = [("A", float(a), int(b), float(c), float(c + d), float(d), "same") for a, b, (c, d) in zip(t, s, x, strict=True)]
    df = spark.createDataFrame(rows, "dataset string, time double, status int, x double, both double, y double, level string")
    faulty = cox.cox(df, ["dataset"], ["x", "both", "y"]).collect()
    assert all(r.b is None and r.reason.startswith("not estimable") for r in faulty)
    got = {r.variable: r for r in cox.cox(df, ["dataset"], ["x", "both", "y"], auto_repair=True).collect()}
    assert got["y"].reason == "removed by repair" and got["x"].reason is None and got["both"].reason is None and got["x"].parameters == 2
    few = cox.cox(df.limit(15), ["dataset"], ["x", "y"]).collect()
    assert {r.warning for r in few} == {"fewer than 10 events per variable"} and {r.warning for r in cox.cox(df, ["dataset"], ["x"]).collect()} == {None}


def test_one_sided_split_is_excluded(spark):
    rows = [("A", i, float(i), 1, 1.0 if i < 70 else 0.0) for i in range(100)]
    df = km.split(spark.createDataFrame(rows, "dataset string, sample_id int, time double, status int, value double"), ["dataset"])
    assert km.pool_ledger(df).first().reason == "one-sided split"


def incidence(time, status, cause, weight, at):
    """Weighted Aalen-Johansen estimate at a time."""
    s, total = 1.0, 0.0
    for u in np.unique(time[time <= at]):
        n = weight[time >= u].sum()
        here = time == u
        total += s * weight[here & (status == cause)].sum() / n
        s *= 1 - weight[here & (status != 0)].sum() / n
    return total


def test_incidence_errors_are_those_of_the_infinitesimal_jackknife(spark):
    g = np.random.default_rng(8)
    time, status, group = np.round(g.exponential(2, 60), 1) + 0.1, g.choice([0, 1, 2], 60, p=[0.4, 0.35, 0.25]), g.choice(["a", "b"], 60)
    df = spark.createDataFrame([(str(c), float(t), int(x)) for c, t, x in zip(group, time, status, strict=True)], "group string, time double, status int")
    curves = competing.cumulative_incidence(df, ["group"], [1, 2])
    for r in curves.collect():
        own = group == r["group"]
        t, x = time[own], status[own]
        one = np.ones(own.sum())
        assert r.cif == pytest.approx(incidence(t, x, r.cause, one, r.time), abs=1e-9)
        grad = [(incidence(t, x, r.cause, one + 1e-5 * e, r.time) - incidence(t, x, r.cause, one - 1e-5 * e, r.time)) / 2e-5 for e in np.eye(len(one))]
        assert r.se == pytest.approx(np.sqrt(np.sum(np.square(grad))), abs=1e-6)
        assert (r.lower is None) == (r.cif == 0) and (r.cif == 0 or r.lower <= r.cif <= r.upper <= 1)
    times = competing.event_times(df, [])
    assert [round(x.horizon, 9) for x in times.orderBy("horizon").collect()] == sorted({round(float(q), 9) for q in np.quantile(time[status != 0], np.arange(0.2, 0.95, 0.1))})
    late = competing.cif_at(curves, ["group"], [1e6], extend=True)
    last = {(r["group"], r.cause): r.cif for r in curves.orderBy("time").collect()}
    assert {(r["group"], r.cause): r.cif for r in late.collect()} == last and all(r.n_risk == 0 for r in late.collect())
    assert competing.cif_at(curves, ["group"], [1e6]).count() == 0
