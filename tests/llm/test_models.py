"""Classifiers: held-out accuracy, flat trees, risk, codewords; and odd rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortspark.llm import language, quality, toxicity
from cohortspark.llm._sample import drawn, drawn_with
from cohortspark.sources.shared import shared_dir

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, label int"
CLASH = SCHEMA + ", score double, predicted int, held_out boolean, lang_pred string, print int"
ODD = [(1, None, "en", 1), (2, "", None, 0), (2, "", None, 0), (None, "12 34 !!", "fr", 1), (3, "mot " * 30_000, "fr", 0)]


def held(spark, name, label):
    p = entry.queries()[name](spark, SF).toPandas()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(p) == n and p.score.between(0, 1).all() and ((p.score >= 0.3) == (p.predicted == 1)).all()
    lab = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    m = p.merge(lab)
    m = m[m.held_out]
    r = m.score.rank().to_numpy()
    y = m[label].to_numpy()
    k = y.sum()
    return m, (r[y == 1].sum() - k * (k + 1) / 2) / (k * (len(y) - k))


def test_quality_held_out(spark):
    m, auc = held(spark, "op7_quality", "quality")
    assert auc > 0.95 and (m[m.quality == 1].predicted == 1).mean() > 0.97


def test_toxicity_held_out(spark):
    _, auc = held(spark, "op4_toxicity", "toxic")
    assert auc > 0.8


def test_language_held_out(spark):
    p = entry.queries()["op8_language_id"](spark, SF).toPandas()
    m = p.merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas())
    assert (m[m.held_out].lang_pred == m[m.held_out].lang).mean() > 0.97


def test_trees_equal_a_walk():
    g = np.random.default_rng(0)
    x = g.normal(size=(400, len(quality.STATS)))
    t = quality.fit(x, (x[:, 3] + x[:, 5] > 0).astype(float), trees=12)
    p = t.predict(x)

    def walk(row):
        total = t.bias
        for k in range(len(t.feature)):
            node = 0
            while node < t.feature.shape[1]:
                node = 2 * node + (2 if row[t.feature[k, node]] > t.threshold[k, node] else 1)
            total += t.leaf[k, node - t.feature.shape[1]]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(p, [walk(r) for r in x])
    assert ((p > 0.5) == (x[:, 3] + x[:, 5] > 0)).mean() > 0.9
    assert np.allclose(quality.fit(x[:0], np.zeros(0)).predict(x[:3]), 0.5)


def test_negative_risk_does_not_overfit():
    g = np.random.default_rng(1)
    pos = np.hstack([np.ones((80, 1)), g.integers(0, 2, (80, 30))]).astype(float)
    unl = np.hstack([(g.random((800, 1)) < 0.2), g.integers(0, 2, (800, 30))]).astype(float)
    w, b = toxicity.nnpu(pos, unl, 0.2)
    assert w[0] > 3 * np.abs(w[1:]).max()
    p = 1 / (1 + np.exp(-(unl @ w + b)))
    assert p[unl[:, 0] == 1].mean() > 0.7 and p[unl[:, 0] == 0].mean() < 0.2


@pytest.mark.parametrize("k", [2, 3, 4, 5, 40])
def test_codewords_are_apart(k):
    code = language.codewords(k)
    far = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
    assert len({tuple(r) for r in code}) == k and far >= (1 if k == 2 else 2)


def test_odd_rows(spark):
    shared_dir(spark)
    df = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    q = quality.score(df, quality.train(df, labels)).collect()
    t = toxicity.score(df, toxicity.train(df, labels)).collect()
    la = language.predict(df, language.train(df)).collect()
    assert len(q) == len(t) == len(la) == len(ODD)
    assert all(r.lang_pred == "und" and r.score == 0 for r in la if r.doc_id != 3)
    none = df.limit(0)
    assert quality.score(none, quality.train(none, labels)).count() == 0 and toxicity.score(none, None).count() == 0 and language.predict(none, language.train(none)).count() == 0
    wide = spark.createDataFrame([(*r, 0.1 * k, 9, False, "zz", k) for k, r in enumerate(ODD)], CLASH)
    twice = spark.createDataFrame([(3, 1, 1), (3, 0, 0), (3, 1, 1), (None, 1, 1), (1, None, None), (1, 7, 7)], "doc_id long, quality int, toxic int")
    model = quality.train(wide, twice)
    kept = quality.accepted(wide, model)
    assert kept.schema == wide.schema and {r.print for r in kept.collect()} == {k for k, r in enumerate(quality.score(wide, model).collect()) if r.predicted}
    assert quality.accepted(none, model).count() == 0
    for got in (toxicity.score(wide, toxicity.train(wide, twice)), language.predict(wide, language.train(wide))):
        assert got.count() == len(ODD) and all(0 <= r.score <= 1 for r in got.collect())


def test_samples_stay_bounded(spark):
    """One id with very many rows, alike or not, makes no sample larger."""
    hot = spark.range(4000).selectExpr("CAST(7 AS BIGINT) AS doc_id", "CASE WHEN id % 2 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    got = drawn(hot.unionByName(spark.range(2000).selectExpr("id AS doc_id", "'x' AS text")), 300)
    assert 140 < got.count() < 260 and sorted(map(tuple, got.collect())) == sorted(map(tuple, drawn(hot.repartition(7).unionByName(spark.range(2000).selectExpr("id AS doc_id", "'x' AS text")), 300).collect()))


def test_rare_values_are_drawn_on_their_own(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") < 30, "rare").when(F.col("id") < 500, "few").otherwise("many").alias("lang"))
    got = {r.lang: r["count"] for r in drawn_with(rows, "lang", 1000, 50, 5).groupBy("lang").count().collect()}
    assert got["rare"] == 30 and 40 <= got["few"] <= 120 and 850 <= got["many"] <= 1100
    again = lambda n: {r.doc_id for r in drawn_with(rows.repartition(n), "lang", 1000, 50, 5).collect()}
    assert again(3) == again(7)
    assert drawn_with(rows.limit(10), "lang", 1000, 50, 5).count() == 10
    with pytest.raises(ValueError, match="more than 1 rare"):
        drawn_with(rows, "lang", 1000, 50, 1).count()


def test_a_rare_language_is_learned(spark):
    """One in ten thousand rows, which a plain sample of a few thousand would hardly hold."""
    word = lambda c, k: F.concat(*(F.element_at(F.array(*map(F.lit, c)), (F.pmod(F.xxhash64("id", F.lit(k), F.lit(j)), F.lit(len(c))) + 1).cast("int")) for j in range(3)))
    text = lambda c: F.concat_ws(" ", *(word(c, k) for k in range(12)))
    rare = F.pmod("id", F.lit(2500)) == 0
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(rare, text(["žu", "čka", "řěd"])).when(F.col("id") % 2 == 0, text(["the", "ing", "or"])).otherwise(text(["der", "sch", "ung"])).alias("text"), F.when(rare, "xx").when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    got = language.predict(rows.where("doc_id % 2500 = 0 OR doc_id % 997 = 0"), language.train(rows)).join(rows.select("doc_id", "lang"), "doc_id").collect()
    assert {r.lang for r in got} == {"xx", "en", "de"} and all(r.lang_pred == r.lang for r in got)


def slow_toxic_score(model, text):
    """Word by word and n-gram by n-gram."""
    weight = dict(zip(model.features.tolist(), model.weight.tolist(), strict=True))
    seen = set()
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        seen.add(zlib.crc32(w.encode()) % toxicity.SPACE // 2 * 2)
        for n in (3, 4, 5):
            for i in range(len(w) + 3 - n):
                seen.add(zlib.crc32(f"<{w}>"[i : i + n].encode()) % toxicity.SPACE // 2 * 2 + 1)
    return 1 / (1 + np.exp(-(model.bias + sum(weight.get(f, 0) for f in seen))))


def test_scores_equal_a_slow_reading(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "日本語" * 900, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("int")), allowMissingColumns=True)
    text = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(model.features) > 5
    for r in toxicity.score(docs, model).collect():
        assert r.score == pytest.approx(slow_toxic_score(model, text[r.doc_id]), abs=1e-9)
    lang = language.train(spark.read.parquet(f"{SF}/documents.parquet"), 400)
    for r in language.predict(docs, lang).collect():
        sums, n = np.zeros(lang.code.shape[1]), 0
        for w in re.findall(r"[^\W\d_]+", (text[r.doc_id] or "").lower()):
            for k in (1, 2, 3, 4):
                for i in range(len(w) + 3 - k):
                    sums += lang.weight[zlib.crc32(f"<{w}>"[i : i + k].encode()) % language.FEATURES]
                    n += 1
        if not n:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        f = sums / n + lang.bias
        loss = [sum(t * np.log1p(np.exp(-c * x)) for t, c, x in zip(lang.trust, code, f, strict=True)) for code in lang.code]
        p = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        assert (r.lang_pred, r.score) == (lang.languages[int(p.argmax())], pytest.approx(p.max(), abs=1e-4))


def test_prior_of_unlabelled_rows():
    g = np.random.default_rng(3)
    make = lambda n, toxic: np.hstack([(g.random((n, 6)) < (0.5 if toxic else 0.03)), g.integers(0, 2, (n, 10))]).astype(float)
    for share in (0.05, 0.3):
        n = int(3000 * share)
        x = np.vstack([make(300, True), make(n, True), make(3000 - n, False), make(600, False)])
        kind = np.repeat([1, 0, -1], [300, 3000, 600])
        assert toxicity.unlabelled_prior(x, kind, 0.15) == pytest.approx(share, abs=0.03)
    assert toxicity.unlabelled_prior(x, np.where(kind == -1, 0, kind), 0.15) == 0.15


def slow_fit(x, y, trees, depth, bins, rate, ridge, least):
    """Boosted trees that try every cut of every statistic row by row; returns the raw scores of the rows."""
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        nodes = [np.arange(len(y))]
        for _ in range(depth):
            split = []
            for rows in nodes:
                best = (1e-6, None)
                for j, cuts in enumerate(edges):
                    for c in cuts:
                        left = x[rows, j] <= c
                        hl, hr = h[rows][left].sum(), h[rows][~left].sum()
                        if hl < least or hr < least:
                            continue
                        gain = g[rows][left].sum() ** 2 / (hl + ridge) + g[rows][~left].sum() ** 2 / (hr + ridge) - g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                        if gain > best[0] + 1e-12:
                            best = (gain, left)
                split += [rows, rows[:0]] if best[1] is None else [rows[best[1]], rows[~best[1]]]
            nodes = split
        for rows in nodes:
            raw[rows] += rate * g[rows].sum() / (h[rows].sum() + ridge) if len(rows) else 0
    return 1 / (1 + np.exp(-raw))


def test_boosting_equals_a_slow_fit():
    g = np.random.default_rng(5)
    x = np.round(g.normal(size=(120, 4)), 1)
    y = (x[:, 1] - x[:, 2] + g.normal(size=120) > 0).astype(float)
    how = {"trees": 5, "depth": 2, "bins": 8, "rate": 0.3, "ridge": 1.0, "least": 2.0}
    assert np.allclose(quality.fit(x, y, **how).predict(x), slow_fit(x, y, **how), atol=1e-9)
