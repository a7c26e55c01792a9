import random

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import clinical as fn
from cohortspark.operators import agreement, audit, clinical, cohorts, endpoints, expression
from cohortspark.sources import readers


def one(spark, col_of, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", col_of(F.col("v"))).orderBy("i").collect()]


def test_clinical_text(spark):
    assert one(spark, fn.stage, ["Stage IIIA", "2b", "pT2 N0Mx", None]) == ["III", "II", None, None]
    assert one(spark, lambda c: fn.tnm(c, "T"), ["pT1b", "TIS", "2", ""]) == ["T1", "Tis", "T2", None]
    assert one(spark, lambda c: fn.tnm(c, "N"), ["N2b"]) == ["N2"]
    assert one(spark, lambda c: fn.tnm(c, "N"), ["pN0", "N4", "3", "4"]) == ["N0", None, "N3", None]
    assert one(spark, lambda c: fn.tnm_parts(c)[1], ["pT2 N0Mx", "T1", "pN2apT3"]) == ["N0", None, "N2"]
    assert one(spark, fn.age_mid, ["50-54", "61", "55,7", "60 - 69", ""]) == [52.0, 61.0, None, None, None]
    assert one(spark, fn.mutation, ["wt", "G12D", "NA", None]) == ["WT", "M", None, None]
    assert one(spark, fn.flag, ["neg", "+", "-", "yes"]) == ["0", "1", "0", None]
    assert one(spark, fn.flag_in, ["HER2 positive", "negative", "na"]) == ["1", "0", None]
    assert one(spark, fn.grade, ["low", "G9", "7", "anaplastic"]) == ["G2", "G9", "7", None]
    assert one(spark, fn.token_of_key, ["os.time", "DFI", "distant metastasis", "age"]) == ["OS", "DFS", "MFS", None]
    assert one(spark, fn.grade, ["well differentiated", "high grade", "GX"]) == ["G1", "G3", None]
    assert one(spark, fn.number, ["55,7", "1 694", "2.349 years"]) == [55.7, 1694.0, 2.349]
    assert one(spark, fn.status, ["non-recur", "recur", "Deceased", "--"]) == [0, 1, 1, None]
    assert one(spark, fn.squeezed, ["99 UNK", "#N/A", "--", " a  b "]) == [None, None, None, "a b"]
    df = spark.createDataFrame([("Deceased after 27 months",)], "v string")
    assert df.select(*fn.combined(F.col("v"))).first() == (1, 27.0, "month", "OS")
    assert one(spark, fn.event_of, ["no recurrence", "Relapse", "2", "1", "nd", ""]) == [0.0, 1.0, None, 1.0, None, None]
    cells = [("f", s, k, v) for s, k, v in [(1, "futime", "12"), (1, "os status", "dead"), (2, "futime", "9.5"), (2, "os status", "0"), (2, "os months", "9"), (1, "tumor stage", "1"), (2, "note", "relapsed at 3 months")]]
    got = clinical.screen_headers(spark.createDataFrame(cells, "file string, sample_id int, key string, value string"))
    assert {(r.sample_id, r.key, r.token, r.role, r.number) for r in got.collect()} == {
        (1, "futime", None, "time", 12.0), (1, "os status", "OS", "event", 1.0), (2, "futime", None, "time", 9.5), (2, "os status", "OS", "event", 0.0), (2, "os months", "OS", "time", 9.0),
        (2, "value_text[RFS]", "RFS", "time", 3.0), (2, "value_text[RFS]", "RFS", "event", 1.0),
    }
    assert {(r.token, r.time_key, r.event_key, r.n, r.events, r.best) for r in clinical.best_pairs(got).collect()} == {("OS", "futime", "os status", 2, 1, True), ("RFS", "value_text[RFS]", "value_text[RFS]", 1, 1, False)}


def test_signature():
    assert expression.parse_signature("0.5*GAPDH - 0.3*ACTB") == {"GAPDH": 0.5, "ACTB": -0.3}
    assert expression.parse_signature("1e-2*GAPDH + 2*ACTB") == {"GAPDH": 0.01, "ACTB": 2.0}
    assert expression.parse_signature("1*HLA-A") == {"HLA-A": 1.0}
    for bad in ("GAPDH + ACTB", "0.5*GAPDH + ", "0.5*GAPDH & 0.5*ACTB", "1*A + 2*A", ""):
        with pytest.raises(ValueError):
            expression.parse_signature(bad)
    with pytest.raises(ValueError):
        expression.parse_expression("A; drop table x")


def test_kappa(spark):
    pairs = [("A", "A")] * 20 + [("A", "B")] * 5 + [("B", "A")] * 10 + [("B", "B")] * 15
    rows = [(str(i), "f", r, x) for i, p in enumerate(pairs) for r, x in zip("12", p, strict=True)]
    got = agreement.kappa(spark.createDataFrame(rows, "record_id string, field string, rater string, rating string")).first()
    assert got.agreement == pytest.approx(0.7) and got.kappa == pytest.approx(0.4) and got.label == "fair"
    same = [(str(i), "f", r, "A") for i in range(5) for r in "12"]
    got = agreement.kappa(spark.createDataFrame(same, "record_id string, field string, rater string, rating string")).first()
    assert got.kappa is None and got.agreement == 1.0


def test_hamilton_allocation(spark):
    sizes = spark.createDataFrame([("GEO", 4), ("TCGA", 4), ("EMBL-EBI", 2)], "stratum string, size long")
    assert {r.stratum: r.seats for r in agreement.allocate(sizes, 4).collect()} == {"EMBL-EBI": 1, "GEO": 2, "TCGA": 1}
    for n in range(12):
        assert sum(r.seats for r in agreement.allocate(sizes, n).collect()) == min(n, 10)


def test_overlap_groups_and_policy(spark):
    pairs = spark.createDataFrame([("a", "b", 7), ("b", "c", 6), ("x", "y", 5)], "a string, b string, shared long")
    groups = cohorts.overlap_groups(pairs)
    assert {r.accession: r.root for r in groups.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    sel = spark.createDataFrame([("a", 5), ("b", 9), ("c", 9), ("y", None), ("q", 1)], "accession string, n int")
    got = {r.accession: r for r in cohorts.overlap_policy(sel, groups, pairs).collect()}
    assert {a for a, r in got.items() if r.kept} == {"b", "y", "q"}
    assert (got["a"].dropped_for, got["a"].shared_patients, got["a"].members) == ("b", 7, 3) and "9 samples against 5" in got["a"].reason and got["b"].reason is None
    far = {r.accession: r for r in cohorts.overlap_policy(sel.where("accession <> 'b'"), groups, pairs).collect()}
    assert (far["a"].dropped_for, far["a"].shared_patients) == ("c", None)
    warned = {r.accession: r for r in cohorts.overlap_policy(sel, groups, pairs, "warn").collect()}
    assert all(r.kept for r in warned.values()) and {a for a, r in warned.items() if r.reason} == {"a", "b", "c"}
    with pytest.raises(ValueError, match="a and b"):
        cohorts.overlap_policy(sel, groups, pairs, "refuse")
    assert cohorts.overlap_policy(sel.where("accession IN ('a', 'y', 'q')"), groups, pairs, "refuse").count() == 3
    with pytest.raises(ValueError, match="mode"):
        cohorts.overlap_policy(sel, groups, pairs, "drop")


def test_shared_pairs_with_a_title_of_5000_cohorts(spark):
    from itertools import combinations

    g = random.Random(1)
    small = [(f"s{k}", f"t{g.randrange(40)}") for k in range(30) for _ in range(25)] + [("s1", " "), ("s2", None)]
    wide = spark.range(5000).selectExpr("concat('w', id) AS accession", "explode(array('1', 'everybody', concat('p', id), concat('q', id), concat('r', id), concat('s', id div 2))) AS title")
    own = spark.createDataFrame([*small, *((a, "1") for a, _ in small)], "accession string, title string")
    sets = {}
    for a, t in [*small, *((a, "1") for a, _ in small)]:
        if t and t.strip():
            sets.setdefault(a, set()).add(t)
    for least in (3, 5):
        got = {(r.a, r.b): r.shared for r in cohorts.shared_pairs(own.unionByName(wide), least).where("a LIKE 's%' AND b LIKE 's%'").collect()}
        assert got == {(a, b): n for a, b in combinations(sorted(sets), 2) if (n := len(sets[a] & sets[b])) >= least}
    assert cohorts.shared_pairs(wide, 5).count() == 0
    assert {(r.a, r.b) for r in cohorts.shared_pairs(wide, 3).limit(3).collect()} <= {(f"w{k}", f"w{k + 1}") for k in range(0, 5000, 2)} | {(f"w{k + 1}", f"w{k}") for k in range(0, 5000, 2)}


def test_shared_pairs_equal_a_plain_count(spark, monkeypatch):
    rng = random.Random(5)
    titles = {(f"c{rng.randrange(60):03d}", f"t{min(rng.randrange(150), rng.randrange(150))}") for _ in range(1200)}
    titles |= {(f"c{k:03d}", f"t{j}") for k in range(0, 60, 7) for j in range(6)}
    by = {}
    for a, t in titles:
        by.setdefault(a, set()).add(t)
    want = sorted((a, b, len(by[a] & by[b])) for a in by for b in by if a < b and len(by[a] & by[b]) >= 5)
    assert want
    df = spark.createDataFrame(sorted(titles), "accession string, title string")
    for frequent, block in ((1000, 1024), (12, 4), (1, 7)):  # all titles; m from 1 to 5 in lists of few; m of 1
        monkeypatch.setattr(cohorts, "BLOCK", block)
        assert sorted(map(tuple, cohorts.shared_pairs(df, 5, frequent).collect())) == want


def test_invalid_survival_stops(spark):
    with pytest.raises(ValueError, match="negative time"):
        cohorts.validate(spark.createDataFrame([("A", 1, -1.0, 1)], "dataset string, sample_id int, time double, status int"))


def test_semantics_violations(spark):
    sem = spark.createDataFrame([("A", "OS", "Absent"), ("A", "OS", "Absent"), ("", "XX", None)], "accession string, family string, pooling_class string")
    got = {r.rule: r.n for r in endpoints.semantics_violations(sem).collect()}
    assert got == {"blank accession": 1, "unknown family": 1, "unknown class": 1, "repeated cohort and family": 1}


def test_sample_matching_and_log_scale(spark):
    left = spark.createDataFrame([("S-1", "x"), ("s 2", "x"), ("Q", "S-3"), ("Z", "no")], "key string, source string")
    right = spark.createDataFrame([("S-1", "1"), ("S-2", "2"), ("S-3", "3")], "key string, sample_id string")
    good, bad = clinical.match_samples(left, right)
    assert {r.key: (r.sample_id, r.how) for r in good.collect()} == {"S-1": ("1", "exact"), "s 2": ("2", "cleaned"), "Q": ("3", "source")} and [r.key for r in bad.collect()] == ["Z"]
    s = spark.createDataFrame([("D", 0.0, 0.2, 0.3217, 9.0, 15.0, 16.9442)], "dataset string, min double, q25 double, median double, q75 double, p99 double, max double")
    assert expression.verdict(s).first().verdict == "already_log"


def test_text_formats(spark, tmp_path):
    (tmp_path / "m.txt").write_text('!Series_title\t"T"\n!Sample_geo_accession\t"G1"\t"G2"\n!Sample_characteristics_ch1\t"age: 3"\t"age: 4"\n!series_matrix_table_begin\n"ID_REF"\t"G1"\t"G2"\n"p1"\t1.5\tnull\n"p2"\t2\t3\n!series_matrix_table_end\n')
    series, samples, body = readers.series_matrix(spark, str(tmp_path / "m.txt"))
    assert [(r.key, r.value) for r in series.collect()] == [("title", "T")]
    assert {(r.sample_id, r.value) for r in samples.collect()} == {("G1", "age: 3"), ("G2", "age: 4")}
    assert {(r.probe_id, r.sample_id, r.value) for r in body.collect()} == {("p1", "G1", 1.5), ("p1", "G2", None), ("p2", "G1", 2.0), ("p2", "G2", 3.0)}
    (tmp_path / "s.txt").write_text("^PLATFORM\n!platform_table_begin\nID\tSymbol\tENTREZ_GENE_ID\np1\tTP53\t7157\np2\tEGFR\t\n!platform_table_end\n")
    assert {(r.probe_id, r.gene) for r in readers.platform_table(spark, str(tmp_path / "s.txt")).collect()} == {("p1", "7157"), ("p2", None)}
    (tmp_path / "sdrf.txt").write_text("Name\tUnit\tUnit\na\tx\ty\n")
    got = readers.sdrf(spark, str(tmp_path / "sdrf.txt"))
    assert got.columns == ["file", "Name", "Unit", "Unit__1"] and got.count() == 1 and readers.pick_column(got, ["zz", "unit"]) == "Unit"
    (tmp_path / "sdrfs").mkdir()
    (tmp_path / "sdrfs/1.txt").write_text("Name\tUnit\na\tx\nb\ty\n")
    (tmp_path / "sdrfs/2.txt").write_text("Unit\tArray\tName\nz\tq\tc\n")
    assert {(r.Name, r.Unit, r.Array) for r in readers.sdrf(spark, str(tmp_path / "sdrfs")).collect()} == {("a", "x", None), ("b", "y", None), ("c", "z", "q")}
    (tmp_path / "mages").mkdir()
    for k in (1, 2):
        (tmp_path / f"mages/{k}.txt").write_text(f"Hyb\tA\nRef\tvalue\np1\t{k}\n")
    assert {(r.file[-5:], r.value) for r in readers.magetab(spark, str(tmp_path / "mages"), "value").collect()} == {("1.txt", 1.0), ("2.txt", 2.0)}
    (tmp_path / "mage.txt").write_text("Hyb\tA\tA\tA\nRef\tvalue\tcall\tvalue\np1\t1\tP\t3\n")
    assert [(r.sample_id, r.value) for r in readers.magetab(spark, str(tmp_path / "mage.txt"), "value").collect()] == [("A", 2.0)]
    (tmp_path / "u.tsv").write_text("A\tB\np1\t1\t2\np1\t9\t9\n")
    assert {(r.sample_id, r.value) for r in readers.unlabelled_matrix(spark, str(tmp_path / "u.tsv")).collect()} == {("A", 1.0), ("B", 2.0)}
    (tmp_path / "c.txt").write_text("#note\nPATIENT\tAGE\nx\t NA\ny\t 5 \n")
    assert {(r.PATIENT, r.AGE) for r in readers.portal_clinical(spark, str(tmp_path / "c.txt")).collect()} == {("x", None), ("y", "5")}
    (tmp_path / "d.csv").write_text("ID;S1\np;1,5\n")
    got = readers.decimal_comma(spark, str(tmp_path / "d.csv"))
    assert got.first().value == 1.5
    readers.write_csv(got, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1
    readers.write_curated(got.withColumn("dataset", F.lit("A")), str(tmp_path / "cur"))
    assert spark.read.parquet(str(tmp_path / "cur")).first().dataset == "A"


def test_cells_of_files_are_not_broadcast(spark, tmp_path):
    (tmp_path / "m.txt").write_text("Hyb\tA\tB\nRef\tvalue\tvalue\n" + "p\t1\t3\n" * 500)
    got = readers.magetab(spark, str(tmp_path), "value")
    assert {(r.probe_id, r.sample_id, r.value) for r in got.collect()} == {("p", "A", 1.0), ("p", "B", 3.0)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in plan and "strategy=broadcast" in plan


def test_first_names_and_counts(spark):
    rows = [("a", f"n{k % 25:02d}") for k in range(100)] + [("a", None), ("a", None), ("b", None), ("c", "é"), ("c", "z"), ("c", "z")]
    df = spark.createDataFrame(rows, "key string, x string").repartition(7)
    got = {r.key: (r.n, r.different, r.first) for r in cohorts.first_of(df, ["key"], 10).collect()}
    assert got == {"a": (102, 25, [f"n{k:02d}" for k in range(10)]), "b": (1, 0, []), "c": (3, 2, ["z", "é"])}
    assert cohorts.first_of(df.limit(0), ["key"], 10).count() == 0


def test_audit_spells_the_first_rows_and_counts_the_others(spark):
    names = [f"C{k:02d}" for k in range(9)]
    rows = spark.createDataFrame([(n, k % 2) for n in names for k in range(3)], "dataset string, status int")
    ledger = spark.createDataFrame([("X", "too small"), ("C00", None)], "dataset string, reason string")
    given = spark.createDataFrame([(n, 4) for n in names] + [("X", 5)], "dataset string, n long")
    ends = spark.createDataFrame([(n, "OS", "OS", "exact", "Exact-equivalent") for n in [*names, "X"]], "dataset string, family string, token string, token_role string, pooling_class string")
    got = {r.field: r.value for r in audit.run_audit(rows, "r", {"analysis": "km"}, ledger, given, ends).collect()}
    assert got["cohorts"] == "C00 | C01 | C02 | C03 | C04 | C05 | ... (+3 more)" and got["endpoint_family"] == "OS"
    assert got["excluded_cohorts"] == "X: too small" and got["overlap_dropped"] == got["covariates_dropped"] == "none"
    assert got["rows_dropped"] == " | ".join(f"C0{k}: 1" for k in range(6)) + " | ... (+4 more)" and (got["n_input"], got["n_analyzed"], got["n_excluded"]) == ("41", "27", "14")
