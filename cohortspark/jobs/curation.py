"""Registered queries: readers, expression, clinical curation, joins and catalog (IO, EX, CL, JN, OV, CT)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortspark.functions import clinical as fn
from cohortspark.jobs.catalog import C as CATALOG_SQL
from cohortspark.jobs.catalog import catalog
from cohortspark.jobs.survival import ONE, merged, r6
from cohortspark.jobs.survival import _fits as fits_sql
from cohortspark.operators import clinical, cohorts, cox, endpoints, expression
from cohortspark.sources import readers
from cohortspark.sources.adapters import expr, probes, surv, with_views
from cohortspark.sources.shared import kept, shared_dir

Q: dict = {}


def _q(name, fn_, sql=None):
    Q[name] = (fn_, with_views(sql) if sql else None)


# --- expression -------------------------------------------------------------------------------------------------
MAP = "mp AS (SELECT 'P' || CAST(p_partkey % 2 AS VARCHAR) AS platform, p_partkey AS probe_id, CASE WHEN p_size % 7 = 0 THEN '---' ELSE p_brand || ' /// ' || p_type END AS gene FROM part)"
XM = "xm AS (SELECT DISTINCT platform, probe_id, trim(g) AS gene FROM (SELECT platform, probe_id, unnest(string_split(gene, ' /// ')) AS g FROM mp) x WHERE trim(g) NOT IN ('', '---'))"


def raw_map(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select(F.concat(F.lit("P"), (F.col("p_partkey") % 2).cast("string")).alias("platform"), F.col("p_partkey").alias("probe_id"), F.when(F.col("p_size") % 7 == 0, "---").otherwise(F.concat("p_brand", F.lit(" /// "), "p_type")).alias("gene"))


def _genes(s, *names):
    return s.createDataFrame([(n,) for n in names], "gene string")


def _two(s):
    return s.createDataFrame([("A", "P0"), ("B", "P1"), ("C", "P9")], "accession string, platform string")


_TWO = "two(accession, platform) AS (VALUES ('A', 'P0'), ('B', 'P1'), ('C', 'P9'))"
_q("ex1_probes", lambda s, d: expression.probes_for(_genes(s, "Brand#11", "Brand#12"), expression.explode_map(raw_map(s, d)), _two(s))[0], f"WITH {MAP}, {XM}, {_TWO} SELECT accession, platform, probe_id, min(gene) AS gene FROM xm JOIN two USING (platform) WHERE gene IN ('Brand#11', 'Brand#12') GROUP BY ALL")
_q("ex1_missing", lambda s, d: expression.probes_for(_genes(s, "Brand#11", "Brand#99"), expression.explode_map(raw_map(s, d)), _two(s))[1], f"WITH {MAP}, {XM}, {_TWO}, g(gene) AS (VALUES ('Brand#11'), ('Brand#99')) SELECT accession, gene FROM two CROSS JOIN g WHERE (platform, gene) NOT IN (SELECT platform, gene FROM xm)")
for _h, _e in (("max", "max(value)"), ("min", "min(value)"), ("mean", "avg(value)"), ("median", "quantile_cont(value, 0.5)")):
    _q(f"ex2_collapse_{_h}", lambda s, d, h=_h: r6(expression.collapse(probes(s, d), h), "value"), f"SELECT dataset, sample_id, gene, round({_e}, 6) AS value FROM probes GROUP BY ALL")
_q("ex3_wide", lambda s, d: expression.wide(expr(s, d), ["Brand#11", "Brand#25"]), "SELECT dataset, sample_id, max(value) FILTER (WHERE gene = 'Brand#11') AS \"Brand#11\", max(value) FILTER (WHERE gene = 'Brand#25') AS \"Brand#25\" FROM expr GROUP BY ALL")
_q("ex4_marker", lambda s, d: expression.marker(probes(s, d), "probe_id", 7), "SELECT dataset, sample_id, max(value) AS value FROM probes WHERE probe_id = 7 GROUP BY ALL")


def _barcodes(s, d):
    k = F.col("c_custkey")
    return s.read.parquet(f"{d}/customer.parquet").select(k, F.when(k % 5 == 0, F.concat(F.lit("X-"), k)).when(k % 3 == 0, F.lit("TCGA-AB-1234")).otherwise(F.concat(F.lit("TCGA-AB-1234-"), F.lpad((k % 20).cast("string"), 2, "0"), F.lit("A"))).alias("code"))


_q("ex5_tumour", lambda s, d: _barcodes(s, d).where(expression.is_tumour(F.col("code"))), "WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'X-' || c_custkey WHEN c_custkey % 3 = 0 THEN 'TCGA-AB-1234' ELSE 'TCGA-AB-1234-' || lpad(CAST(c_custkey % 20 AS VARCHAR), 2, '0') || 'A' END AS code FROM customer) SELECT * FROM b WHERE code LIKE 'TCGA-%' AND (length(code) < 15 OR TRY_CAST(substr(code, 14, 2) AS INT) < 10)")
_W = {"Brand#11": 0.5, "Brand#12": -0.3}
_q("ex6_signature", lambda s, d: r6(expression.signature(expr(s, d), _W), "value"), "SELECT dataset, sample_id, CASE WHEN count(value) = 2 THEN round(sum(value * CASE gene WHEN 'Brand#11' THEN 0.5::DOUBLE ELSE -0.3::DOUBLE END), 6) END AS value FROM expr WHERE gene IN ('Brand#11', 'Brand#12') GROUP BY ALL")
_q("ex7_standardise", lambda s, d: r6(expression.standardise(expr(s, d))[0].select("dataset", "sample_id", "gene", "z"), "z"), "SELECT dataset, sample_id, gene, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z FROM expr WINDOW w AS (PARTITION BY dataset, gene)")
_q("ex8_symbol_mean", lambda s, d: r6(expression.collapse(probes(s, d), "mean", ["dataset", "gene"]), "value"), "SELECT dataset, gene, round(avg(value), 6) AS value FROM probes GROUP BY ALL")


def _regions(s, d):
    e = probes(s, d).select("dataset", F.col("sample_id").alias("patient"), (F.col("probe_id") % 3).alias("region"), (F.col("probe_id") % 10).alias("probe_id"), "value", F.when(F.col("probe_id") % 4 == 0, "").otherwise(F.concat(F.lit("s"), (F.col("probe_id") % 3).cast("string"))).alias("site"))
    clin = e.groupBy("dataset", "patient", "region").agg(F.min("site").alias("site"))
    return expression.regions_to_patients(e, clin, ["site"])


_RG = "rg AS (SELECT dataset, sample_id AS patient, probe_id % 3 AS region, probe_id % 10 AS probe, value, CASE WHEN probe_id % 4 = 0 THEN '' ELSE 's' || CAST(probe_id % 3 AS VARCHAR) END AS site FROM probes)"
_q("ex9_regions_expression", lambda s, d: r6(_regions(s, d)[0], "value"), f"WITH {_RG} SELECT dataset, patient, probe AS probe_id, round(avg(value), 6) AS value FROM rg GROUP BY ALL")
_q("ex9_regions_clinical", lambda s, d: _regions(s, d)[1], f"WITH {_RG}, c AS (SELECT dataset, patient, region, min(site) AS site FROM rg GROUP BY ALL) SELECT dataset, patient, arg_min(site, region) FILTER (WHERE trim(site) <> '') AS site, count(DISTINCT region) AS regions FROM c GROUP BY ALL")


def _arrays(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select(F.lit("D").alias("dataset"), F.col("o_custkey").alias("patient"), F.concat(F.lit("A"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("_Rep"), (F.col("o_orderkey") % 4).cast("string")))).alias("array"))


_q("ex10_replicate", lambda s, d: expression.first_replicate(_arrays(s, d)), "WITH a AS (SELECT 'D' AS dataset, o_custkey AS patient, 'A' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_Rep' || CAST(o_orderkey % 4 AS VARCHAR) END AS arr FROM orders) SELECT dataset, patient, arr AS \"array\" FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY coalesce(TRY_CAST(regexp_extract(arr, '_Rep([0-9]+)', 1) AS INT), 0), arr) AS r FROM a) x WHERE r = 1")


def _holes(s, d):
    return expr(s, d).withColumn("value", F.when(F.col("sample_id") % 4 != 0, F.col("value")))


_q("ex11_drop_empty", lambda s, d: expression.drop_empty_samples(_holes(s, d)).select("dataset", "sample_id").distinct(), "SELECT DISTINCT dataset, sample_id FROM expr WHERE sample_id % 4 <> 0")
_SV = """sv AS (SELECT dataset, count(DISTINCT probe_id) AS "rows", count(DISTINCT sample_id) AS "cols", min(value) AS "min", quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.99) AS p99, max(value) AS "max",
avg(CASE WHEN value = 0 THEN 1 ELSE 0 END) AS zero, avg(CASE WHEN value < 0 THEN 1 ELSE 0 END) AS negative, avg(CASE WHEN value <> 0 THEN CASE WHEN value <> floor(value) THEN 1 ELSE 0 END END) AS fraction FROM probes GROUP BY dataset)"""
_SVR = ("min", "q25", "median", "q75", "p99", "max", "zero", "negative", "fraction")
_q("ex12_survey", lambda s, d: r6(expression.survey(probes(s, d)), *_SVR), f"WITH {_SV} SELECT dataset, \"rows\", \"cols\", {', '.join(f'round({chr(34)}{c}{chr(34)}, 6) AS {chr(34)}{c}{chr(34)}' for c in _SVR)} FROM sv")


def _three(s, d):
    """Probes on their own scale, on a log scale, and shifted below zero, as three datasets."""
    p = kept(probes(s, d).select("sample_id", "probe_id", "value")).df.withColumn("dataset", F.lit("RAW"))
    return p.unionByName(p.withColumn("dataset", F.lit("LOG")).withColumn("value", F.log2(F.col("value") + 1))).unionByName(p.withColumn("dataset", F.lit("NEG")).withColumn("value", F.col("value") - 40000))


_TH = "th AS (SELECT 'RAW' AS dataset, sample_id, probe_id, value FROM probes UNION ALL SELECT 'LOG', sample_id, probe_id, log2(value + 1) FROM probes UNION ALL SELECT 'NEG', sample_id, probe_id, value - 40000 FROM probes)"
_VD = """vd AS (SELECT *, CASE WHEN mn < 0 THEN 'D1' WHEN med > 0 AND mx / med <= 50 THEN 'D2' WHEN med <= 0 AND mx <= 25 THEN 'D3' ELSE 'votes' END AS rule, (mx <= 25)::INT + (p99 <= 20)::INT + (med <= 16)::INT + (q75 - q25 <= 8)::INT AS votes FROM
(SELECT dataset, min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.99) AS p99 FROM th GROUP BY dataset) x), vv AS (SELECT *, CASE WHEN rule <> 'votes' OR votes >= 3 THEN 'already_log' ELSE 'needs_log2' END AS verdict FROM vd)"""
_q("ex13_verdict", lambda s, d: expression.verdict(expression.survey(_three(s, d), stored=True)).select("dataset", "rule", "votes", "verdict"), f"WITH {_TH}, {_VD} SELECT dataset, rule, votes, verdict FROM vv")


def _log2(s, d, names):
    three = _three(s, d)
    v = expression.verdict(expression.survey(three, stored=True))
    return expression.apply_log2(three, v, s.createDataFrame([(n,) for n in names], "dataset string"), s.createDataFrame([], "dataset string"))


_q("ex14_refusals", lambda s, d: _log2(s, d, ["NEG", "NOWHERE"])[1], f"WITH {_TH}, {_VD}, a(dataset) AS (VALUES ('NEG'), ('NOWHERE')) SELECT dataset, CASE WHEN verdict IS NULL THEN 'unknown dataset' ELSE 'already on a log scale' END AS reason FROM a LEFT JOIN vv USING (dataset) WHERE verdict IS NULL OR verdict = 'already_log'")


def _one_log2(s, d):
    p = kept(probes(s, d)).df
    v = expression.survey(p, stored=True).withColumn("verdict", F.lit("needs_log2"))
    return expression.apply_log2(p, v, s.createDataFrame([("BUILDING",)], "dataset string"), s.createDataFrame([], "dataset string"))[0].select("dataset", "sample_id", "probe_id", "value")


_q("ex14_log2", lambda s, d: r6(_one_log2(s, d), "value"), "SELECT dataset, sample_id, probe_id, round(CASE WHEN dataset = 'BUILDING' THEN log2(value + 1) ELSE value END, 6) AS value FROM probes")


def _impact(s, d):
    m = merged(s, d).where(F.col("gene") == "Brand#11")
    both = m.withColumn("gene", F.lit("raw")).unionByName(m.withColumn("gene", F.lit("log2")).withColumn("value", F.log2(F.col("value") + 1)))
    unit = cox.screen(both, scale=False).select("dataset", "gene", F.col("hr").alias("hr_unit"))
    return unit.join(cox.screen(both).select("dataset", "gene", F.col("hr").alias("hr_sd")), ["dataset", "gene"])


_q("ex15_scale_impact", lambda s, d: r6(_impact(s, d), "hr_unit", "hr_sd"), f"WITH {ONE}, two AS (SELECT dataset, unnest(['raw', 'log2']) AS gene, time, status, unnest([value, log2(value + 1)]) AS value FROM o), {fits_sql('two')} SELECT dataset, gene, round(exp(b_full / sd), 6) AS hr_unit, round(exp(b_full), 6) AS hr_sd FROM fits JOIN f2 USING (dataset, gene)")


def _ids(s, d):
    k = F.col("p_partkey")
    t = k.cast("string")
    return s.read.parquet(f"{d}/part.parquet").select(F.when(k % 4 == 0, F.concat(F.lit("ENSG"), t, F.lit(".2"))).when(k % 4 == 1, t).when(k % 4 == 2, F.concat(F.lit("NM_"), t)).otherwise(F.concat("p_brand", F.lit(" /// S"), t)).alias("id")).distinct()


def _id_map(s, d):
    k = F.col("p_partkey")
    t = k.cast("string")
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select(F.explode(F.array(F.struct(F.lit("ensembl").alias("kind"), F.concat(F.lit("ENSG"), t).alias("name"), t.alias("gene_id")), F.struct(F.lit("symbol").alias("kind"), F.concat(F.lit("S"), t).alias("name"), F.concat(F.lit("9"), t).alias("gene_id")))).alias("x")).select("x.*")


_q("ex16_to_entrez", lambda s, d: expression.to_entrez(_ids(s, d), _id_map(s, d)), "SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'ENSG' || p_partkey || '.2' WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN 'NM_' || p_partkey ELSE p_brand || ' /// S' || p_partkey END AS id, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 3 THEN '9' || p_partkey END AS gene_id FROM part")
_q("ex17_explode_map", lambda s, d: expression.explode_map(raw_map(s, d)), f"WITH {MAP}, {XM} SELECT * FROM xm")


def _old_new(s, d):
    m = expression.explode_map(raw_map(s, d))
    return m.where("probe_id % 3 <> 0"), m.where("probe_id % 2 = 0").withColumn("gene", F.concat(F.lit("N"), "gene"))


_q("ex18_extend_map", lambda s, d: expression.extend_map(*_old_new(s, d)), f"WITH {MAP}, {XM} SELECT * FROM xm WHERE probe_id % 3 <> 0 UNION ALL SELECT platform, probe_id, 'N' || gene FROM xm WHERE probe_id % 6 = 0")


def _maps(s, d):
    """Local maps of four platforms, annotated to different degrees; mirrored maps; expression row ids; platforms asked for."""
    p = s.read.parquet(f"{d}/part.parquet")
    k, z = F.col("p_partkey") % 4, F.col("p_size")
    blank = F.when(k == 0, z % 7 == 0).when(k == 1, z % 2 == 0).when(k == 2, F.lit(False)).otherwise(z % 3 != 0)
    gene = F.when(blank, "---").when(k == 2, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit(" /// "), "p_type"))
    m = p.select(F.concat(F.lit("P"), k.cast("string")).alias("platform"), F.col("p_partkey").alias("probe_id"), gene.alias("gene"))
    mirror = m.where("platform <> 'P1' AND (platform <> 'P0' OR probe_id % 5 <> 0)").unionByName(m.where("platform = 'P2'").withColumn("platform", F.lit("P8")))
    ids = m.where("platform <> 'P2'").select("platform", F.when(F.col("platform") == "P1", -F.col("probe_id")).otherwise(F.col("probe_id")).alias("probe_id"))
    return m, ids, mirror, s.createDataFrame([(f"P{x}",) for x in (0, 1, 2, 3, 8, 9)], "platform string")


_q("ex19_coverage", lambda s, d: expression.coverage(*_maps(s, d)), """WITH m AS (SELECT 'P' || CAST(p_partkey % 4 AS VARCHAR) AS platform, p_partkey AS probe_id, CASE WHEN CASE p_partkey % 4 WHEN 0 THEN p_size % 7 = 0 WHEN 1 THEN p_size % 2 = 0 WHEN 2 THEN false ELSE p_size % 3 <> 0 END THEN 0 ELSE 1 END AS named FROM part),
l AS (SELECT platform, count(*) AS probes, sum(named)::BIGINT AS annotated FROM m GROUP BY platform), r AS (SELECT platform, sum(named)::BIGINT AS mirror_annotated FROM (SELECT * FROM m WHERE platform <> 'P1' AND (platform <> 'P0' OR probe_id % 5 <> 0) UNION ALL SELECT 'P8', probe_id, named FROM m WHERE platform = 'P2') x GROUP BY platform),
a(platform) AS (VALUES ('P0'), ('P1'), ('P2'), ('P3'), ('P8'), ('P9')), j AS (SELECT a.platform, probes, annotated, round(100.0::DOUBLE * annotated / probes, 2) AS pct, CASE a.platform WHEN 'P2' THEN 'collapsed' WHEN 'P8' THEN NULL WHEN 'P9' THEN NULL ELSE 'expanded' END AS representation, CASE a.platform WHEN 'P0' THEN true WHEN 'P3' THEN true WHEN 'P1' THEN false END AS joins, mirror_annotated FROM a LEFT JOIN l USING (platform) LEFT JOIN r USING (platform)),
k AS (SELECT *, CASE WHEN mirror_annotated IS NULL THEN NULL WHEN annotated = mirror_annotated THEN 'none' WHEN mirror_annotated > annotated THEN 'mirror_newer' ELSE 'local_newer' END AS divergence, nullif(concat_ws('; ', CASE WHEN probes IS NULL THEN 'no local map' END, CASE WHEN mirror_annotated IS NULL THEN 'not in the mirror' END, CASE WHEN joins = false THEN 'no row id in the map' END, CASE WHEN pct < 60 THEN 'only ' || printf('%.2f', pct) || ' % annotated' END), '') AS gaps FROM j)
SELECT *, CASE WHEN probes IS NULL OR pct < 40 OR joins = false THEN 'insufficient-annotation' WHEN pct < 90 OR divergence <> 'none' OR gaps IS NOT NULL THEN 'usable-with-caveat' ELSE 'ok' END AS policy FROM k""")
_q("ex20_compare_maps", lambda s, d: expression.compare_maps(expression.explode_map(raw_map(s, d)), _old_new(s, d)[0]), f"WITH {MAP}, {XM} SELECT platform, count(*) AS left_pairs, count(*) FILTER (WHERE probe_id % 3 <> 0) AS right_pairs, count(*) FILTER (WHERE probe_id % 3 = 0) AS only_left, 0::BIGINT AS only_right, CASE WHEN count(*) FILTER (WHERE probe_id % 3 = 0) = 0 THEN 'same' ELSE 'differs' END AS verdict FROM xm GROUP BY platform")
_q("ex21_qc_row", lambda s, d: r6(expression.qc_row(probes(s, d), surv(s, d)), "first_time", "last_time"), "SELECT * FROM (SELECT dataset, count(DISTINCT sample_id) AS samples, count(DISTINCT probe_id) AS probes, count(DISTINCT gene) AS genes FROM probes GROUP BY dataset) a JOIN (SELECT dataset, count(*) AS endpoint_rows, sum(status)::BIGINT AS events, round(min(time), 6) AS first_time, round(max(time), 6) AS last_time FROM surv GROUP BY dataset) b USING (dataset)")


def _members(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("sample_id"), F.concat(F.lit("P"), (F.col("c_custkey") % 2).cast("string")).alias("platform"))


_q("ex22_split_platforms", lambda s, d: expression.split_platforms(probes(s, d), _members(s, d), raw_map(s, d)).select("dataset", "platform", "sample_id", "probe_id", "value"), "SELECT dataset || '_P' || CAST(sample_id % 2 AS VARCHAR) AS dataset, 'P' || CAST(sample_id % 2 AS VARCHAR) AS platform, sample_id, probe_id, value FROM probes WHERE sample_id % 2 = probe_id % 2")
_BD = ("q25", "median", "q75", "top_cut", "min", "max", "mean", "sd", "iqr", "median_z")
_BDS = "bd AS (SELECT dataset, gene, count(value) AS n, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.7) AS top_cut, min(value) AS \"min\", max(value) AS \"max\", avg(value) AS mean, stddev_samp(value) AS sd FROM expr GROUP BY ALL), hs AS (SELECT dataset, gene, sum(CASE WHEN value > median THEN 1 ELSE 0 END)::BIGINT AS high_median, sum(CASE WHEN value > top_cut THEN 1 ELSE 0 END)::BIGINT AS high_top FROM expr JOIN bd USING (dataset, gene) GROUP BY ALL), bz AS (SELECT *, q75 - q25 AS iqr, (median - avg(median) OVER w) / stddev_samp(median) OVER w AS median_z FROM bd JOIN hs USING (dataset, gene) WINDOW w AS (PARTITION BY gene))"
_q("ex23_batch", lambda s, d: r6(expression.batch_diagnostics(expr(s, d)), *_BD), f"WITH {_BDS} SELECT dataset, gene, n, missing, high_median, high_top, {', '.join(f'round({chr(34)}{c}{chr(34)}, 6) AS {chr(34)}{c}{chr(34)}' for c in _BD)} FROM bz")
_q("ex23_shift", lambda s, d: r6(expression.median_shift(expression.batch_diagnostics(expr(s, d))), "shift"), f"WITH {_BDS} SELECT gene, count(*) AS cohorts, round(max(median) - min(median), 6) AS shift FROM bz GROUP BY gene")
_q("ex24_expression", lambda s, d: r6(expression.expression_marker(expr(s, d), "Brand#11 * 2 - Brand#12 / (3 + 1)")[0], "value"), "SELECT dataset, sample_id, round(a * 2 - b / 4, 6) AS value FROM (SELECT dataset, sample_id, max(value) FILTER (WHERE gene = 'Brand#11') AS a, max(value) FILTER (WHERE gene = 'Brand#12') AS b FROM expr GROUP BY ALL) x WHERE a IS NOT NULL AND b IS NOT NULL")

# --- clinical ---------------------------------------------------------------------------------------------------
_TEXTS = {
    "stage_raw": ("Stage IIIA", "pT2 N0Mx", "2b", "IV", "unknown", "stage i", "T4N1M1", "III", "0", "early", "Stage II", "pT1bN2M0"),
    "sex_raw": ("Man", "f", "MALE", "female", "NA", "woman", "1", "2", "x", "M", "--", "men"),
    "grade_raw": ("well differentiated", "G2", "high grade", "GX", "3", "poor", "grade 4", "moderate", "unk", "low", "1", "anaplastic"),
    "status_raw": ("Dead", "alive", "non-recur", "recurrence", "1", "0", "no event", "Deceased", "N/A", "living", "no relapse", "progression"),
    "num_raw": ("55,7", "1 694", "2.349 years", "50-54", "abc", "-3", "27 months", "12", "60 - 69", "0", "3,5 y", "1 200,5"),
    "flag_raw": ("pos", "negative", "P", "n", "+", "yes", "no", "?", "Positive", "0", "1", "NA"),
    "tnm_raw": ("pT3b", "cT1", "Tis", "2", "tx", "T4D", "N2b", "pN0", "M1a", "0", "4", "N4"),
    "mut_raw": ("WT", "mutant", "wild type", "p.V600E", "none", "M", "?", "mutated", "yes", "no mutation", "", "wt"),
}


def _case(values, duck):
    body = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE p_size % 12 {body} END"


_DIRTY = "SELECT p_brand AS dataset, p_partkey AS sample_id, " + ", ".join(f"{_case(v, True)} AS {n}" for n, v in _TEXTS.items()) + " FROM part"
D = f"dt AS ({_DIRTY})"


def dirty(s, d):
    return s.sql(_DIRTY.replace("FROM part", "FROM {part}"), part=s.read.parquet(f"{d}/part.parquet"))


def _table(expr_of, name):
    """CASE text in SQL giving what the literals of a column must become."""
    values = _TEXTS[name]
    return f"CASE {name} " + " ".join(f"WHEN '{v}' THEN {expr_of[v]}" for v in dict.fromkeys(values) if v in expr_of) + " END"


# expected values by literal, written out by hand
_STAGE = {"Stage IIIA": "'III'", "2b": "'II'", "IV": "'IV'", "stage i": "'I'", "III": "'III'", "0": "'0'", "Stage II": "'II'"}
_SEX = {"Man": "'male'", "f": "'female'", "MALE": "'male'", "female": "'female'", "woman": "'female'", "M": "'male'", "men": "'male'"}
_GRADE = {"well differentiated": "'G1'", "G2": "'G2'", "high grade": "'G3'", "3": "'G3'", "poor": "'G3'", "moderate": "'G2'", "low": "'G2'", "1": "'G1'"}
_STATUS = {"Dead": "1", "alive": "0", "non-recur": "0", "recurrence": "1", "1": "1", "0": "0", "no event": "0", "Deceased": "1", "living": "0", "no relapse": "0", "progression": "1"}
_NUM = {"55,7": "55.7", "1 694": "1694", "2.349 years": "2.349", "50-54": "50", "-3": "-3", "27 months": "27", "12": "12", "60 - 69": "60", "0": "0", "3,5 y": "3", "1 200,5": "1200"}
_AGE = {"50-54": "52", "-3": "-3", "12": "12", "0": "0"}
_FLAG = {"pos": "'1'", "negative": "'0'", "P": "'1'", "n": "'0'", "+": "'1'", "Positive": "'1'", "0": "'0'", "1": "'1'"}
_MUT = {"WT": "'WT'", "mutant": "'M'", "wild type": "'M'", "p.V600E": "'M'", "none": "'M'", "M": "'M'", "?": "'M'", "mutated": "'M'", "yes": "'M'", "no mutation": "'M'", "wt": "'WT'"}
_T = {"pT2 N0Mx": "'T2'", "T4N1M1": "'T4'", "pT1bN2M0": "'T1'"}
_N = {"pT2 N0Mx": "'N0'", "T4N1M1": "'N1'", "pT1bN2M0": "'N2'"}
_MM = {"pT2 N0Mx": "'MX'", "T4N1M1": "'M1'", "pT1bN2M0": "'M0'"}
_TV = {"pT3b": "'T3'", "cT1": "'T1'", "Tis": "'Tis'", "2": "'T2'", "tx": "'TX'", "T4D": "NULL", "0": "'T0'", "4": "'T4'"}
_NV = {"N2b": "'N2'", "pN0": "'N0'", "2": "'N2'", "0": "'N0'"}
_MV = {"M1a": "'M1'", "0": "'M0'"}
for _n, _f, _col, _tab, _kind in (
    ("cl4_status", fn.status, "status_raw", _STATUS, "INT"), ("cl7_number", fn.number, "num_raw", _NUM, "DOUBLE"), ("cl8_age_mid", fn.age_mid, "num_raw", _AGE, "DOUBLE"), ("cl10_stage", fn.stage, "stage_raw", _STAGE, "VARCHAR"),
    ("cl13_sex", fn.sex, "sex_raw", _SEX, "VARCHAR"), ("cl13_grade", fn.grade, "grade_raw", _GRADE, "VARCHAR"), ("cl13_flag", fn.flag, "flag_raw", _FLAG, "VARCHAR"), ("cl13_mutation", fn.mutation, "mut_raw", _MUT, "VARCHAR"),
):
    _q(_n, lambda s, d, f=_f, c=_col: dirty(s, d).select("sample_id", f(F.col(c)).alias("value")), f"WITH {D} SELECT sample_id, CAST({_table(_tab, _col)} AS {_kind}) AS value FROM dt")
_q("cl12_tnm_parts", lambda s, d: dirty(s, d).select("sample_id", *fn.tnm_parts(F.col("stage_raw"))), f"WITH {D} SELECT sample_id, {_table(_T, 'stage_raw')} AS t_part, {_table(_N, 'stage_raw')} AS n_part, {_table(_MM, 'stage_raw')} AS m_part FROM dt")
for _p, _vals in {"T": _TV, "N": _NV, "M": _MV}.items():
    _q(f"cl11_{_p.lower()}", lambda s, d, p=_p: dirty(s, d).select("sample_id", fn.tnm(F.col("tnm_raw"), p).alias("value")), f"WITH {D} SELECT sample_id, {_table(_vals, 'tnm_raw')} AS value FROM dt")
_q("cl9_missing", lambda s, d: dirty(s, d).select("sample_id", fn.squeezed(F.col("sex_raw")).alias("a"), fn.squeezed(F.col("flag_raw")).alias("b")), f"WITH {D} SELECT sample_id, CASE WHEN sex_raw NOT IN ('NA', '--') THEN sex_raw END AS a, CASE WHEN flag_raw NOT IN ('?', 'NA') THEN flag_raw END AS b FROM dt")
_q("cl5_years", lambda s, d: r6(dirty(s, d).select("sample_id", fn.years(F.col("sample_id").cast("double") - 5, F.when(F.col("sample_id") % 2 == 0, "days").otherwise("months")).alias("y"), fn.years(F.col("sample_id").cast("double"), "day", 365.0).alias("z")), "y", "z"), f"WITH {D} SELECT sample_id, round(CASE WHEN sample_id % 2 = 0 THEN greatest(sample_id - 5, 0)::DOUBLE / 365.25::DOUBLE ELSE greatest(sample_id - 5, 0)::DOUBLE / 12 END, 6) AS y, round(sample_id::DOUBLE / 365, 6) AS z FROM dt")
_q("cl6_date_months", lambda s, d: r6(s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", fn.event_years(F.col("l_shipdate"), F.col("l_receiptdate"), F.col("l_commitdate"), (F.col("l_returnflag") == "R").cast("int")).alias("y")), "y") if "l_receiptdate" in s.read.parquet(f"{d}/lineitem.parquet").columns else r6(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", fn.event_years(F.lit("1990-01-01"), F.col("o_orderdate"), F.lit("2000-01-01"), F.col("o_orderkey") % 2).alias("y")), "y"),
   "SELECT o_orderkey, round((CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderdate AS DATE) - DATE '1990-01-01' ELSE DATE '2000-01-01' - DATE '1990-01-01' END)::DOUBLE / 30.4375::DOUBLE / 12, 6) AS y FROM orders")
_SPEC = {"filter": "sample_id % 2 = 0", "id": "sample_id", "endpoints": {"OS": ("num_raw", "month", "status_raw")}, "clinical": {"stage": ("stage_raw", "stage"), "sex": ("sex_raw", "sex")}}
_q("cl1_build_survival", lambda s, d: r6(clinical.build_survival(dirty(s, d), _SPEC), "OS_time"), f"WITH {D} SELECT CAST(sample_id AS VARCHAR) AS id, round(CASE WHEN {_table(_NUM, 'num_raw')} < 0 THEN 0 ELSE {_table(_NUM, 'num_raw')} END::DOUBLE / 12, 6) AS \"OS_time\", {_table(_STATUS, 'status_raw')}::INT AS \"OS_status\", {_table(_STAGE, 'stage_raw')} AS stage, {_table(_SEX, 'sex_raw')} AS sex FROM dt WHERE sample_id % 2 = 0")


def _cells(s, d):
    x = dirty(s, d)
    return x.select("sample_id", F.concat(F.lit("stage: "), "stage_raw", F.lit("; sex = "), "sex_raw", F.lit(";[grade=G1 (low)];stage: second")).alias("cell"))


_q("cl2_key_values", lambda s, d: clinical.key_values(_cells(s, d)), f"WITH {D} SELECT sample_id, unnest(['stage', 'sex', 'grade']) AS key, unnest([stage_raw || '; second', sex_raw, 'G1 (low)']) AS value FROM dt")
_q("cl2_key_columns", lambda s, d: clinical.key_columns(clinical.key_values(_cells(s, d)), ["sex", "grade"]), f"WITH {D} SELECT sample_id, sex_raw AS sex, 'G1 (low)' AS grade FROM dt")
_q("cl3_described", lambda s, d: clinical.described(dirty(s, d).select("sample_id", F.concat(F.lit("age: "), (F.col("sample_id") % 80).cast("string"), F.lit(", 120 days, class=B2, status: dead")).alias("description"))), f"WITH {D} SELECT sample_id, (sample_id % 80)::INT AS age, 120 AS days, 'B2' AS class, 1 AS status FROM dt")
_q("cl14_first_filled", lambda s, d: dirty(s, d).select("sample_id", fn.first_filled(F.col("sex_raw"), F.col("flag_raw")).alias("v")), f"WITH {D} SELECT sample_id, coalesce(CASE WHEN sex_raw NOT IN ('NA', '--') THEN sex_raw END, CASE WHEN flag_raw NOT IN ('?', 'NA') THEN flag_raw END) AS v FROM dt")


def _clean(s, d):
    return dirty(s, d).select("dataset", "sample_id", fn.stage(F.col("stage_raw")).alias("stage_raw"), fn.sex(F.col("sex_raw")).alias("sex_raw"))


_q("cl15_change_log", lambda s, d: clinical.change_log(dirty(s, d), _clean(s, d), ["stage_raw", "sex_raw"]), f"WITH {D}, c AS (SELECT dataset, 'stage_raw' AS \"column\", stage_raw AS old, {_table(_STAGE, 'stage_raw')} AS new FROM dt UNION ALL SELECT dataset, 'sex_raw', sex_raw, {_table(_SEX, 'sex_raw')} FROM dt) SELECT dataset, \"column\", sum(CASE WHEN old IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_before, sum(CASE WHEN new IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_after, sum(CASE WHEN old IS DISTINCT FROM new THEN 1 ELSE 0 END)::BIGINT AS changed FROM c GROUP BY ALL")
_q("cl15_unmapped", lambda s, d: clinical.unmapped(dirty(s, d), "stage_raw", fn.stage(F.col("stage_raw"))), f"WITH {D} SELECT stage_raw AS value, count(*) AS n FROM dt WHERE {_table(_STAGE, 'stage_raw')} IS NULL AND stage_raw IS NOT NULL GROUP BY ALL")
_q("cl16_t_table", lambda s, d: clinical.t_table(dirty(s, d).select("dataset", fn.tnm_parts(F.col("stage_raw"))[0].alias("t"), F.when(F.col("dataset") < "Brand#3", fn.stage(F.col("stage_raw"))).alias("stage"))), f"WITH {D}, t AS (SELECT dataset, {_table(_T, 'stage_raw')} AS t, CASE WHEN dataset < 'Brand#3' THEN {_table(_STAGE, 'stage_raw')} END AS stage FROM dt) SELECT dataset, count(*) AS n, count(stage) AS stage_filled, " + ", ".join(f"count(CASE WHEN t = '{x}' THEN 1 END) AS \"{x}\"" for x in clinical.T_LEVELS) + ", count(*) - count(t) AS no_t, CASE WHEN count(stage) > 0 THEN 'stage first, T for sensitivity' ELSE 'T only' END AS advice FROM t GROUP BY dataset")


def _domain(s, d):
    none = F.lit(None).cast("string")
    return dirty(s, d).select("dataset", F.col("sample_id").cast("double").alias("time"), (F.col("sample_id") % 300 / 299).cast("int").alias("status"), F.col("stage_raw").alias("stage"), none.alias("t"), none.alias("n"), none.alias("m"), fn.sex(F.col("sex_raw")).alias("sex"), none.alias("grade"), (F.col("sample_id") % 130).alias("age")).where("stage IN ('III', 'IV', '0') OR dataset < 'Brand#2'")


_q("cl17_domain", lambda s, d: clinical.domain_violations(_domain(s, d)), f"WITH {D}, x AS (SELECT dataset, stage_raw AS stage, sample_id % 130 AS age FROM dt WHERE stage_raw IN ('III', 'IV', '0') OR dataset < 'Brand#2'), g AS (SELECT dataset, max(CASE WHEN age > 120 THEN 1 ELSE 0 END) AS a, max(CASE WHEN stage NOT IN ('0', 'I', 'II', 'III', 'IV') THEN 1 ELSE 0 END) AS b FROM x GROUP BY dataset) SELECT dataset, CASE WHEN coalesce(a, 0) + coalesce(b, 0) = 0 THEN 'OK' ELSE 'ISSUE' END AS verdict, concat_ws('; ', CASE WHEN a = 1 THEN 'age outside 0-120' END, CASE WHEN b = 1 THEN 'stage' END) AS detail FROM g")


def _project(s, d):
    v = surv(s, d)
    clin = v.select(F.col("sample_id").alias("sample"), F.col("dataset").alias("type"), F.when(F.col("sample_id") % 2 == 0, "MALE").otherwise("FEMALE").alias("gender"))
    return clinical.project_table(clin, v.select(F.col("sample_id").alias("sample"), F.col("status").alias("OS"), F.round(F.col("time") * 365.25).alias("OS_days"), F.when(F.col("cr_status") < 2, F.col("cr_status")).otherwise(9).alias("PFI"), F.round(F.col("cr_time") * 365.25).alias("PFI_days")), ["OS", "PFI"])


_q("cl18_project_table", lambda s, d: r6(_project(s, d)[0], "OS_time", "PFI_time"), "SELECT sample_id AS sample, dataset AS type, CASE WHEN sample_id % 2 = 0 THEN 'male' ELSE 'female' END AS sex, round(time, 6) AS \"OS_time\", status AS \"OS_status\", round(cr_time, 6) AS \"PFI_time\", CASE WHEN cr_status < 2 THEN cr_status END AS \"PFI_status\" FROM surv")
_q("cl18_usable", lambda s, d: _project(s, d)[1], "SELECT 'OS' AS token, sum(CASE WHEN time > 0 THEN status ELSE 0 END)::BIGINT AS events, count(*) AS n FROM surv UNION ALL SELECT 'PFI', sum(CASE WHEN cr_time > 0 AND cr_status < 2 THEN cr_status ELSE 0 END)::BIGINT, sum(CASE WHEN cr_status < 2 THEN 1 ELSE 0 END)::BIGINT FROM surv")
_q("cl19_valid", lambda s, d: clinical.valid_survival(surv(s, d)).groupBy("dataset").agg(F.count(F.lit(1)).alias("n")), "SELECT dataset, count(*) AS n FROM surv WHERE status IN (0, 1) AND time > 0 GROUP BY dataset")
_q("cl20_evident_types", lambda s, d: clinical.evident_types(dirty(s, d).select("dataset", F.explode(F.array(F.struct(F.lit("size").alias("column"), F.col("sample_id").cast("string").alias("value")), F.struct(F.lit("sex").alias("column"), F.col("sex_raw").alias("value")))).alias("x")).select("dataset", "x.*"), 5), f"WITH {D}, l AS (SELECT dataset, 'size' AS \"column\", CAST(sample_id AS VARCHAR) AS value FROM dt UNION ALL SELECT dataset, 'sex', sex_raw FROM dt), g AS (SELECT dataset, \"column\", count(value) AS n, count(TRY_CAST(value AS DOUBLE)) AS parsed, count(DISTINCT value) AS levels FROM l GROUP BY ALL) SELECT *, CASE WHEN n = parsed THEN 'numeric' WHEN levels > 5 THEN 'too many levels' ELSE 'categorical' END AS type FROM g WHERE n > 0")


def _supp(s, d):
    v = surv(s, d).select("sample_id", "time")
    return clinical.supplement(v.where("sample_id % 3 <> 0"), v.where("sample_id % 2 = 0").select("sample_id", (F.col("sample_id") % 7).alias("extra")), ["extra"])


_q("cl21_supplement", lambda s, d: r6(_supp(s, d), "time"), "SELECT sample_id, CASE WHEN sample_id % 3 <> 0 THEN round(time, 6) END AS time, CASE WHEN sample_id % 2 = 0 THEN sample_id % 7 END AS extra FROM surv WHERE sample_id % 3 <> 0 OR sample_id % 2 = 0")


def _match(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    t = k.cast("string")
    right = c.where(k % 5 != 0).select(F.concat(F.lit("S-"), t).alias("key"), t.alias("sample_id"))
    left = c.select(F.when(k % 3 == 0, F.concat(F.lit("S-"), t)).when(k % 3 == 1, F.concat(F.lit("s_"), t)).otherwise(F.concat(F.lit("Q"), t)).alias("key"), F.when(k % 2 == 0, F.concat(F.lit("S-"), t)).otherwise("none").alias("source"))
    return clinical.match_samples(left, right)


_MS = "l AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'S-' WHEN 1 THEN 's_' ELSE 'Q' END || c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'exact' WHEN c_custkey % 3 = 1 THEN 'cleaned' WHEN c_custkey % 2 = 0 THEN 'source' END AS how FROM customer)"
_q("cl22_match", lambda s, d: _match(s, d)[0], f"WITH {_MS} SELECT key, CAST(k AS VARCHAR) AS sample_id, how FROM l WHERE how IS NOT NULL")
_q("cl22_unmatched", lambda s, d: _match(s, d)[1], f"WITH {_MS} SELECT key FROM l WHERE how IS NULL")


def _headers(s, d):
    v = surv(s, d)
    cell = lambda k, x: F.struct(F.lit(k).alias("key"), x.cast("string").alias("value"))
    return v.select(F.col("dataset").alias("file"), "sample_id", F.explode(F.array(cell("overall survival months", F.round(F.col("time") * 12, 1)), cell("vital status", F.when(F.col("status") == 1, "dead").otherwise("alive")), cell("relapse event", F.when(F.col("sample_id") % 2 == 0, F.col("cr_status").cast("string"))), cell("rfs time", F.when(F.col("sample_id") % 3 == 0, F.round("cr_time", 2))), cell("drug response time", F.lit("3")), cell("colour", F.lit("red")))).alias("x")).select("file", "sample_id", "x.*").where("value IS NOT NULL")


_q("cl23_screen", lambda s, d: clinical.screen_headers(_headers(s, d)).select("file", "sample_id", "key", "token", "role"),
   """SELECT dataset AS file, sample_id, 'overall survival months' AS key, 'OS' AS token, 'time' AS role FROM surv UNION ALL SELECT dataset, sample_id, 'overall survival months', 'OS', 'event' FROM surv WHERE round(time * 12, 1) IN (0, 1)
UNION ALL SELECT dataset, sample_id, 'vital status', 'OS', 'event' FROM surv UNION ALL SELECT dataset, sample_id, 'relapse event', 'RFS', 'event' FROM surv WHERE sample_id % 2 = 0 AND cr_status < 2 UNION ALL SELECT dataset, sample_id, 'rfs time', 'RFS', 'time' FROM surv WHERE sample_id % 3 = 0""")
_TIED = (
    ("os months", "OS", "time", "round(time * 12, 1)"), ("vital status", "OS", "event", "status"), ("last visit", None, "time", "round(time * 12, 1)"), ("annum", None, "time", "round(time, 2)"), ("survival years", None, "time", "round(time, 2)"),
    ("relapse event", "RFS", "event", "CASE WHEN sample_id % 2 = 0 AND cr_status < 2 THEN cr_status END"), ("rfs time", "RFS", "time", "CASE WHEN sample_id % 3 = 0 THEN round(cr_time, 2) END"), ("flag", "OS", "time", "sample_id % 2"), ("pfs", "PFS", "event", "CASE WHEN dataset = 'MACHINERY' THEN 1 - status END"),
)


def _tied_cells(s, d):
    """Screened cells with keys that as many samples have: a token's own and generic ones, with and without a word that hints at survival."""
    cells = [f"named_struct('key', '{k}', 'token', {'NULL' if t is None else repr(t)}, 'role', '{r}', 'number', CAST({x} AS DOUBLE))" for k, t, r, x in _TIED]
    return surv(s, d).select(F.col("dataset").alias("file"), "sample_id", F.explode(F.expr(f"array({', '.join(cells)})")).alias("x")).select("file", "sample_id", "x.*").where("number IS NOT NULL")


_TIED_PAIRS = f"""cells AS ({' UNION ALL '.join(f"SELECT dataset AS file, sample_id, '{k}' AS key, {'NULL' if t is None else repr(t)} AS token, '{r}' AS role, ({x})::DOUBLE AS number FROM surv" for k, t, r, x in _TIED)}),
have AS (SELECT * FROM cells WHERE number IS NOT NULL), toks AS (SELECT DISTINCT file, token AS t FROM have WHERE token IS NOT NULL),
bags AS (SELECT h.file, t AS token, key, role, sample_id, number, (token IS NULL)::INT AS generic FROM have h JOIN toks ON toks.file = h.file AND (token IS NULL OR token = t)),
timely AS (SELECT file, token, key FROM bags WHERE role = 'time' GROUP BY ALL HAVING max((number NOT IN (0, 1))::INT) = 1),
pairs AS (SELECT a.file, a.token, a.key AS time_key, b.key AS event_key, count(*) AS n, sum(b.number)::BIGINT AS events, max(a.generic + b.generic) AS generic FROM (SELECT * FROM bags JOIN timely USING (file, token, key) WHERE role = 'time') a JOIN (SELECT * FROM bags WHERE role = 'event') b USING (file, token, sample_id) GROUP BY ALL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY file, token ORDER BY n DESC, generic, regexp_matches(time_key, '{fn.SURVIVAL_HINT}')::INT + regexp_matches(event_key, '{fn.SURVIVAL_HINT}')::INT DESC, time_key, event_key) AS r FROM pairs)
SELECT file, token, time_key, event_key, n, events, row_number() OVER (PARTITION BY file ORDER BY n DESC, events DESC, token) = 1 AS best FROM firsts WHERE r = 1"""
_q("cl24_best_pairs", lambda s, d: clinical.best_pairs(clinical.screen_headers(_headers(s, d))), "SELECT dataset AS file, 'OS' AS token, 'overall survival months' AS time_key, 'vital status' AS event_key, count(*) AS n, sum(status)::BIGINT AS events, true AS best FROM surv GROUP BY dataset UNION ALL SELECT dataset, 'RFS', 'rfs time', 'relapse event', count(*), sum(cr_status)::BIGINT, false FROM surv WHERE sample_id % 6 = 0 AND cr_status < 2 GROUP BY dataset")
_q("cl24_tied_pairs", lambda s, d: clinical.best_pairs(_tied_cells(s, d)), f"WITH {_TIED_PAIRS}")
_q("cl25_candidates", lambda s, d: clinical.candidates(catalog(s, d).select("accession", F.when(F.col("n") % 2 == 0, F.col("platform")).otherwise("GPL9").alias("platform"), F.col("n").alias("effective_n")), catalog(s, d).where("accession < 'NATION_2'"), 60), f"WITH {CATALOG_SQL}, f AS (SELECT accession, CASE WHEN n % 2 = 0 THEN platform ELSE 'GPL9' END AS platform, n AS effective_n FROM cat), k AS (SELECT accession, platform AS known FROM cat WHERE accession < 'NATION_2') SELECT accession, f.platform, effective_n, coalesce(known <> f.platform, false) AS platform_mismatch, CASE WHEN effective_n <= 60 THEN 'too few samples' WHEN known = f.platform THEN 'in catalog' END AS reason FROM f LEFT JOIN k USING (accession)")
_TITLES = ("Breast cancer relapse", "Lung adenocarcinoma cohort", "Glioblastoma series", "Gene atlas", "Colorectal metastasis")
_q("cl26_cancer", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", fn.cancer_of(F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("type")), "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Breast' WHEN 1 THEN 'Lung' WHEN 4 THEN 'Colorectal' ELSE 'unknown' END AS type FROM part")


def _studies(s, d):
    return catalog(s, d).select("accession", F.substring("type", 1, 4).alias("series"), F.concat(F.lit("Study "), F.upper(F.substring("accession", -1, 1)), F.lit("!")).alias("title"), "n")


def _super(s, d):
    """Every tenth-sized cohort stands for a super-series of two others' series."""
    return catalog(s, d).where("n % 10 = 0").select("accession", F.explode(F.array(F.lit("ASIA"), F.lit("NONE"))).alias("part"))


_q("cl27_admitted", lambda s, d: clinical.admitted(_studies(s, d), _super(s, d)), f"WITH {CATALOG_SQL}, x AS (SELECT accession, substr(type, 1, 4) AS series, right(accession, 1) AS t, n FROM cat), y AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, accession) AS a, row_number() OVER (PARTITION BY series ORDER BY n DESC, accession) AS b, n % 10 = 0 AND (SELECT max(n) FROM x z WHERE z.series = 'ASIA') > 50 AS c FROM x) SELECT accession, series, n, a = 1 AND b = 1 AND NOT c AS admitted, nullif(concat_ws('; ', CASE WHEN a > 1 THEN 'same title as a larger cohort' END, CASE WHEN b > 1 THEN 'another platform of the series' END, CASE WHEN c THEN 'super-series of listed series' END), '') AS reason FROM y")


def _restore(s, d):
    v = surv(s, d)
    rows = v.select("dataset", F.col("sample_id").alias("row_no"), F.when(F.col("sample_id") % 4 != 0, F.col("nation")).alias("check_value"))
    return clinical.restore_ids(rows, v.select("dataset", F.col("sample_id").alias("row_no"), F.concat(F.lit("S"), F.col("sample_id").cast("string")).alias("sample_id"), F.when((F.col("dataset") == "BUILDING") & (F.col("nation") == 3), 99).otherwise(F.col("nation")).alias("check_value")))


_q("cl28_restore", lambda s, d: _restore(s, d)[1], "WITH j AS (SELECT dataset, CASE WHEN sample_id % 4 <> 0 THEN nation END AS x, CASE WHEN dataset = 'BUILDING' AND nation = 3 THEN 99 ELSE nation END AS y FROM surv) SELECT dataset, count(*) AS \"rows\", count(*) AS matched, count(x) AS comparable, sum(CASE WHEN x = y THEN 1 ELSE 0 END)::BIGINT AS agree, count(x) > 0 AND count(x) = sum(CASE WHEN x = y THEN 1 ELSE 0 END) AS restored FROM j GROUP BY dataset")

# --- joins, overlap, catalog ------------------------------------------------------------------------------------
_q("jn1_counts", lambda s, d: cohorts.merge(surv(s, d).where("sample_id % 7 <> 0"), expr(s, d))[1], "WITH a AS (SELECT DISTINCT dataset, sample_id FROM surv WHERE sample_id % 7 <> 0), b AS (SELECT DISTINCT dataset, sample_id FROM expr) SELECT coalesce(a.dataset, b.dataset) AS dataset, count(a.sample_id) AS survival, count(b.sample_id) AS expression, sum(CASE WHEN a.sample_id = b.sample_id THEN 1 ELSE 0 END)::BIGINT AS \"both\" FROM a FULL JOIN b ON a.dataset = b.dataset AND a.sample_id = b.sample_id GROUP BY 1")
_q("jn1_problems", lambda s, d: cohorts.survival_problems(surv(s, d).withColumn("status", F.when(F.col("sample_id") % 50 == 0, 3).otherwise(F.col("status"))).withColumn("time", F.when(F.col("sample_id") % 70 == 0, -1.0).otherwise(F.col("time")))), "SELECT dataset, 'status not 0/1' AS problem, count(*) AS n FROM surv WHERE sample_id % 50 = 0 GROUP BY dataset UNION ALL SELECT dataset, 'negative time', count(*) FROM surv WHERE sample_id % 70 = 0 GROUP BY dataset")
_q("jn2_merged", lambda s, d: r6(cohorts.merged_cohort(surv(s, d).select("dataset", "sample_id", "time", "status"), probes(s, d), ["Brand#11"], surv(s, d).select("dataset", "sample_id", "nation")), "time"), "SELECT s.dataset, s.sample_id, round(time, 6) AS time, status, gene, value, nation FROM surv s JOIN expr e ON e.dataset = s.dataset AND e.sample_id = s.sample_id WHERE gene = 'Brand#11'")
_q("jn3_marker_counts", lambda s, d: cohorts.marker_counts(surv(s, d).withColumn("status", F.when(F.col("sample_id") % 9 != 0, F.col("status"))), expression.marker(expr(s, d), "gene", "Brand#11")), "WITH m AS (SELECT * FROM expr WHERE gene = 'Brand#11') SELECT s.dataset, sum(CASE WHEN s.sample_id % 9 <> 0 AND value IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN s.sample_id % 9 = 0 THEN 1 ELSE 0 END)::BIGINT AS no_endpoint, sum(CASE WHEN s.sample_id % 9 <> 0 AND value IS NULL THEN 1 ELSE 0 END)::BIGINT AS no_marker FROM surv s LEFT JOIN m ON m.dataset = s.dataset AND m.sample_id = s.sample_id GROUP BY s.dataset")
_q("jn4_complete", lambda s, d: cohorts.complete_cases(surv(s, d).withColumn("age", F.when(F.col("sample_id") % 4 != 0, F.col("nation"))), ["age"])[1], "SELECT dataset, sum(CASE WHEN sample_id % 4 <> 0 THEN 1 ELSE 0 END)::BIGINT AS used, sum(CASE WHEN sample_id % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS dropped FROM surv GROUP BY dataset")


def _titles(s, d):
    return probes(s, d).select(F.lpad(F.col("probe_id").cast("string"), 8, "0").alias("accession"), F.col("sample_id").cast("string").alias("title"))


def _pairs(s, d):
    return cohorts.shared_pairs(_titles(s, d))


_TT = "tt AS (SELECT DISTINCT lpad(CAST(probe_id AS VARCHAR), 8, '0') AS accession, sample_id AS title FROM probes), pr AS (SELECT a.accession AS a, b.accession AS b, count(*) AS shared FROM tt a JOIN tt b ON a.title = b.title AND a.accession < b.accession GROUP BY ALL HAVING count(*) >= 5)"
_CC = "ed AS (SELECT a AS x, b AS y FROM pr UNION SELECT b, a FROM pr), rc(x, y) AS (SELECT x, x FROM ed UNION SELECT rc.x, ed.y FROM rc JOIN ed ON ed.x = rc.y), gp AS (SELECT x AS accession, min(y) AS root FROM rc GROUP BY x)"
_q("ov1_shared_pairs", _pairs, f"WITH {_TT} SELECT * FROM pr")
_q("ov2_series_pairs", lambda s, d: cohorts.series_pairs(catalog(s, d).select(F.col("type").alias("base"), "accession", "n")), f"WITH {CATALOG_SQL} SELECT x.accession AS a, y.accession AS b, least(x.n, y.n) AS shared FROM cat x JOIN cat y ON x.type = y.type AND x.accession < y.accession")


def _register(s, d):
    p = _pairs(s, d)
    turned = p.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared")
    seed = turned.withColumn("shared", F.lit(99).cast("long")).unionByName(s.createDataFrame([("zz", "aa", 5)], "a string, b string, shared long"))
    return cohorts.register([("title", p), ("seed", seed)], turned.where("shared % 2 = 0").select("a", "b"))


_q("ov3_register", _register, f"WITH {_TT} SELECT a, b, shared, 'title' AS basis FROM pr WHERE shared % 2 <> 0 UNION ALL SELECT 'aa', 'zz', 5, 'seed'")
_q("ov4_groups", lambda s, d: cohorts.group_labels(cohorts.overlap_groups(_pairs(s, d))), f"WITH RECURSIVE {{views}}, {_TT}, {_CC} SELECT accession, root, root || '(+' || CAST(count(*) OVER (PARTITION BY root) - 1 AS VARCHAR) || ')' AS label FROM gp")
_q("ov5_pairs_inside", lambda s, d: cohorts.pairs_inside(_pairs(s, d), _selected(s, d).where("n IS NOT NULL")).select("a", "b", "shared"), f"WITH {_TT} SELECT * FROM pr WHERE a::INT % 5 <> 0 AND b::INT % 5 <> 0")


def _selected(s, d):
    return _titles(s, d).groupBy("accession").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.col("accession") % 5 != 0, F.col("n")))


_SEL = "se AS (SELECT lpad(CAST(probe_id AS VARCHAR), 8, '0') AS accession, CASE WHEN probe_id % 5 <> 0 THEN count(*) END AS n FROM probes GROUP BY probe_id)"
_POLICY = f"{_TT}, {_CC}, {_SEL}, j AS (SELECT accession, n, coalesce(root, accession) AS root FROM se LEFT JOIN gp USING (accession)), r AS (SELECT *, row_number() OVER w AS r, first_value(accession) OVER w AS winner, first_value(n) OVER w AS most, count(*) OVER (PARTITION BY root) AS members FROM j WINDOW w AS (PARTITION BY root ORDER BY n DESC NULLS LAST, accession))"


def _policy(s, d, mode):
    p = _pairs(s, d)
    return cohorts.overlap_policy(_selected(s, d), cohorts.overlap_groups(p), p, mode)


_q("ov6_policy", lambda s, d: _policy(s, d, "dedupe"), f"WITH RECURSIVE {{views}}, {_POLICY} SELECT accession, r.n, root, members, r = 1 AS kept, CASE WHEN r > 1 THEN winner END AS dropped_for, CASE WHEN r > 1 THEN shared END AS shared_patients, CASE WHEN r > 1 THEN 'shares patients with ' || winner || ': ' || coalesce(CAST(most AS VARCHAR), 'unknown') || ' samples against ' || coalesce(CAST(r.n AS VARCHAR), 'unknown') END AS reason FROM r LEFT JOIN pr ON pr.a = least(accession, winner) AND pr.b = greatest(accession, winner)")
_q("ov6_warned", lambda s, d: _policy(s, d, "warn"), f"WITH RECURSIVE {{views}}, {_POLICY} SELECT accession, n, root, members, true AS kept, CAST(NULL AS VARCHAR) AS dropped_for, CAST(NULL AS BIGINT) AS shared_patients, CASE WHEN members > 1 THEN 'other selected cohorts share its patients' END AS reason FROM r")
_q("ov7_hit_twice", lambda s, d: cohorts.groups_hit_twice(_selected(s, d), cohorts.overlap_groups(_pairs(s, d))), f"WITH RECURSIVE {{views}}, {_TT}, {_CC}, {_SEL} SELECT root, count(*) AS n, string_agg(accession, ', ' ORDER BY accession) AS cohorts, 'shares patients: ' || string_agg(accession, ', ' ORDER BY accession) AS note FROM se JOIN gp USING (accession) GROUP BY root HAVING count(*) > 1")
# a catalog with a guarded row, one without expression, one without a primary endpoint and one without any table
FAMS = ["OS", "DFS"]
_NAME = "CASE dataset WHEN 'MACHINERY' THEN 'TCGA-MACHINERY' ELSE dataset END"


def _named(df):
    return df.withColumn("dataset", F.expr(_NAME))


def _long(s, d):
    """Survival rows by token, with holes."""
    v = surv(s, d)
    os = v.select("dataset", "sample_id", F.lit("OS").alias("token"), "time", F.when(F.col("sample_id") % 9 != 0, F.col("status")).alias("status"))
    rfs = v.where("dataset <> 'MACHINERY'").select("dataset", "sample_id", F.lit("RFS").alias("token"), F.when(F.col("sample_id") % 11 != 0, F.col("cr_time")).alias("time"), (F.col("cr_status") > 0).cast("int").alias("status"))
    return _named(os.unionByName(rfs))


def _expressed(s, d):
    return _named(expr(s, d).where("sample_id % 10 <> 0 AND dataset <> 'HOUSEHOLD'"))


def _cohort_rows(s, d):
    n = surv(s, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    one = lambda c: F.col("dataset") == c
    c = n.select("dataset", "n", F.when(one("BUILDING"), "DFS").when(~one("FURNITURE"), "OS").alias("primary"), F.when(~one("FURNITURE"), "OS").alias("ep_os"), F.when(~one("MACHINERY"), "RFS").alias("ep_dfs"))
    return _named(c).unionByName(s.createDataFrame([("GHOST", 4, "OS", "OS", None)], "dataset string, n long, primary string, ep_os string, ep_dfs string"))


_LT = f"lt AS (SELECT {_NAME} AS dataset, sample_id, 'OS' AS token, time, CASE WHEN sample_id % 9 <> 0 THEN status END AS status FROM surv UNION ALL SELECT dataset, sample_id, 'RFS', CASE WHEN sample_id % 11 <> 0 THEN cr_time END, CASE WHEN cr_status > 0 THEN 1 ELSE 0 END FROM surv WHERE dataset <> 'MACHINERY'), xs AS (SELECT DISTINCT {_NAME} AS dataset, sample_id FROM expr WHERE sample_id % 10 <> 0 AND dataset <> 'HOUSEHOLD')"
_CT = f"ct AS (SELECT {_NAME} AS dataset, count(*) AS n, CASE dataset WHEN 'BUILDING' THEN 'DFS' WHEN 'FURNITURE' THEN NULL ELSE 'OS' END AS \"primary\", CASE WHEN dataset <> 'FURNITURE' THEN 'OS' END AS ep_os, CASE WHEN dataset <> 'MACHINERY' THEN 'RFS' END AS ep_dfs FROM surv GROUP BY surv.dataset UNION ALL SELECT 'GHOST', 4, 'OS', 'OS', NULL)"
#: Sizes by SQL: survival rows {lt}, catalog {ct}; names end in {t}.
_SIZED = """ft{t} AS (SELECT dataset, min(CASE WHEN token = 'OS' THEN token END) AS t_os, min(CASE WHEN token = 'RFS' THEN token END) AS t_dfs FROM {lt} GROUP BY dataset), cf{t} AS (SELECT {ct}.* REPLACE (coalesce(ep_os, t_os) AS ep_os, coalesce(ep_dfs, t_dfs) AS ep_dfs) FROM {ct} LEFT JOIN ft{t} USING (dataset)),
us{t} AS (SELECT {lt}.*, {lt}.dataset LIKE 'TCGA-%' OR x.sample_id IS NOT NULL AS used FROM {lt} LEFT JOIN xs x ON x.dataset = {lt}.dataset AND x.sample_id = {lt}.sample_id WHERE time IS NOT NULL AND status IS NOT NULL),
fm{t} AS (SELECT cf{t}.dataset, count(CASE WHEN used AND token = ep_os THEN 1 END) AS n_os, count(CASE WHEN used AND token = ep_dfs THEN 1 END) AS n_dfs, count(CASE WHEN used AND token = CASE "primary" WHEN 'OS' THEN ep_os ELSE ep_dfs END THEN 1 END) AS np, count(CASE WHEN used AND status = 1 AND token = CASE "primary" WHEN 'OS' THEN ep_os WHEN 'DFS' THEN ep_dfs END THEN 1 END) AS ne FROM cf{t} LEFT JOIN us{t} USING (dataset) GROUP BY cf{t}.dataset),
nv{t} AS (SELECT dataset, count(DISTINCT sample_id) AS n_surv FROM {lt} GROUP BY dataset), nx{t} AS (SELECT dataset, count(*) AS n_expr FROM xs GROUP BY dataset),
sj{t} AS (SELECT {ct}.dataset, {ct}.n AS old, "primary", nv{t}.n_surv, CASE WHEN {ct}.dataset NOT LIKE 'TCGA-%' THEN nx{t}.n_expr END AS n_expr, fm{t}.n_os, fm{t}.n_dfs, np, ne, nv{t}.n_surv IS NOT NULL AND ({ct}.dataset LIKE 'TCGA-%' OR nx{t}.n_expr IS NOT NULL) AND "primary" IS NOT NULL AS ok FROM {ct} LEFT JOIN nv{t} USING (dataset) LEFT JOIN nx{t} USING (dataset) LEFT JOIN fm{t} USING (dataset)),
sz{t} AS (SELECT dataset, n_surv, n_expr, CASE WHEN ok THEN n_os ELSE 0 END AS n_os, CASE WHEN ok THEN n_dfs ELSE 0 END AS n_dfs, CASE WHEN dataset LIKE 'TCGA-%' THEN old WHEN ok AND np > 0 THEN np END AS n, CASE WHEN ok THEN ne END AS n_events, CASE WHEN n_surv IS NULL THEN 'no survival table' WHEN dataset NOT LIKE 'TCGA-%' AND n_expr IS NULL THEN 'no expression table' WHEN "primary" IS NULL THEN 'no primary endpoint' END AS note FROM sj{t})"""
_SZ = f"{_LT}, {_CT}, {_SIZED.format(lt='lt', ct='ct', t='')}"


def _sizes(s, d):
    return cohorts.sizes(_cohort_rows(s, d), _long(s, d), _expressed(s, d), FAMS)


_q("ct1_sizes", _sizes, f"WITH {_SZ} SELECT * FROM sz")
_q("ct1_fallback", lambda s, d: cohorts.sizes(_cohort_rows(s, d).withColumns({"ep_os": F.lit(None).cast("string"), "ep_dfs": F.lit(None).cast("string")}), _long(s, d), _expressed(s, d), FAMS), f"WITH {_LT}, {_CT.replace('ct AS', 'ca AS', 1)}, ct AS (SELECT * REPLACE (NULL::VARCHAR AS ep_os, NULL::VARCHAR AS ep_dfs) FROM ca), {_SIZED.format(lt='lt', ct='ct', t='')} SELECT * FROM sz")
_q("ct2_changes", lambda s, d: cohorts.size_changes(_cohort_rows(s, d).where("dataset <> 'GHOST'"), _sizes(s, d)), f"WITH {_SZ}, o AS (SELECT dataset, n AS old_n FROM ct WHERE dataset <> 'GHOST') SELECT dataset, old_n, n AS new_n, CASE WHEN n IS NULL THEN 'would become null' WHEN old_n IS NULL THEN 'new' WHEN old_n = n THEN 'same' WHEN old_n < n THEN 'grows' ELSE 'shrinks' END AS change FROM sz LEFT JOIN o USING (dataset)")


def _lost(s, d):
    c = _cohort_rows(s, d).withColumn("n", F.when(F.col("dataset") == "BUILDING", 40).when(F.col("dataset") == "GHOST", 4).otherwise(F.col("n")))
    return cohorts.lost_samples(c.withColumn("primary", F.expr("CASE WHEN primary = 'DFS' THEN 'RFS' WHEN dataset = 'FURNITURE' THEN 'XYZ' ELSE primary END")), _long(s, d), _expressed(s, d))


_q("ct3_lost", _lost, f"""WITH {_LT}, {_CT}, c AS (SELECT dataset, CASE dataset WHEN 'BUILDING' THEN 40 WHEN 'GHOST' THEN 4 ELSE n END AS n, CASE dataset WHEN 'BUILDING' THEN 'RFS' WHEN 'FURNITURE' THEN 'XYZ' ELSE "primary" END AS tok FROM ct),
l AS (SELECT lt.dataset, sample_id, row_number() OVER (PARTITION BY lt.dataset ORDER BY sample_id) AS r FROM lt JOIN c ON c.dataset = lt.dataset AND c.tok = lt.token WHERE time IS NOT NULL AND status IS NOT NULL AND (lt.dataset, sample_id) NOT IN (SELECT dataset, sample_id FROM xs)), g AS (SELECT dataset, count(*) AS lost, string_agg(CAST(sample_id AS VARCHAR), ', ' ORDER BY r) FILTER (WHERE r <= 8) AS ids FROM l GROUP BY dataset),
k AS (SELECT c.*, lost, ids, c.dataset IN (SELECT dataset FROM lt) AS has_t, (c.dataset, c.tok) IN (SELECT DISTINCT dataset, token FROM lt) AS has_p, c.dataset IN (SELECT dataset FROM xs) AS has_e FROM c LEFT JOIN g USING (dataset))
SELECT dataset, n, CASE WHEN has_p AND has_e THEN coalesce(lost, 0) END AS dropped, CASE WHEN NOT has_t THEN 'no survival table' WHEN NOT has_p THEN 'primary token ' || tok || ' has no status and time' WHEN NOT has_e THEN 'no expression table' WHEN lost IS NULL THEN 'none' ELSE CAST(lost AS VARCHAR) || ' without expression: ' || ids END AS reason, CASE WHEN n < 51 THEN '>=30' ELSE '>50' END AS gate, CASE WHEN n < 30 THEN 'author-decision' ELSE 'gate' END AS decision FROM k""")
_q("ct4_work_plan", lambda s, d: cohorts.work_plan(catalog(s, d).select("accession"), catalog(s, d).where("n % 2 = 0"), catalog(s, d).where("n % 3 = 0"), catalog(s, d).where("n % 5 = 0")), f"WITH {CATALOG_SQL} SELECT accession, n % 2 = 0 AS db, n % 3 = 0 AS local, n % 5 = 0 AS out, CASE WHEN n % 5 = 0 THEN 'EXCLUDED' WHEN n % 2 = 0 THEN 'DONE-DB' WHEN n % 3 = 0 THEN 'DONE-LOCAL' ELSE 'TODO' END AS plan FROM cat")


def _consistency(s, d):
    """The catalog above with its true counts, then faults of every kind."""
    v, e = _long(s, d), _expressed(s, d)
    c = _cohort_rows(s, d)
    good = c.drop("n").join(cohorts.sizes(c, v, e, FAMS).drop("note"), "dataset").withColumn("platform", F.when(F.col("dataset") == "BUILDING", "GPL9").otherwise("GPL1")).withColumn("survival_types", F.when(F.col("dataset") != "HOUSEHOLD", "OS,RFS"))
    good = kept(good).df  # a catalog is a table
    b = F.col("dataset") == "BUILDING"
    bad = good.withColumn("n", F.when(b, 1_000_000).otherwise(F.col("n"))).withColumn("n_dfs", F.when(b, F.col("n_dfs") - 1).when(F.col("dataset") == "TCGA-MACHINERY", 7).otherwise(F.col("n_dfs")))
    odd = good.where("dataset = 'GHOST'").withColumns({"dataset": F.lit("ODD-GPL5"), "ep_os": F.lit(None).cast("string"), "primary": F.lit(None).cast("string")})
    cat = bad.where("dataset <> 'HOUSEHOLD'").unionByName(odd).unionByName(bad.where("dataset = 'GHOST'"))
    v = v.withColumn("status", F.when((F.col("dataset") == "AUTOMOBILE") & (F.col("token") == "RFS"), F.col("status") + 1).when((F.col("dataset") == "FURNITURE") & (F.col("token") == "OS"), None).otherwise(F.col("status")))
    grid = c.where("dataset <> 'FURNITURE'").select("dataset", F.explode(F.array(F.lit("OS"), F.lit("DFS"))).alias("family")).withColumn("pooling_class", F.when(F.col("dataset") == "GHOST", "Maybe").otherwise("Unknown"))
    return cohorts.consistency(cat, v, e, grid, FAMS, s.createDataFrame([("GPL1",)], "platform string"))


_NOTED = "coalesce(trim(survival_types) <> '', false)"
_FAULTY = f"""{_SZ}, gd AS (SELECT ct.* EXCLUDE (n), sz.* EXCLUDE (dataset, note), CASE ct.dataset WHEN 'BUILDING' THEN 'GPL9' ELSE 'GPL1' END AS platform, CASE WHEN ct.dataset <> 'HOUSEHOLD' THEN 'OS,RFS' END AS survival_types FROM ct JOIN sz ON sz.dataset = ct.dataset),
bd AS (SELECT * REPLACE (CASE dataset WHEN 'BUILDING' THEN 1000000 ELSE n END AS n, CASE dataset WHEN 'BUILDING' THEN n_dfs - 1 WHEN 'TCGA-MACHINERY' THEN 7 ELSE n_dfs END AS n_dfs) FROM gd),
cg AS (SELECT * FROM bd WHERE dataset <> 'HOUSEHOLD' UNION ALL SELECT * REPLACE ('ODD-GPL5' AS dataset, NULL::VARCHAR AS ep_os, NULL::VARCHAR AS "primary") FROM gd WHERE dataset = 'GHOST' UNION ALL SELECT * FROM bd WHERE dataset = 'GHOST'),
lv AS (SELECT * REPLACE (CASE WHEN dataset = 'AUTOMOBILE' AND token = 'RFS' THEN status + 1 WHEN dataset = 'FURNITURE' AND token = 'OS' THEN NULL ELSE status END AS status) FROM lt),
gr AS (SELECT dataset, unnest(['OS', 'DFS']) AS family, CASE dataset WHEN 'GHOST' THEN 'Maybe' ELSE 'Unknown' END AS pooling_class FROM ct WHERE dataset <> 'FURNITURE'), {_SIZED.format(lt='lv', ct='cg', t='_now')},
ow AS (SELECT * FROM cg WHERE dataset NOT LIKE 'TCGA-%'), fu AS (SELECT DISTINCT dataset, unnest(['OS', 'DFS']) AS family FROM cg),
sv AS (SELECT DISTINCT dataset FROM lv), se AS (SELECT DISTINCT dataset FROM xs), tk AS (SELECT * FROM (SELECT dataset, unnest(['OS', 'DFS']) AS family, unnest([ep_os, ep_dfs]) AS token, unnest([n_os, n_dfs]) AS k FROM ow) x),
cn AS (SELECT ow.dataset, unnest(['n', 'n_events', 'n_surv', 'n_expr', 'n_os', 'n_dfs']) AS c, unnest([ow.n, ow.n_events, ow.n_surv, ow.n_expr, ow.n_os, ow.n_dfs]) AS said, unnest([z.n, z.n_events, z.n_surv, z.n_expr, z.n_os, z.n_dfs]) AS found FROM ow JOIN sz_now z ON z.dataset = ow.dataset)"""
#: What each check lists, by SQL: (level, check): rows of one text.
_LISTED = {
    ("error", "repeated accession"): "SELECT dataset AS x FROM cg GROUP BY dataset HAVING count(*) > 1",
    ("error", "dash before the platform in an accession"): "SELECT dataset FROM cg WHERE dataset LIKE '%-GPL%'",
    ("error", "endpoint columns empty though annotated or with a survival table"): f"SELECT dataset || ' (survival types ' || coalesce(survival_types, 'NA') || ')' FROM cg WHERE coalesce(ep_os, ep_dfs, \"primary\") IS NULL AND ({_NOTED} OR dataset IN (FROM sv))",
    ("error", "annotated without expression table"): f"SELECT dataset FROM ow WHERE {_NOTED} AND dataset NOT IN (FROM se)",
    ("error", "annotated without survival table"): f"SELECT dataset FROM ow WHERE {_NOTED} AND dataset NOT IN (FROM sv)",
    ("error", "expression table without platform table"): "SELECT dataset || ' (platform ' || coalesce(platform, 'NA') || ')' FROM ow WHERE dataset IN (FROM se) AND platform IS DISTINCT FROM 'GPL1'",
    ("warn", "table without catalog row"): "SELECT dataset FROM (FROM se UNION FROM sv) x WHERE dataset NOT IN (SELECT dataset FROM cg)",
    ("error", "status not 0/1"): "SELECT DISTINCT dataset || '.' || token FROM lv WHERE status NOT IN (0, 1)",
    ("error", "count differs from the tables"): "SELECT dataset || ' ' || c || ' ' || CAST(said AS VARCHAR) || '!=' || coalesce(CAST(found AS VARCHAR), 'NA') FROM cn WHERE said IS NOT NULL AND said IS DISTINCT FROM found",
    ("error", "N above its tables"): "SELECT ow.dataset FROM ow JOIN sz_now z ON z.dataset = ow.dataset WHERE ow.n > z.n_expr OR ow.n > z.n_surv",
    ("error", "no sample in both tables"): "SELECT DISTINCT dataset FROM ow WHERE dataset IN (FROM sv) AND dataset IN (FROM se) AND dataset NOT IN (SELECT lv.dataset FROM lv JOIN xs ON xs.dataset = lv.dataset AND xs.sample_id = lv.sample_id)",
    ("warn", "status column empty"): "SELECT dataset || '.' || token FROM lv GROUP BY dataset, token HAVING count(status) = 0",
    ("warn", "primary endpoint without events"): "SELECT dataset FROM ow WHERE n IS NOT NULL AND n_events = 0",
    ("info", "expression but no N"): "SELECT dataset FROM ow WHERE dataset IN (FROM se) AND n IS NULL",
    ("error", "token without time and status"): "SELECT dataset || ' ' || token FROM tk WHERE token IS NOT NULL AND dataset IN (FROM sv) AND (dataset, token) NOT IN (SELECT (dataset, token) FROM lv WHERE time IS NOT NULL AND status IS NOT NULL)",
    ("error", "count of a family that is not registered"): "SELECT dataset || '/' || family FROM tk WHERE token IS NULL AND k <> 0",
    ("error", "cell missing in the grid"): "SELECT dataset || '/' || family FROM fu WHERE (dataset, family) NOT IN (SELECT (dataset, family) FROM gr)",
    ("error", "grid cell without cohort"): "SELECT dataset || '/' || family FROM gr WHERE (dataset, family) NOT IN (SELECT (dataset, family) FROM fu)",
    ("error", "repeated grid cell"): "SELECT dataset || '/' || family FROM gr GROUP BY dataset, family HAVING count(*) > 1",
    ("error", "pooling class blank or unknown"): f"SELECT dataset || '/' || family FROM gr WHERE coalesce(trim(pooling_class), '') NOT IN ({', '.join(repr(c) for c in cohorts.POOLING_CLASSES)})",
    ("info", "no endpoint annotation"): f"SELECT dataset FROM cg WHERE NOT {_NOTED}",
}
_q("ct5_consistency", _consistency, f"WITH {_FAULTY} " + " UNION ALL ".join(f"SELECT '{lv}' AS level, '{c}' AS \"check\", count(*) AS n, coalesce(array_to_string(list_sort(list(DISTINCT x))[1:10], ', '), '') AS detail FROM ({rows}) y(x)" for (lv, c), rows in _LISTED.items()))


def _sweep(s, d):
    """Of one gene: a cohort without expression, one without survival, one without a shared sample, one with constant values."""
    v = surv(s, d).where("dataset <> 'FURNITURE'")
    e = expr(s, d).where("gene = 'Brand#11' AND dataset <> 'HOUSEHOLD'").withColumn("sample_id", F.when(F.col("dataset") == "BUILDING", -F.col("sample_id")).otherwise(F.col("sample_id"))).withColumn("value", F.when(F.col("dataset") == "MACHINERY", 1.0).otherwise(F.col("value")))
    cat = surv(s, d).select("dataset").distinct().unionByName(s.createDataFrame([("GHOST",)], "dataset string"))
    return cohorts.sweep(cat, v, e, cox.screen(v.join(e, ["dataset", "sample_id"])))


_q("ct6_sweep", _sweep, """WITH k AS (SELECT s.dataset, count(DISTINCT s.sample_id) AS sv, count(DISTINCT e.sample_id) AS ex, sum(CASE WHEN e.sample_id IS NOT NULL THEN status END)::BIGINT AS ev FROM surv s LEFT JOIN (SELECT * FROM expr WHERE gene = 'Brand#11') e ON e.dataset = s.dataset AND e.sample_id = s.sample_id GROUP BY s.dataset)
SELECT dataset, CASE dataset WHEN 'HOUSEHOLD' THEN 'surv-only' WHEN 'FURNITURE' THEN 'expr-only' ELSE 'full' END AS type, CASE dataset WHEN 'FURNITURE' THEN 'FAIL' WHEN 'BUILDING' THEN 'FAIL' WHEN 'MACHINERY' THEN 'WARN' ELSE 'OK' END AS status, CASE dataset WHEN 'HOUSEHOLD' THEN sv ELSE ex END AS samples, CASE WHEN dataset <> 'HOUSEHOLD' THEN 1 END::BIGINT AS genes, CASE WHEN dataset IN ('AUTOMOBILE', 'MACHINERY') THEN ev END AS events,
CASE dataset WHEN 'HOUSEHOLD' THEN 'survival only' WHEN 'FURNITURE' THEN 'no survival table to merge' WHEN 'BUILDING' THEN 'no sample in both tables' WHEN 'MACHINERY' THEN 'cox rows=0' ELSE 'cox rows=1' END AS detail FROM k UNION ALL SELECT 'GHOST', 'not-in-db', 'SKIP', NULL, NULL, NULL, 'no table'""")

# --- readers on tables ------------------------------------------------------------------------------------------


def _matrix(s, d):
    """Probes by samples of all cohorts: a patient's place in its block of 40 is the sample, so the matrix has 40 columns and one of text.

    Rows are grouped by cohort and probe, as the probes that are dealt already need not move again; the id is named after.
    """
    places = [f"S{k}" for k in range(40)]
    x = probes(s, d).select("dataset", "probe_id", F.expr("concat('S', pmod(sample_id, 40))").alias("place"), "value")
    wide = x.groupBy("dataset", "probe_id").pivot("place", places).agg(F.max("value"))
    return wide.select(F.concat_ws("_", "dataset", "probe_id").alias("ID_REF"), *places, F.lit("n/a").alias("S99"))


def _series_files(s, d):
    """Every cohort's expression as a series-matrix text in the shared folder, in files that each hold a part of the genes; the folder.

    A cohort's lines are dealt by gene, so no task and no value holds a whole matrix; each file has its own head.
    """
    e = kept(expr(s, d).select("dataset", "gene", F.col("sample_id").cast("string").alias("sample_id"), F.col("value").cast("string").alias("value"))).df
    ids = e.groupBy("dataset").agg(F.sort_array(F.collect_set("sample_id")).alias("ids"))
    # a row for every cell of the matrix: cells that are not there are found by a join, not looked up for each sample
    cells = e.select("dataset", "gene").distinct().join(e.select("dataset", "sample_id").distinct(), "dataset").join(e, ["dataset", "gene", "sample_id"], "left")
    rows = cells.groupBy("dataset", "gene").agg(F.array_sort(F.collect_list(F.struct("sample_id", F.coalesce("value", F.lit("null")).alias("value")))).alias("cells"))
    line = F.concat_ws("\t", "gene", F.transform("cells", lambda c: c["value"]))
    part = F.pmod(F.xxhash64("gene"), F.lit(4)).cast("int")
    body = rows.select("dataset", part.alias("part"), F.concat(F.lit("5"), "gene").alias("r"), line.alias("line"))
    head = F.array(F.concat(F.lit('!Series_title\t"'), "dataset", F.lit('"')), F.concat_ws("\t", F.lit("!Sample_geo_accession"), "ids"), F.lit("!series_matrix_table_begin"), F.concat_ws("\t", F.lit("ID_REF"), "ids"), F.lit("!series_matrix_table_end"))
    places = ids.select("dataset", F.posexplode(head).alias("k", "line")).select("dataset", F.element_at(F.array(*map(F.lit, "12346")), F.col("k") + 1).alias("r"), "line")
    heads = body.select("dataset", "part").distinct().join(places, "dataset").select("dataset", "part", "r", "line")
    path = f"{shared_dir(s).rstrip('/')}/series-{uuid.uuid4().hex}"
    both = body.unionByName(heads).repartition("dataset", "part").sortWithinPartitions("dataset", "part", "r")
    both.select("dataset", "part", F.col("line").alias("value")).write.partitionBy("dataset", "part").text(path)
    return path


def _io4(s, d):
    body = readers.series_matrix(s, _series_files(s, d))[2]
    return _from_file(body)


_q("io4_series_matrix", _io4, "WITH i AS (SELECT DISTINCT dataset, sample_id FROM expr), g AS (SELECT DISTINCT dataset, gene FROM expr) SELECT i.dataset, g.gene AS probe_id, CAST(i.sample_id AS VARCHAR) AS sample_id, value FROM i JOIN g ON g.dataset = i.dataset LEFT JOIN expr e ON e.dataset = i.dataset AND e.sample_id = i.sample_id AND e.gene = g.gene")

def _lines(s, df, by="dataset"):
    """Files of lines, one folder per value of a column: rows (by, r, line) are written in the order of r. Path of the folder."""
    base = shared_dir(s)
    path = f"{base.rstrip('/')}/lines-{uuid.uuid4().hex}"
    df.repartition(by).sortWithinPartitions(by, "r").select(by, F.col("line").alias("value")).write.partitionBy(by).text(path)
    return path


def _with_head(rows, heads, by="dataset"):
    """Lines of rows (by, line) under fixed first lines."""
    keys = rows.select(by).distinct()
    parts = [keys.select(by, F.lit(f"{k:04d}").alias("r"), F.lit(h).alias("line")) for k, h in enumerate(heads)]
    out = rows.select(by, F.concat(F.lit("5"), "line").alias("r"), "line")
    for p in parts:
        out = out.unionByName(p)
    return out


def _part(s, d):
    return s.read.parquet(f"{d}/part.parquet").withColumn("dataset", F.regexp_replace("p_brand", "#", "")).withColumn("id", F.col("p_partkey").cast("string"))


def _joined(*cols):
    return F.concat_ws("\t", *cols).alias("line")


def _io5(s, d):
    gene = F.when(F.col("p_size") % 5 == 0, "---").otherwise(F.concat(F.lit("g"), F.col("p_size").cast("string")))
    rows = _part(s, d).select("dataset", _joined("id", "p_brand", gene, F.lit("x")))
    last = rows.select("dataset").distinct().select("dataset", F.explode(F.array(F.struct(F.lit("8").alias("r"), F.lit("!platform_table_end").alias("line")), F.struct(F.lit("9").alias("r"), F.lit("9\ta\tb\tc").alias("line")))).alias("x")).select("dataset", "x.*")
    return readers.platform_table(s, _lines(s, _with_head(rows, ["^PLATFORM", "0\t1\t2", "!platform_table_begin", "ID\tSymbol\tGENE\tENTREZ_GENE_ID"]).unionByName(last))).select("probe_id", "gene")


def _from_file(df):
    """The dataset that a file was written for, in place of its path."""
    return df.withColumn("dataset", F.regexp_extract("file", "dataset=([^/]+)", 1)).drop("file")


def _io6(s, d):
    """Cohorts of two layouts: with and without an array column, in another order."""
    p = _part(s, d)
    one = _with_head(p.where("dataset < 'Brand3'").select("dataset", _joined("id", "p_brand", F.lit("day"), F.lit("year"))), ["Source \tArray\tUnit\tUnit"])
    two = _with_head(p.where("dataset >= 'Brand3'").select("dataset", _joined(F.lit("week"), "id")), ["Unit\tSource"])
    got = _from_file(readers.sdrf(s, _lines(s, one.unionByName(two))))
    return got.select("dataset", F.col(readers.pick_column(got, ["^name", "^source"])).alias("id"), "Array", "Unit", "Unit__1")


def _io7(s, d):
    size = F.col("p_size").cast("string")
    rows = _part(s, d).select("dataset", _joined("p_type", size, F.lit("P"), F.concat((F.col("p_size") + 2).cast("string"), F.lit(",0")), size))
    return r6(_from_file(readers.magetab(s, _lines(s, _with_head(rows, ["Hyb\tA\tA\tA\tB", "Ref\tvalue\tcall\tvalue\tvalue"])), "value")), "value")


def _io8(s, d):
    p = _part(s, d)
    rows = p.select("dataset", _joined("id", F.col("p_size").cast("string"), F.lit("n/a")))
    twice = _with_head(rows, ["A\tB"]).unionByName(p.select("dataset", F.lit("6").alias("r"), _joined("id", F.lit("999"), F.lit("999"))))
    return _from_file(readers.unlabelled_matrix(s, _lines(s, twice)))


def _io9(s, d):
    rows = _part(s, d).select("dataset", _joined("id", F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.when(F.col("p_size") % 3 == 0, " NA").otherwise(F.col("p_size").cast("string"))))
    return readers.portal_clinical(s, _lines(s, _with_head(rows, ["#Identifier\tText\tNumber", "#STRING\tSTRING\tNUMBER", "PATIENT_ID\tBRAND\tAGE"]))).select("PATIENT_ID", "BRAND", "AGE")


def _io10(s, d):
    rows = _part(s, d).select("dataset", F.concat_ws(";", "id", F.concat(F.col("p_size").cast("string"), F.lit(",5")), F.lit("NA")).alias("line"))
    return readers.decimal_comma(s, _lines(s, _with_head(rows, ["ID;S1;S2"]))).where("sample_id <> 'dataset'")


def _io11(s, d):
    base = shared_dir(s)
    path = f"{base.rstrip('/')}/csv-{uuid.uuid4().hex}"
    readers.write_csv(dirty(s, d).select("sample_id", "dataset", fn.sex(F.col("sex_raw")).alias("sex")), path)
    return s.read.csv(path, header=True, schema="sample_id long, dataset string, sex string")


_q("io5_platform_table", _io5, "SELECT CAST(p_partkey AS VARCHAR) AS probe_id, CASE WHEN p_size % 5 <> 0 THEN 'g' || CAST(p_size AS VARCHAR) END AS gene FROM part")
_q("io6_sdrf", _io6, "SELECT replace(p_brand, '#', '') AS dataset, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_brand < 'Brand#3' THEN p_brand END AS \"Array\", CASE WHEN p_brand < 'Brand#3' THEN 'day' ELSE 'week' END AS \"Unit\", CASE WHEN p_brand < 'Brand#3' THEN 'year' END AS \"Unit__1\" FROM part")
_q("io7_magetab", _io7, "SELECT dataset, probe_id, unnest(['A', 'B']) AS sample_id, unnest([round(a, 6), round(b, 6)]) AS value FROM (SELECT replace(p_brand, '#', '') AS dataset, p_type AS probe_id, avg(p_size + 1)::DOUBLE AS a, avg(p_size)::DOUBLE AS b FROM part GROUP BY ALL) x")
_q("io8_unlabelled", _io8, "SELECT replace(p_brand, '#', '') AS dataset, CAST(p_partkey AS VARCHAR) AS probe_id, unnest(['A', 'B']) AS sample_id, unnest([p_size, NULL])::DOUBLE AS value FROM part")
_q("io9_portal", _io9, "SELECT CAST(p_partkey AS VARCHAR) AS \"PATIENT_ID\", p_brand AS \"BRAND\", CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS VARCHAR) END AS \"AGE\" FROM part")
_q("io10_decimal_comma", _io10, "SELECT CAST(p_partkey AS VARCHAR) AS probe_id, unnest(['S1', 'S2']) AS sample_id, unnest([p_size + 0.5::DOUBLE, NULL]) AS value FROM part")
_q("io11_csv", _io11, f"WITH {D} SELECT CAST(sample_id AS BIGINT) AS sample_id, dataset, {_table(_SEX, 'sex_raw')} AS sex FROM dt")
_q("io1_matrix", lambda s, d: readers.melt(_matrix(s, d), "ID_REF").where("value IS NOT NULL"), "SELECT concat_ws('_', dataset, probe_id) AS probe_id, 'S' || CAST(sample_id % 40 AS VARCHAR) AS sample_id, max(value) AS value FROM probes GROUP BY ALL")
_q("io2_survival", lambda s, d: r6(readers.survival_table(surv(s, d).select("sample_id", "time", "status")), "time"), "SELECT sample_id AS \"ID\", round(time, 6) AS time, status FROM surv")
_q("io3_map", lambda s, d: readers.map_for(expression.explode_map(raw_map(s, d)), _genes(s, "Brand#11")).select("platform", "probe_id", "gene"), f"WITH {MAP}, {XM} SELECT * FROM xm WHERE gene = 'Brand#11'")
_q("io12_gate", lambda s, d: readers.load_gate(catalog(s, d).select("accession", F.col("n").alias("n_expr")), catalog(s, d).where("n % 3 = 0"), ["NATION_1"], 60), f"WITH {CATALOG_SQL} SELECT accession, n AS n_expr, CASE WHEN n % 3 = 0 THEN 'kept' WHEN n <= 60 AND accession <> 'NATION_1' THEN 'skipped: small' ELSE 'loaded' END AS action FROM cat")
_q("io13_append", lambda s, d: readers.append_catalog(catalog(s, d).where("n % 2 = 0").select("accession", "n"), catalog(s, d).select("accession", (F.col("n") + 1000).alias("n"))), f"WITH {CATALOG_SQL} SELECT accession, CASE WHEN n % 2 = 0 THEN n ELSE n + 1000 END AS n FROM cat")
_q("io14_align", lambda s, d: readers.align(dirty(s, d).select("sample_id", F.col("sex_raw").alias("Gender"), F.col("grade_raw").alias("Grade")), ["sample_id", "sex", "grade", "age"]), f"WITH {D} SELECT sample_id, sex_raw AS sex, grade_raw AS grade, CAST(NULL AS VARCHAR) AS age FROM dt")


def queries():
    return {n: f for n, (f, _) in Q.items()}


def oracle_sql():
    return {n: s for n, (_, s) in Q.items() if s}
