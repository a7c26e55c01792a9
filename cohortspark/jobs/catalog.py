"""Registered queries: endpoints, agreement and audit (EP, AG, AU)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions.tokens import CLASSES, FAMILIES, TOKEN_ROWS
from cohortspark.operators import agreement, audit, endpoints, km
from cohortspark.sources.adapters import surv, text, view, with_views

CATALOG = """
SELECT n_name AS accession, r_name AS type, concat('GPL', CAST(n_nationkey % 3 AS {string})) AS platform, k.n AS n,
       CASE n_nationkey % 7 WHEN 0 THEN 'OS' WHEN 1 THEN 'OS,DSS,DFI,PFI' WHEN 2 THEN 'RFS, OS' WHEN 3 THEN 'EFS,RFS,TTP' WHEN 4 THEN 'DRFS,MFS' WHEN 5 THEN '' ELSE 'PFS,CSS,OS' END AS survival_types
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey JOIN (SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey) k ON k.c_nationkey = n_nationkey
"""


def catalog(spark, d):
    return view(spark, d, CATALOG.replace("{string}", "STRING"))


TOKENS = "VALUES " + ", ".join(f"('{t}', '{f}', {k})" for t, f, k in TOKEN_ROWS)
_FAMS = "VALUES " + ", ".join(f"('{f}', {k})" for k, f in enumerate(FAMILIES))
C = f"""cat AS ({text(CATALOG.replace("{string}", "VARCHAR"), True)}), tok(token, family, pr) AS ({TOKENS}), fams(family, fr) AS ({_FAMS}),
tl AS (SELECT accession, type, place, trim(t) AS token FROM (SELECT accession, type, unnest(range(len(string_split(survival_types, ',')))) AS place, unnest(string_split(survival_types, ',')) AS t FROM cat) x WHERE trim(t) <> ''),
tf AS (SELECT tl.*, family, pr FROM tl LEFT JOIN tok USING (token)),
fl AS (SELECT accession, type, family, token FROM (SELECT *, row_number() OVER (PARTITION BY accession, family ORDER BY pr, place) AS r FROM tf WHERE family IS NOT NULL) x WHERE r = 1),
dr AS (SELECT accession, string_agg(token, ',' ORDER BY place) AS endpoint_derived FROM tl WHERE token IN ('DFI', 'PFI') GROUP BY accession),
op AS (SELECT f.accession, f.type, f.family, f.token, coalesce(list_contains(string_split(endpoint_derived, ','), f.token), false) AS derived FROM fl f LEFT JOIN dr USING (accession)),
gr AS (SELECT c.accession, fm.family, o.token, coalesce(o.derived, false) AS derived, CASE WHEN o.token IS NULL THEN 'absent' WHEN o.derived THEN 'derived' WHEN o.token = fm.family THEN 'exact' ELSE 'related' END AS role,
       CASE WHEN o.token IS NULL THEN 'Absent' WHEN o.token = fm.family THEN 'Exact-equivalent' ELSE 'Clinically-related' END AS pooling_class FROM cat c CROSS JOIN fams fm LEFT JOIN op o ON o.accession = c.accession AND o.family = fm.family)"""
_LABEL = "CASE WHEN token = family THEN family ELSE family || ' (' || token || ')' END || CASE WHEN derived THEN ' [derived]' ELSE '' END"
_NOTE = "nullif(concat_ws('; ', CASE WHEN role = 'related' THEN 'stands in for ' || family END, CASE WHEN derived THEN 'derived endpoint' END), '')"
Q: dict = {}


def _q(name, fn, sql=None):
    Q[name] = (fn, with_views(sql) if sql else None)


_q("ep1_family", lambda s, d: endpoints.tokens_long(catalog(s, d)).select("accession", "token", "family"), f"WITH {C} SELECT accession, token, family FROM tf")


def _asked(s, d):
    return catalog(s, d).select("accession", F.explode(F.array(*map(F.lit, [*FAMILIES, "RFS", "XYZ"]))).alias("asked"))


_q("ep2_resolve", lambda s, d: endpoints.resolve(catalog(s, d), _asked(s, d)),
   f"WITH {C}, a AS (SELECT accession, unnest(['OS', 'DSS', 'DFS', 'PFS', 'MFS', 'RFS', 'XYZ']) AS asked FROM cat) SELECT a.accession, asked, CASE WHEN asked IN ('OS', 'DSS', 'DFS', 'PFS', 'MFS') THEN fl.token WHEN asked = 'RFS' THEN 'RFS' END AS token FROM a LEFT JOIN fl ON fl.accession = a.accession AND fl.family = asked")
_q("ep3_options", lambda s, d: endpoints.options(catalog(s, d)), f"WITH {C} SELECT accession, family, token, derived, {_LABEL} AS label FROM op")
_q("ep4_first_token", lambda s, d: endpoints.families_long(catalog(s, d)), f"WITH {C} SELECT accession, family, token FROM fl")
_q("ep5_family_columns", lambda s, d: endpoints.family_columns(catalog(s, d)).drop("platform", "n", "type"),
   f"""WITH {C}, w AS (SELECT accession, max(token) FILTER (WHERE family = 'OS') AS ep_os, max(token) FILTER (WHERE family = 'DSS') AS ep_dss, max(token) FILTER (WHERE family = 'DFS') AS ep_dfs, max(token) FILTER (WHERE family = 'PFS') AS ep_pfs, max(token) FILTER (WHERE family = 'MFS') AS ep_mfs FROM fl GROUP BY accession)
SELECT c.accession, survival_types, ep_os, ep_dss, ep_dfs, ep_pfs, ep_mfs, coalesce(ep_os, ep_dss, ep_dfs, ep_pfs, ep_mfs) AS endpoint_primary,
nullif(concat_ws(',', CASE WHEN ep_os IS NOT NULL THEN 'OS' END, CASE WHEN ep_dss IS NOT NULL THEN 'DSS' END, CASE WHEN ep_dfs IS NOT NULL THEN 'DFS' END, CASE WHEN ep_pfs IS NOT NULL OR ep_mfs IS NOT NULL THEN 'PFS' END), '') AS endpoint_families, endpoint_derived
FROM cat c LEFT JOIN w USING (accession) LEFT JOIN dr USING (accession)""")
_q("ep6_conflicts", lambda s, d: endpoints.conflicts(catalog(s, d)), f"WITH {C} SELECT accession, family, string_agg(token, ',' ORDER BY pr, token) AS tokens, count(*) AS n FROM tf GROUP BY accession, family HAVING count(*) > 1 OR family IS NULL")
_q("ep7_family_counts", lambda s, d: endpoints.family_counts(catalog(s, d)), f"WITH {C} SELECT family, count(DISTINCT accession) AS cohorts FROM fl GROUP BY family")
_q("ep7_browse_counts", lambda s, d: endpoints.browse_counts(catalog(s, d)), f"WITH {C} SELECT CASE WHEN family = 'MFS' THEN 'PFS' ELSE family END AS browse, count(DISTINCT accession) AS cohorts FROM fl GROUP BY 1")
_q("ep7_cohorts_with", lambda s, d: endpoints.cohorts_with(catalog(s, d), "EUROPE", "PFS").select("accession"), f"WITH {C} SELECT DISTINCT accession FROM fl WHERE type = 'EUROPE' AND family IN ('PFS', 'MFS')")
_q("ep7_multi_types", lambda s, d: endpoints.multi_types(catalog(s, d)), f"WITH {C} SELECT type, count(*) AS cohorts FROM cat GROUP BY type HAVING count(*) >= 2")
_q("ep8_common", lambda s, d: endpoints.common(endpoints.tokens_long(catalog(s, d)), "token", ["NATION_0", "NATION_1", "NATION_6"], ["OS"]).select("token", F.col("place").cast("long").alias("place")),
   f"WITH {C} SELECT token, CASE WHEN token = 'OS' THEN 0 ELSE 1 END::BIGINT AS place FROM tl WHERE accession IN ('NATION_0', 'NATION_1', 'NATION_6') GROUP BY token HAVING count(DISTINCT accession) = 3")
_q("ep9_semantics_for", lambda s, d: endpoints.semantics_for(endpoints.semantics_grid(catalog(s, d)), families=["DFS", "MFS"]).drop("note"), f"WITH {C} SELECT * FROM gr WHERE family IN ('DFS', 'MFS')")


def _broken(s, d):
    g = endpoints.semantics_grid(catalog(s, d)).select("accession", "family", "pooling_class")
    return g.withColumn("family", F.when(F.col("accession") == "NATION_1", "XFS").otherwise(F.col("family"))).withColumn("pooling_class", F.when(F.col("accession") == "NATION_2", F.lit(None)).otherwise(F.col("pooling_class")))


_q("ep10_violations", lambda s, d: endpoints.semantics_violations(_broken(s, d)),
   f"""WITH {C}, b AS (SELECT accession, CASE WHEN accession = 'NATION_1' THEN 'XFS' ELSE family END AS family, CASE WHEN accession = 'NATION_2' THEN NULL ELSE pooling_class END AS pooling_class FROM gr)
SELECT * FROM (SELECT 'unknown family' AS rule, count(*) AS n FROM b WHERE family NOT IN ('OS', 'DSS', 'DFS', 'PFS', 'MFS') UNION ALL SELECT 'unknown class', count(*) FROM b WHERE pooling_class IS NULL OR pooling_class NOT IN {CLASSES}
UNION ALL SELECT 'blank accession', count(*) FROM b WHERE coalesce(trim(accession), '') = '' UNION ALL SELECT 'repeated cohort and family', count(*) FROM (SELECT 1 FROM b GROUP BY accession, family HAVING count(*) > 1) x) y WHERE n > 0""")
_q("ep11_semantics_grid", lambda s, d: endpoints.semantics_grid(catalog(s, d)), f"WITH {C} SELECT *, {_NOTE} AS note FROM gr")


def _class_asked(s, d):
    return endpoints.tokens_long(catalog(s, d)).select("accession", "token", F.explode(F.array(F.lit("DFS"), F.lit("OS"))).alias("family")).distinct()


_q("ep12_pooling_class", lambda s, d: endpoints.classes(_class_asked(s, d), endpoints.semantics_grid(catalog(s, d)).where("accession = 'NATION_1'")),
   f"""WITH {C}, a AS (SELECT DISTINCT accession, token, unnest(['DFS', 'OS']) AS family FROM tl)
SELECT a.accession, a.token, a.family, coalesce(g.pooling_class, CASE WHEN a.token = a.family THEN 'Exact-equivalent' WHEN t.family = a.family THEN 'Clinically-related' WHEN t.family IS NOT NULL THEN 'Not-poolable' ELSE 'Unknown' END) AS pooling_class
FROM a LEFT JOIN tok t ON t.token = a.token LEFT JOIN gr g ON g.accession = 'NATION_1' AND g.accession = a.accession AND g.family = a.family""")


def _names(s, d):
    x = catalog(s, d).select(F.concat(F.when(F.length("accession") > 8, "TCGA-").when(F.length("accession") > 7, "GSE1-").otherwise("E-"), "accession", F.lit("_GPL96")).alias("name"))
    return x.select("name", *endpoints.names(F.col("name")))


_q("ep13_names", _names, f"""WITH {C}, x AS (SELECT CASE WHEN length(accession) > 8 THEN 'TCGA-' WHEN length(accession) > 7 THEN 'GSE1-' ELSE 'E-' END || accession || '_GPL96' AS name FROM cat)
SELECT name, CASE WHEN name LIKE 'TCGA%' THEN 'TCGA' WHEN name LIKE 'GSE%' THEN 'GEO' WHEN name LIKE 'E-%' THEN 'EMBL-EBI' WHEN name LIKE 'CGGA%' THEN 'CGGA' ELSE 'other' END AS source, regexp_replace(name, '^TCGA[-_]', '') AS short_name,
upper(regexp_replace(name, '[_-]', '', 'g')) AS key, regexp_replace(name, '_GPL.*$', '') AS base FROM x""")
_q("ep14_dominant", lambda s, d: endpoints.dominant(catalog(s, d), 2),
   f"WITH {C}, g AS (SELECT type, family, token, count(*) AS cohorts FROM fl GROUP BY ALL HAVING count(*) >= 2) SELECT type, family, token, cohorts FROM (SELECT g.*, row_number() OVER (PARTITION BY type ORDER BY cohorts DESC, fr, token) AS r FROM g JOIN fams USING (family)) x WHERE r = 1")

R = C + ", rec AS (SELECT 'R' || lpad(CAST(row_number() OVER (ORDER BY accession, family) AS VARCHAR), 4, '0') AS record_id, accession, family, family || ' / ' || CASE WHEN length(accession) > 8 THEN 'GEO' ELSE 'TCGA' END AS stratum FROM gr)"


def _rec(s, d):
    return agreement.records(endpoints.semantics_grid(catalog(s, d)), F.when(F.length("accession") > 8, "GEO").otherwise("TCGA")).select("record_id", "accession", "family", "stratum")


_q("ag1_records", _rec, f"WITH {R} SELECT * FROM rec")
_SEATS = "z AS (SELECT stratum, count(*) AS size FROM rec GROUP BY stratum), q AS (SELECT *, least(40, sum(size) OVER ())::DOUBLE * size / sum(size) OVER () AS quota FROM z), f AS (SELECT *, floor(quota) AS seats FROM q), g AS (SELECT *, 40 - sum(seats) OVER () AS l, row_number() OVER (ORDER BY round(quota - seats, 9) DESC, stratum) AS r FROM f), seated AS (SELECT stratum, size, (seats + CASE WHEN r <= l THEN 1 ELSE 0 END)::BIGINT AS seats FROM g)"
_q("ag2_allocation", lambda s, d: agreement.allocate(_rec(s, d).groupBy("stratum").agg(F.count(F.lit(1)).alias("size")), 40), f"WITH {R}, {_SEATS} SELECT * FROM seated")
_q("ag2_draw", lambda s, d: agreement.draw(_rec(s, d), 40), f"WITH {R}, {_SEATS}, o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(record_id || ':1'), record_id) AS place FROM rec) SELECT record_id, accession, family, stratum FROM o JOIN seated USING (stratum) WHERE place <= seats")


def _ratings(s, d):
    lab = s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").cast("string").alias("record_id"), F.col("quality").alias("rater1_flag"), F.col("toxic").alias("rater2_flag"), F.when(F.col("doc_id") % 3 != 0, F.col("quality")).alias("rater1_part"), F.col("quality").alias("rater2_part"))
    return agreement.ratings_long(lab, ["1", "2"], ["flag", "part"])


L = """l AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, 'flag' AS field, CAST(quality AS VARCHAR) AS x1, CAST(toxic AS VARCHAR) AS x2 FROM labels UNION ALL
SELECT CAST(doc_id AS VARCHAR), 'part', CASE WHEN doc_id % 3 <> 0 THEN CAST(quality AS VARCHAR) END, CAST(quality AS VARCHAR) FROM labels), b AS (SELECT * FROM l WHERE x1 IS NOT NULL AND x2 IS NOT NULL)"""
_q("ag3_kappa", lambda s, d: agreement.kappa(_ratings(s, d)).withColumns({c: F.round(c, 6) for c in ("agreement", "kappa")}),
   f"""WITH {L}, n AS (SELECT field, count(*) AS n, sum(CASE WHEN x1 = x2 THEN 1 ELSE 0 END)::DOUBLE AS same FROM b GROUP BY field), m1 AS (SELECT field, x1 AS x, count(*) AS c FROM b GROUP BY ALL), m2 AS (SELECT field, x2 AS x, count(*) AS c FROM b GROUP BY ALL),
p AS (SELECT m1.field, sum(m1.c * m2.c)::DOUBLE AS s FROM m1 JOIN m2 USING (field, x) GROUP BY m1.field), k AS (SELECT field, n, same / n AS agreement, CASE WHEN s / n / n < 1 THEN (same / n - s / n / n) / (1 - s / n / n) END AS kappa FROM n JOIN p USING (field))
SELECT field, '1' AS r1, '2' AS r2, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa, CASE WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' WHEN kappa IS NOT NULL THEN 'almost perfect' END AS label FROM k""")
_q("ag4_disagreements", lambda s, d: agreement.disagreements(_ratings(s, d)), f"WITH {L} SELECT record_id, field, '1=' || x1 || '; 2=' || x2 AS detail FROM b WHERE x1 <> x2")
_q("ag4_rate", lambda s, d: agreement.adjudication_rate(_ratings(s, d)).withColumn("rate", F.round("rate", 6)), f"WITH {L} SELECT field, count(*) AS comparable, sum(CASE WHEN x1 <> x2 THEN 1 ELSE 0 END)::BIGINT AS disagreeing, round(avg(CASE WHEN x1 <> x2 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS rate FROM b GROUP BY field")


def _audit(s, d):
    rows = surv(s, d)
    led = km.pool_ledger(rows.withColumn("value", F.col("balance")).withColumn("high", (F.col("balance") > 0).cast("int")), 300)
    used = rows.join(led.where("reason IS NULL").select("dataset"), "dataset", "left_semi").where("sample_id % 10 <> 0")
    n = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    ends = n.select("dataset", F.lit("OS").alias("family"), F.when(F.col("dataset") < "G", "OS").otherwise("DSS").alias("token"), F.lit("direct").alias("token_role"), F.when(F.col("dataset") < "G", "Exact-equivalent").otherwise("Clinically-related").alias("pooling_class"))
    gone = used.groupBy("dataset", "nation").agg(F.count(F.lit(1)).alias("k")).select("dataset", F.concat(F.lit("nation "), F.lpad(F.col("nation").cast("string"), 2, "0")).alias("variable"), F.lit("level merged").alias("reason"))
    return audit.run_audit(used, "r1", {"analysis": "pooled curve", "marker": "balance", "fitted_covariates": ["balance", "nation"], "cut_rule": "above 0"}, led, n, ends, dropped_covariates=gone)


_AUDIT = """WITH n AS (SELECT dataset, count(*) AS n FROM surv GROUP BY dataset), u AS (SELECT * FROM surv WHERE sample_id % 10 <> 0 AND dataset IN (SELECT dataset FROM n WHERE n >= 300)), k AS (SELECT dataset, count(*) AS used FROM u GROUP BY dataset),
t AS (SELECT dataset, CASE WHEN dataset < 'G' THEN 'OS' ELSE 'DSS' END AS token, CASE WHEN dataset < 'G' THEN 'Exact-equivalent' ELSE 'Clinically-related' END AS pc FROM k),
x AS (SELECT 'cohorts' AS field, dataset AS v FROM k UNION SELECT 'endpoint_family', 'OS' FROM k UNION SELECT 'resolved_tokens_per_cohort', dataset || '=' || token FROM t UNION SELECT 'token_role', 'direct' FROM t UNION SELECT 'pooling_classes_pooled', pc FROM t
  UNION SELECT 'excluded_cohorts', dataset || ': fewer than 10 complete rows' FROM n WHERE n < 300 UNION SELECT 'rows_dropped', dataset || ': ' || CAST(n - coalesce(used, 0) AS VARCHAR) FROM n LEFT JOIN k USING (dataset) WHERE n > coalesce(used, 0) UNION SELECT 'covariates_dropped', dataset || ' nation ' || lpad(CAST(nation AS VARCHAR), 2, '0') || ': level merged' FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY v) AS r, count(*) OVER (PARTITION BY field) AS c FROM x), y AS (SELECT field, string_agg(v, ' | ' ORDER BY r) FILTER (WHERE r <= 6) || CASE WHEN max(c) > 6 THEN ' | ... (+' || CAST(max(c) - 6 AS VARCHAR) || ' more)' ELSE '' END AS value FROM r GROUP BY field),
f(field) AS (VALUES ('cohorts'), ('endpoint_family'), ('resolved_tokens_per_cohort'), ('token_role'), ('pooling_classes_pooled'), ('excluded_cohorts'), ('rows_dropped'), ('overlap_dropped'), ('covariates_dropped')),
s AS (SELECT count(DISTINCT dataset) AS a, count(*) AS b, coalesce(sum(status), 0) AS e, (SELECT sum(n) FROM n) AS i FROM u)
SELECT 'r1' AS run_id, field, coalesce(value, 'none') AS value FROM f LEFT JOIN y USING (field) UNION ALL SELECT 'r1', unnest(['n_cohorts', 'n_input', 'n_analyzed', 'n_excluded', 'events', 'analysis', 'marker', 'fitted_covariates', 'cut_rule']), unnest([CAST(a AS VARCHAR), CAST(i AS VARCHAR), CAST(b AS VARCHAR), CAST(i - b AS VARCHAR), CAST(e AS VARCHAR), 'pooled curve', 'balance', 'balance, nation', 'above 0']) FROM s"""
_q("au1_audit", _audit, _AUDIT)
_q("au2_content_hash", lambda s, d: audit.content_hash(surv(s, d).select("dataset", "sample_id", F.round(F.col("time") * 1e6).cast("long").alias("time"), "status", "nation")), "SELECT dataset, count(*) AS \"rows\", CAST(sum(('0x' || substr(md5(concat_ws(chr(31), dataset, nation, sample_id, status, CAST(round(time * 1e6) AS BIGINT))), 1, 15))::BIGINT) AS VARCHAR) AS hash FROM surv GROUP BY dataset")


def queries():
    return {n: f for n, (f, _) in Q.items()}


def oracle_sql():
    return {n: s for n, (_, s) in Q.items() if s}
