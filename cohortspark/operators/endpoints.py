"""Endpoint catalog and resolution (EP1-EP14).

catalog: accession, type, platform, n, survival_types (comma list). Metadata tables have one row per cohort; the token
and family tables are constants of a dozen rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.tokens import BROWSE, CLASSES, DERIVED, FAMILIES, FAMILY_TOKENS, TOKEN_ROWS


def family_of(token: Column) -> Column:
    """EP1: pooling family of a token; a family name is its own, others are null."""
    out = F.when(token.isin(*FAMILIES), token)
    for fam, tokens in FAMILY_TOKENS.items():
        out = out.when(token.isin(*tokens), F.lit(fam))
    return out


def priority_of(token: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for t, _, k in TOKEN_ROWS:
        out = out.when(token == t, F.lit(k))
    return out


def _rank(values: Sequence[str], col: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for k, v in enumerate(values):
        out = out.when(col == v, F.lit(k))
    return out


def tokens_long(catalog: DataFrame) -> DataFrame:
    """accession, token, place of every non-empty token of the comma list, trimmed; family null if unknown."""
    return (
        catalog.select("accession", F.posexplode(F.split("survival_types", ",")).alias("place", "token")).withColumn("token", F.trim("token"))
        .where("token <> ''").withColumn("family", family_of(F.col("token")))
    )


def families_long(catalog: DataFrame) -> DataFrame:
    """EP4: per cohort and family the first token by priority."""
    w = Window.partitionBy("accession", "family").orderBy(priority_of(F.col("token")), "place")
    known = tokens_long(catalog).where(F.col("family").isNotNull() & priority_of(F.col("token")).isNotNull())
    return known.withColumn("r", F.row_number().over(w)).where("r = 1").select("accession", "family", "token")


def family_columns(catalog: DataFrame) -> DataFrame:
    """EP5: catalog with ep_<family>, endpoint_families (browsing, comma list), endpoint_primary, endpoint_derived."""
    fam = families_long(catalog)
    wide = fam.groupBy("accession").agg(*[F.max(F.when(F.col("family") == f, F.col("token"))).alias(f"ep_{f.lower()}") for f in FAMILIES])
    ep = [f"ep_{f.lower()}" for f in FAMILIES]
    browse = F.array_distinct(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(BROWSE[f])) for c, f in zip(ep, FAMILIES, strict=True)]), lambda x: x.isNotNull()))
    derived = tokens_long(catalog).where(F.col("token").isin(*DERIVED)).groupBy("accession").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]), ",").alias("endpoint_derived"))
    out = catalog.join(wide, "accession", "left").withColumn("endpoint_primary", F.coalesce(*ep))
    return out.withColumn("endpoint_families", F.when(F.coalesce(*ep).isNotNull(), F.array_join(browse, ","))).join(derived, "accession", "left")


def resolve(catalog: DataFrame, asked: DataFrame) -> DataFrame:
    """EP2: (accession, asked) -> token: the cohort's token of a family, a known raw token as it is, else null."""
    fam = families_long(catalog).select("accession", F.col("family").alias("asked"), F.col("token").alias("own"))
    raw = F.when(priority_of(F.col("asked")).isNotNull() & ~F.col("asked").isin(*FAMILIES), F.col("asked"))
    return asked.join(fam, ["accession", "asked"], "left").withColumn("token", F.when(F.col("asked").isin(*FAMILIES), F.col("own")).otherwise(raw)).drop("own")


def options(catalog: DataFrame) -> DataFrame:
    """EP3: family, token, derived flag and label of every endpoint of every cohort."""
    der = tokens_long(catalog).where(F.col("token").isin(*DERIVED)).groupBy("accession").agg(F.collect_set("token").alias("der"))
    out = families_long(catalog).join(der, "accession", "left").withColumn("derived", F.coalesce(F.array_contains("der", F.col("token")), F.lit(False))).drop("der")
    label = F.when(F.col("token") == F.col("family"), F.col("family")).otherwise(F.concat("family", F.lit(" ("), "token", F.lit(")")))
    return out.withColumn("label", F.when(F.col("derived"), F.concat(label, F.lit(" [derived]"))).otherwise(label))


def conflicts(catalog: DataFrame) -> DataFrame:
    """EP6: cohorts with several tokens of a family, and tokens without family (family null)."""
    t = tokens_long(catalog)
    many = t.where("family IS NOT NULL").groupBy("accession", "family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(priority_of(F.col("token")).alias("p"), "token"))), lambda x: x["token"]), ",").alias("tokens"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lost = t.where("family IS NULL").groupBy("accession", "family").agg(F.array_join(F.array_sort(F.collect_list("token")), ",").alias("tokens"), F.count(F.lit(1)).alias("n"))
    return many.unionByName(lost)


def family_counts(catalog: DataFrame) -> DataFrame:
    """EP7: cohorts per pooling family."""
    return families_long(catalog).groupBy("family").agg(F.countDistinct("accession").alias("cohorts"))


def browse_counts(catalog: DataFrame) -> DataFrame:
    """EP7: cohorts per browsing family."""
    fam = families_long(catalog)
    shown = F.coalesce(*[F.when(F.col("family") == f, F.lit(b)) for f, b in BROWSE.items()])
    return fam.select("accession", shown.alias("browse")).distinct().groupBy("browse").agg(F.count(F.lit(1)).alias("cohorts"))


def cohorts_with(catalog: DataFrame, kind: str | None, family: str) -> DataFrame:
    """EP7: cohorts of a type with a family; browsing PFS takes MFS too."""
    wanted = [f for f, b in BROWSE.items() if b == family]
    out = catalog if kind is None else catalog.where(F.col("type") == kind)
    return out.join(families_long(catalog).where(F.col("family").isin(*wanted)).select("accession").distinct(), "accession", "left_semi").orderBy("accession")


def multi_types(catalog: DataFrame, least: int = 2) -> DataFrame:
    """EP7: types with several cohorts."""
    return catalog.groupBy("type").agg(F.count(F.lit(1)).alias("cohorts")).where(F.col("cohorts") >= least)


def common(long: DataFrame, column: str, selected: Sequence[str], preferred: Sequence[str] = ()) -> DataFrame:
    """EP8: values of a column that all selected cohorts have, preferred ones first."""
    got = long.where(F.col("accession").isin(*selected)).groupBy(column).agg(F.countDistinct("accession").alias("k")).where(F.col("k") == len(set(selected)))
    return got.withColumn("place", F.coalesce(_rank(preferred, F.col(column)), F.lit(len(preferred)))).orderBy("place", column).drop("k")


def semantics_for(sem: DataFrame, accessions: Sequence[str] | None = None, families: Sequence[str] | None = None) -> DataFrame:
    """EP9: rows of the semantics table for some cohorts and families."""
    if accessions is not None:
        sem = sem.where(F.col("accession").isin(*accessions))
    return sem if families is None else sem.where(F.col("family").isin(*families))


def semantics_violations(sem: DataFrame) -> DataFrame:
    """EP10: (rule, n): missing or blank keys, families and classes outside the vocabulary, repeated cohort x family."""
    rules = {
        "blank accession": F.coalesce(F.trim("accession"), F.lit("")) == "",
        "unknown family": ~F.coalesce(F.col("family").isin(*FAMILIES), F.lit(False)),
        "unknown class": ~F.coalesce(F.col("pooling_class").isin(*CLASSES), F.lit(False)),
    }
    bad = sem.select(F.explode(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()])).alias("rule")).where("rule IS NOT NULL").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    twice = sem.groupBy("accession", "family").agg(F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("repeated cohort and family").alias("rule"), "n")
    return bad.unionByName(twice)


def semantics_grid(catalog: DataFrame) -> DataFrame:
    """EP10/EP11: cohort x family with token, role, derived flag, pooling class and note.

    Five rows per cohort: families are a constant.
    """
    grid = catalog.select("accession", F.explode(F.array(*map(F.lit, FAMILIES))).alias("family"))
    out = grid.join(options(catalog), ["accession", "family"], "left")
    out = out.withColumn("role", F.when(F.col("token").isNull(), "absent").when(F.col("derived"), "derived").when(F.col("token") == F.col("family"), "exact").otherwise("related"))
    out = out.withColumn("pooling_class", pooling_class(F.col("family"), F.col("token")))
    note = F.concat_ws("; ", F.when(F.col("role") == "related", F.concat(F.lit("stands in for "), "family")), F.when(F.col("derived"), F.lit("derived endpoint")))
    return out.select("accession", "family", "token", "role", F.coalesce("derived", F.lit(False)).alias("derived"), "pooling_class", F.when(note != "", note).alias("note"))


def pooling_class(family: Column, token: Column) -> Column:
    """EP12 without a table: absent, exact-equivalent, clinically related, not poolable (another family), unknown."""
    return (
        F.when(token.isNull() | F.trim(token).isin("", "-", "none", "NA"), "Absent").when(token == family, "Exact-equivalent").when(family_of(token) == family, "Clinically-related")
        .when(family_of(token).isNotNull(), "Not-poolable").otherwise("Unknown")
    )


def classes(asked: DataFrame, table: DataFrame) -> DataFrame:
    """EP12: class of (accession, family, token): the table's value if it has one, else the derived one."""
    known = table.select("accession", "family", F.col("pooling_class").alias("_table"))
    return asked.join(known, ["accession", "family"], "left").withColumn("pooling_class", F.coalesce("_table", pooling_class(F.col("family"), F.col("token")))).drop("_table")


def names(accession: Column) -> list[Column]:
    """EP13: source, short label, key without separators, base series of an accession."""
    source = F.when(accession.startswith("TCGA"), "TCGA").when(accession.startswith("GSE"), "GEO").when(accession.startswith("E-"), "EMBL-EBI").when(accession.startswith("CGGA"), "CGGA").otherwise("other")
    return [
        source.alias("source"), F.regexp_replace(accession, "^TCGA[-_]", "").alias("short_name"),
        F.upper(F.regexp_replace(accession, "[_-]", "")).alias("key"), F.regexp_replace(accession, "_GPL.*$", "").alias("base"),
    ]


def dominant(catalog: DataFrame, least: int = 3) -> DataFrame:
    """EP14: per type the token most cohorts have, with at least so many cohorts; ties by token priority and name."""
    g = families_long(catalog).join(catalog.select("accession", "type"), "accession").groupBy("type", "family", "token").agg(F.count(F.lit(1)).alias("cohorts")).where(F.col("cohorts") >= least)
    w = Window.partitionBy("type").orderBy(F.desc("cohorts"), _rank(FAMILIES, F.col("family")), "token")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
