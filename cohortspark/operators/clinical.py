"""Curation of clinical and survival tables (CL1-CL28)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import clinical as fn


def build_survival(df: DataFrame, spec: Mapping) -> DataFrame:
    """CL1: one select from a spec: filter (SQL), id, endpoints {token: (time column, unit, status column)}, clinical {name: (column, rule)}, day.

    Rules: stage, grade, sex, number, age, text, T, N, M.
    """
    rules = {"stage": fn.stage, "grade": fn.grade, "sex": fn.sex, "number": fn.number, "age": fn.age_mid, "text": fn.squeezed, **{p: (lambda c, p=p: fn.tnm(c, p)) for p in "TNM"}}
    src = df.where(spec["filter"]) if spec.get("filter") else df
    cols: list[Column] = [F.col(spec["id"]).cast("string").alias("id")]
    for token, (time, unit, state) in spec["endpoints"].items():
        cols += [fn.years(fn.number(F.col(time).cast("string")), unit, spec.get("day", 365.0)).alias(f"{token}_time"), fn.status(F.col(state).cast("string")).alias(f"{token}_status")]
    cols += [rules[rule](F.col(c).cast("string")).alias(name) for name, (c, rule) in spec.get("clinical", {}).items()]
    return src.select(*cols)


def key_values(df: DataFrame, sep: str = ";") -> DataFrame:
    """CL2: sample_id, key, value of "k: v; k2 = v2" cells; repeated keys of a sample are joined by "; " in their order."""
    part = df.select("sample_id", F.posexplode(F.split("cell", sep)).alias("place", "part")).where("trim(part) <> ''")
    kv = part.select("sample_id", "place", F.trim(F.regexp_extract("part", r"^\s*\[?([^:=]+)[:=]", 1)).alias("key"), F.trim(F.regexp_extract("part", r"^[^:=]*[:=]\s*([^\]]*)", 1)).alias("value")).where("key <> ''")
    return kv.groupBy("sample_id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "; ").alias("value"))


def key_columns(kv: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CL2: chosen keys as columns."""
    return kv.groupBy("sample_id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def described(df: DataFrame) -> DataFrame:
    """CL3: age, days, class and status of one free-text description per sample."""
    t = F.col("description")
    return df.where(t.isNotNull()).select(
        "sample_id", F.regexp_extract(t, r"(?i)age[ :=]*([0-9]+)", 1).try_cast("int").alias("age"), F.regexp_extract(t, r"(?i)([0-9]+) *days?", 1).try_cast("int").alias("days"),
        F.nullif(F.regexp_extract(t, r"(?i)class[ :=]*([A-Za-z0-9]+)", 1), F.lit("")).alias("class"), fn.status(F.nullif(F.regexp_extract(t, r"(?i)status[ :=]*([a-z]+)", 1), F.lit(""))).alias("status"),
    )


def change_log(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CL15: per dataset and column the rows missing before and after and the values changed."""
    cells = lambda d, n: d.select("dataset", "sample_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(n)) for c in columns])).alias("x")).select("dataset", "sample_id", "x.*")
    j = cells(before, "old").join(cells(after, "new"), ["dataset", "sample_id", "column"])
    return j.groupBy("dataset", "column").agg(F.sum(F.col("old").isNull().cast("int")).alias("missing_before"), F.sum(F.col("new").isNull().cast("int")).alias("missing_after"), F.sum((~F.col("old").eqNullSafe(F.col("new"))).cast("int")).alias("changed"))


def unmapped(before: DataFrame, raw: str, rule: Column) -> DataFrame:
    """CL15: values that a rule makes null, with their counts."""
    return before.where(F.col(raw).isNotNull() & rule.isNull()).groupBy(F.col(raw).alias("value")).agg(F.count(F.lit(1)).alias("n"))


#: Levels of a normalised T column.
T_LEVELS = ("T0", "T1", "T2", "T3", "T4", "Tis", "TX")


def t_table(df: DataFrame) -> DataFrame:
    """CL16: per dataset its rows, filled stages, rows of each T level and without T, and how to use T.

    Where any stage is filled, stage leads and T is for sensitivity; else T itself is the covariate. Columns: t, stage.
    """
    counts = [F.sum(F.coalesce((F.col("t") == lv).cast("int"), F.lit(0))).alias(lv) for lv in T_LEVELS]
    g = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("stage").alias("stage_filled"), *counts, F.sum(F.col("t").isNull().cast("int")).alias("no_t"))
    return g.withColumn("advice", F.when(F.col("stage_filled") > 0, "stage first, T for sensitivity").otherwise("T only"))


def domain_violations(df: DataFrame) -> DataFrame:
    """CL17: OK, or ISSUE with the rules broken, per dataset. Columns: time, status, stage, t, n, m, sex, grade, age."""
    rules = {
        "age outside 0-120": ~F.col("age").between(0, 120), "grade": ~F.col("grade").rlike("^(G[1-4]|[5-9]|10)$"), "m": ~F.col("m").isin("M0", "M1", "MX"), "n": ~F.col("n").isin("N0", "N1", "N2", "N3", "NX"),
        "sex": ~F.col("sex").isin("male", "female"), "stage": ~F.col("stage").isin("0", "I", "II", "III", "IV"), "status not 0/1": ~F.col("status").isin(0, 1), "t": ~F.col("t").isin("T0", "T1", "T2", "T3", "T4", "TX", "Tis"), "time negative": F.col("time") < 0,
    }
    g = df.groupBy("dataset").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    text = F.concat_ws("; ", *[F.when(F.col(f"`{n}`"), F.lit(n)) for n in rules])
    return g.select("dataset", F.when(text == "", "OK").otherwise("ISSUE").alias("verdict"), text.alias("detail"))


def project_table(clinical: DataFrame, survival: DataFrame, endpoints: Sequence[str], least_events: int = 1) -> tuple[DataFrame, DataFrame]:
    """CL18: one row per sample of clinical x survival with times in years; second, endpoints with enough events."""
    w = Window.partitionBy("sample").orderBy("type")
    one = clinical.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    j = one.join(survival, "sample")
    cols = [c for e in endpoints for c in (fn.years(F.col(f"{e}_days").cast("double"), "day").alias(f"{e}_time"), F.when(F.col(e).isin(0, 1), F.col(e)).alias(f"{e}_status"))]
    out = j.select("sample", "type", F.lower("gender").alias("sex"), *cols)
    counts = out.select(F.explode(F.array(*[F.struct(F.lit(e).alias("token"), F.col(f"{e}_status").alias("s"), F.col(f"{e}_time").alias("t")) for e in endpoints])).alias("x")).select("x.*").groupBy("token").agg(F.sum(F.when(F.col("t") > 0, F.col("s")).otherwise(0)).alias("events"), F.sum((F.col("t").isNotNull() & F.col("s").isNotNull()).cast("int")).alias("n"))
    return out, counts.where(F.col("events") >= least_events)


def valid_survival(df: DataFrame) -> DataFrame:
    """CL19: status 0 or 1 and a finite positive time."""
    return df.where(F.col("status").isin(0, 1) & (F.col("time") > 0) & ~F.isnan("time") & (F.col("time") < float("inf")))


def evident_types(long: DataFrame, max_levels: int = 20) -> DataFrame:
    """CL20: per dataset and column numeric if every filled value parses, else categorical, or too many levels."""
    g = long.where("value IS NOT NULL").groupBy("dataset", "column").agg(F.count("value").alias("n"), F.count(F.col("value").try_cast("double")).alias("parsed"), F.countDistinct("value").alias("levels"))
    return g.withColumn("type", F.when(F.col("n") == F.col("parsed"), "numeric").when(F.col("levels") > max_levels, "too many levels").otherwise("categorical"))


def supplement(base: DataFrame, extra: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CL21: new columns joined to known samples, and rows of unknown samples appended."""
    known = base.join(extra.select("sample_id", *columns), "sample_id", "left")
    return known.unionByName(extra.join(base.select("sample_id"), "sample_id", "left_anti").select("sample_id", *columns), allowMissingColumns=True)


def match_samples(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CL22: right sample for each left key: exact, then letters and digits only, then source name; and the unmatched keys.

    left: key, source; right: key, sample_id.
    """
    clean = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    a = right.select(F.col("key").alias("k1"), F.col("sample_id").alias("s1"))
    b = right.groupBy(clean(F.col("key")).alias("k2")).agg(F.min("sample_id").alias("s2"))
    c = right.select(F.col("key").alias("k3"), F.col("sample_id").alias("s3"))
    j = left.join(a, F.col("key") == F.col("k1"), "left").join(b, clean(F.col("key")) == F.col("k2"), "left").join(c, F.col("source") == F.col("k3"), "left")
    out = j.select("key", F.coalesce("s1", "s2", "s3").alias("sample_id"), F.when(F.col("s1").isNotNull(), "exact").when(F.col("s2").isNotNull(), "cleaned").when(F.col("s3").isNotNull(), "source").alias("how"))
    return out.where("sample_id IS NOT NULL"), out.where("sample_id IS NULL").select("key")


def screen_headers(cells: DataFrame) -> DataFrame:
    """CL23: file, sample_id, key, token, role, number of key/value cells that can be read as a time or an event.

    A cell may be both. The token is null for generic keys. A text with state and time in one gives both roles under the
    key value_text[token]. Cells: file, sample_id, key, value.
    """
    row = lambda key, token, role, number: F.struct(key.alias("key"), token.alias("token"), F.lit(role).alias("role"), number.cast("double").alias("number"))
    k, v = F.col("key"), F.col("value")
    time, event = fn.survival_values(k, v)
    state, both, _, token = fn.combined(v)
    name = F.concat(F.lit("value_text["), token, F.lit("]"))
    found = F.array(row(k, fn.token_of_key(k), "time", time), row(k, fn.token_of_key(k), "event", event), row(name, token, "time", both), row(name, token, "event", state))
    return cells.select("file", "sample_id", F.explode(found).alias("x")).select("file", "sample_id", "x.*").where("number IS NOT NULL")


def best_pairs(screened: DataFrame) -> DataFrame:
    """CL24: per file and token the time and event keys most samples have both of; then the best token of each file.

    Generic keys pair with every token of their file, and give way to the token's own where numbers of samples are equal;
    then come keys with words that hint at survival, then names. A key with only zeros and ones is no time. Of repeated cells of a
    sample the least counts.
    """
    one = screened.groupBy("file", "token", "role", "key", "sample_id").agg(F.min("number").alias("x"))
    tokens = screened.where("token IS NOT NULL").select("file", F.col("token").alias("t")).distinct()
    bags = one.join(tokens, "file").where("token IS NULL OR token = t").select("file", F.col("t").alias("token"), "role", "key", "sample_id", "x", F.col("token").isNull().cast("int").alias("generic"))
    keys = bags.where("role = 'time'").groupBy("file", "token", "key").agg(F.max((~F.col("x").isin(0, 1)).cast("int")).alias("timely")).where("timely = 1").select("file", "token", "key")
    t = bags.where("role = 'time'").join(keys, ["file", "token", "key"], "left_semi").select("file", "token", "sample_id", F.col("key").alias("time_key"), F.col("generic").alias("g1"))
    e = bags.where("role = 'event'").select("file", "token", "sample_id", F.col("key").alias("event_key"), F.col("generic").alias("g2"), F.col("x").cast("int").alias("s"))
    g = t.join(e, ["file", "token", "sample_id"]).groupBy("file", "token", "time_key", "event_key").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("events"), F.max(F.col("g1") + F.col("g2")).alias("generic"))
    hint = lambda c: F.lower(c).rlike(fn.SURVIVAL_HINT).cast("int")
    w = Window.partitionBy("file", "token").orderBy(F.desc("n"), "generic", F.desc(hint("time_key") + hint("event_key")), "time_key", "event_key")
    v = Window.partitionBy("file").orderBy(F.desc("n"), F.desc("events"), "token")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").withColumn("best", F.row_number().over(v) == 1).drop("r", "generic")


def candidates(found: DataFrame, catalog: DataFrame, least: int = 50) -> DataFrame:
    """CL25: files with more than ``least`` usable samples that the catalog lacks, with the platform flag and reason."""
    out = found.join(catalog.select(F.col("accession"), F.col("platform").alias("known")), "accession", "left")
    why = F.when(F.col("effective_n") <= least, "too few samples").when(F.col("known").isNotNull() & (F.col("known") == F.col("platform")), "in catalog")
    return out.withColumn("platform_mismatch", F.coalesce(F.col("known") != F.col("platform"), F.lit(False))).withColumn("reason", why).drop("known").orderBy(F.desc("effective_n"))


def admitted(df: DataFrame, series_parts: DataFrame | None = None, least: int = 50) -> DataFrame:
    """CL27: largest cohort of each normalised title, one platform per series, no super-series whose parts are there; reasons of the others.

    df: accession, series, title, n. series_parts: accession of a super-series, part (a series). A super-series is covered
    when a cohort with more than ``least`` samples belongs to one of its parts.
    """
    title = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    by_title = Window.partitionBy("norm").orderBy(F.desc("n"), "accession")
    by_series = Window.partitionBy("series").orderBy(F.desc("n"), "accession")
    d = df.withColumn("norm", title).withColumn("a", F.row_number().over(by_title)).withColumn("b", F.row_number().over(by_series)).withColumn("c", F.lit(False))
    if series_parts is not None:
        large = df.where(F.col("n") > least).select(F.col("series").alias("part")).distinct()
        covered = series_parts.join(large, "part", "left_semi").select("accession", F.lit(True).alias("_covered")).distinct()
        d = d.join(covered, "accession", "left").withColumn("c", F.coalesce("_covered", F.lit(False)))
    why = F.concat_ws("; ", F.when(F.col("a") > 1, "same title as a larger cohort"), F.when(F.col("b") > 1, "another platform of the series"), F.when(F.col("c"), "super-series of listed series"))
    return d.select("accession", "series", "n", (why == "").alias("admitted"), F.when(why != "", why).alias("reason"))


def restore_ids(rows: DataFrame, ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CL28: sample ids from a table in the same row order, where all comparable check values agree; the verdict per dataset.

    rows: dataset, row_no, check_value; ordered: dataset, row_no, sample_id, check_value.
    """
    j = rows.withColumnRenamed("check_value", "x").join(ordered.withColumnRenamed("check_value", "y"), ["dataset", "row_no"], "left")
    g = j.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.count("sample_id").alias("matched"), F.sum((F.col("x").isNotNull() & F.col("y").isNotNull()).cast("int")).alias("comparable"), F.sum((F.col("x") == F.col("y")).cast("int")).alias("agree"))
    g = g.withColumn("restored", (F.col("rows") == F.col("matched")) & (F.col("comparable") > 0) & (F.col("comparable") == F.coalesce("agree", F.lit(0))))
    return j.join(g.where("restored").select("dataset"), "dataset", "left_semi").select("dataset", "row_no", "sample_id"), g
