"""Expression work on long tables: dataset, sample_id, probe_id or gene, value (EX1-EX24)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.ranges import quantiles
from cohortspark.sources.shared import kept

STAT = {"max": F.max, "min": F.min, "mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5))}


def probes_for(genes: DataFrame, platform_map: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EX1: (accession, platform, probe_id, gene) of the wanted genes, one gene per probe, and (accession, gene) without a probe."""
    w = Window.partitionBy("platform", "probe_id").orderBy("gene")
    hit = platform_map.join(genes, "gene", "left_semi").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    found = catalog.select("accession", "platform").join(hit, "platform")
    missing = catalog.select("accession").crossJoin(F.broadcast(genes.select("gene"))).join(found.select("accession", "gene").distinct(), ["accession", "gene"], "left_anti")
    return found, missing


def collapse(df: DataFrame, how: str = "max", keys: Sequence[str] = ("dataset", "sample_id", "gene")) -> DataFrame:
    """EX2/EX8: one value per key; null only if all are null. ``no`` keeps the rows."""
    return df if how == "no" else df.groupBy(*keys).agg(STAT[how]("value").alias("value"))


def wide(df: DataFrame, genes: Sequence[str], prefix: str = "") -> DataFrame:
    """EX3: samples x listed genes, in their order; a sample without a gene has null."""
    return df.groupBy("dataset", "sample_id").agg(*[F.max(F.when(F.col("gene") == g, F.col("value"))).alias(f"{prefix}{g}") for g in genes])


def marker(df: DataFrame, column: str, value, how: str = "max") -> DataFrame:
    """EX4: marker from one probe or gene."""
    return df.where(F.col(column) == value).groupBy("dataset", "sample_id").agg(STAT[how]("value").alias("value"))


def is_tumour(sample: Column) -> Column:
    """EX5: barcodes of tumour samples: TCGA- prefix, and sample type below 10 where the barcode is long enough."""
    return sample.startswith("TCGA-") & ((F.length(sample) < 15) | F.coalesce(F.substring(sample, 14, 2).try_cast("int") < 10, F.lit(False)))


_TERM = re.compile(r"\s*([+-])?\s*([0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\s*\*\s*([A-Za-z][A-Za-z0-9._-]*)")


def parse_signature(text: str) -> dict[str, float]:
    """EX6: weights of ``±w*GENE`` terms. Leftover text, a repeated gene or a missing sign between terms is an error.

    A hyphen without spaces belongs to the gene symbol.
    """
    at, out = 0, {}
    while at < len(text.rstrip()):
        m = _TERM.match(text, at)
        if not m or (out and not m[1]):
            raise ValueError(f"signature cannot be read from {text[at:]!r}")
        if m[3] in out:
            raise ValueError(f"gene {m[3]} appears twice")
        w = float(m[2]) * (-1 if m[1] == "-" else 1)
        if w in (float("inf"), float("-inf")):
            raise ValueError("weight is not finite")
        out[m[3]] = w
        at = m.end()
    if not out:
        raise ValueError("empty signature")
    return out


def signature(df: DataFrame, weights: dict[str, float], allow_missing: bool = False) -> DataFrame:
    """EX6: weighted sum per sample; null if a gene of the dataset is null, unless ``allow_missing`` sums what is measured.

    A gene that a dataset lacks altogether makes its scores null without ``allow_missing``.
    """
    w = F.coalesce(*[F.when(F.col("gene") == g, F.lit(float(x))) for g, x in weights.items()])
    g = df.where(F.col("gene").isin(*weights)).groupBy("dataset", "sample_id").agg(F.sum(w * F.col("value")).alias("total"), F.count("value").alias("measured"))
    need = F.lit(1) if allow_missing else F.lit(len(weights))
    return g.select("dataset", "sample_id", F.when(F.col("measured") >= need, F.col("total")).alias("value"))


def standardise(df: DataFrame, keys: Sequence[str] = ("dataset", "gene")) -> tuple[DataFrame, DataFrame]:
    """EX7: value to mean 0 and sample deviation 1 within each key; keys with a constant marker come second."""
    st = df.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    good = st.where("sd > 0")
    out = df.join(good, list(keys)).withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd")).drop("mean", "sd")
    return out, st.where("sd IS NULL OR NOT sd > 0").select(*keys)


def regions_to_patients(expr: DataFrame, clinical: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """EX9: mean per patient and probe; first non-empty clinical value by region order, and the number of regions."""
    e = expr.groupBy("dataset", "patient", "probe_id").agg(F.avg("value").alias("value"))
    filled = lambda c: F.when(F.trim(F.col(c)) != "", F.col("region"))
    c = clinical.groupBy("dataset", "patient").agg(*[F.min_by(c, filled(c)).alias(c) for c in columns], F.countDistinct("region").alias("regions"))
    return e, c


def first_replicate(samples: DataFrame) -> DataFrame:
    """EX10: one array per patient, the one with the lowest number after _Rep (none counts as 0)."""
    no = F.coalesce(F.regexp_extract("array", "_Rep([0-9]+)", 1).try_cast("int"), F.lit(0))
    w = Window.partitionBy("dataset", "patient").orderBy(no, "array")
    return samples.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def drop_empty_samples(df: DataFrame) -> DataFrame:
    """EX11: without samples that have no value at all."""
    return df.join(df.where("value IS NOT NULL").select("dataset", "sample_id").distinct(), ["dataset", "sample_id"], "left_semi")


def survey(df: DataFrame, stored: bool = False) -> DataFrame:
    """EX12: scale of each dataset over finite values; exact percentiles. The rows are kept once, unless they are a table (``stored``)."""
    x = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    ok = df.select("dataset", "sample_id", "probe_id", x.alias("v"))
    ok = ok if stored else kept(ok).df
    g = ok.groupBy("dataset").agg(
        F.countDistinct("probe_id").alias("rows"), F.countDistinct("sample_id").alias("cols"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.avg((F.col("v") == 0).cast("double")).alias("zero"), F.avg((F.col("v") < 0).cast("double")).alias("negative"), F.avg(F.when(F.col("v") != 0, (F.col("v") != F.floor("v")).cast("double"))).alias("fraction"),
    )
    g = g.join(quantiles(ok, ["dataset"], "v", (0.25, 0.5, 0.75, 0.99), stored=True), "dataset", "left")
    return g.select("dataset", "rows", "cols", "min", *[F.col("q")[k].alias(n) for k, n in enumerate(("q25", "median", "q75", "p99"))], "max", "zero", "negative", "fraction")


def verdict(s: DataFrame) -> DataFrame:
    """EX13: already_log or needs_log2, with the rule that decided and the votes."""
    votes = (F.col("max") <= 25).cast("int") + (F.col("p99") <= 20).cast("int") + (F.col("median") <= 16).cast("int") + (F.col("q75") - F.col("q25") <= 8).cast("int")
    rule = F.when(F.col("min") < 0, "D1").when((F.col("median") > 0) & (F.col("max") / F.col("median") <= 50), "D2").when((F.col("median") <= 0) & (F.col("max") <= 25), "D3").otherwise("votes")
    out = s.withColumn("votes", votes).withColumn("rule", rule)
    return out.withColumn("verdict", F.when((F.col("rule") != "votes") | (F.col("votes") >= 3), "already_log").otherwise("needs_log2"))


def apply_log2(df: DataFrame, verdicts: DataFrame, allowed: DataFrame, skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EX14: log2(value + 1) for allowed datasets; second the refusals (dataset, reason). With any refusal nothing is changed."""
    asked = kept(allowed.select("dataset").distinct().join(verdicts, "dataset", "left").join(skipped.select("dataset", F.lit(True).alias("skip")), "dataset", "left")).df
    hi = F.log2(F.col("max") + 1)
    refused = asked.select("dataset", F.when(F.col("verdict").isNull(), "unknown dataset").when(F.coalesce("skip", F.lit(False)), "skipped by provenance").when(F.col("verdict") == "already_log", "already on a log scale").when((hi > 25) | (F.col("min") < 0), "outside 0 to 25 after the change").alias("reason")).where("reason IS NOT NULL")
    fine = asked.select("dataset").crossJoin(F.broadcast(refused.agg(F.count(F.lit(1)).alias("bad")))).where("bad = 0").select("dataset", F.lit(True).alias("change"))
    out = df.join(F.broadcast(fine), "dataset", "left").withColumn("value", F.when(F.col("change"), F.log2(F.col("value") + 1)).otherwise(F.col("value"))).drop("change")
    return out, refused


def id_kind(c: Column) -> Column:
    """EX16: kind of a row id."""
    return F.when(c.rlike("^ENSG[0-9]+"), "ensembl").when(c.rlike("^[0-9]+$"), "entrez").when(c.rlike("^(NM|NR)_[0-9]+"), "refseq").otherwise("symbol")


def to_entrez(ids: DataFrame, id_map: DataFrame) -> DataFrame:
    """EX16: id -> sorted distinct Entrez ids joined by " /// "; cells with several symbols are split first. id_map: kind, name, gene_id."""
    parts = ids.select("id", F.explode(F.split("id", r"\s*(?:///|//|;|,)\s*")).alias("part")).where("part <> ''")
    named = parts.select("id", id_kind(F.col("part")).alias("kind"), F.when(id_kind(F.col("part")).isin("ensembl", "refseq"), F.regexp_replace("part", r"\.[0-9]+$", "")).otherwise(F.col("part")).alias("name"))
    hit = named.join(id_map, ["kind", "name"], "left").withColumn("gene_id", F.when(F.col("kind") == "entrez", F.col("name")).otherwise(F.col("gene_id")))
    return hit.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("gene_id")), " /// ").alias("gene_id")).withColumn("gene_id", F.when(F.col("gene_id") != "", F.col("gene_id")))


def explode_map(m: DataFrame) -> DataFrame:
    """EX17: one row per probe and gene of cells joined by " /// "; --- and blanks go."""
    return m.select("platform", "probe_id", F.explode(F.split("gene", " /// ")).alias("gene")).withColumn("gene", F.trim("gene")).where("gene NOT IN ('', '---')").distinct()


def extend_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """EX18: rows of the map, then new rows of probes it lacks."""
    return old.unionByName(new.join(old.select("platform", "probe_id").distinct(), ["platform", "probe_id"], "left_anti"))


def coverage(raw_map: DataFrame, expr_ids: DataFrame, mirror: DataFrame, platforms: DataFrame) -> DataFrame:
    """EX19: per platform the probes and annotated probes of its local and mirrored map, what is wrong, and the policy.

    raw_map and mirror: platform, probe_id, gene (several joined by " /// "); expr_ids: platform, probe_id of a cohort's
    expression rows; platforms: those asked for. pct is the annotated share in per cent. The map is expanded if a cell holds
    several genes, else collapsed. insufficient-annotation: no map, no annotated probe, below 40 %, or no row id in common
    with the expression; usable-with-caveat: below 90 %, a mirror that differs, or any gap; else ok.
    """
    named = ~F.coalesce(F.trim("gene"), F.lit("")).isin("", "---", "NA")
    count = lambda d, a, b: d.groupBy("platform").agg(F.countDistinct("probe_id").alias(a), F.countDistinct(F.when(named, F.col("probe_id"))).alias(b))
    several = raw_map.groupBy("platform").agg(F.max((named & F.col("gene").contains(" /// ")).cast("int")).alias("_several"))
    ids = expr_ids.select("platform", "probe_id").distinct()
    asked = ids.groupBy("platform").agg(F.count(F.lit(1)).alias("row_ids"))
    met = ids.join(raw_map.select("platform", "probe_id").distinct(), ["platform", "probe_id"], "left_semi").groupBy("platform").agg(F.count(F.lit(1)).alias("_met"))
    out = platforms.select("platform").distinct()
    for part in (count(raw_map, "probes", "annotated"), several, asked, met, count(mirror, "mirror_probes", "mirror_annotated")):
        out = out.join(part, "platform", "left")
    out = out.withColumn("pct", F.round(100 * F.col("annotated") / F.col("probes"), 2)).withColumn("representation", F.when(F.col("_several") == 1, "expanded").when(F.col("probes").isNotNull(), "collapsed"))
    out = out.withColumn("joins", F.when(F.col("probes").isNotNull() & F.col("row_ids").isNotNull(), F.coalesce("_met", F.lit(0)) > 0))
    apart = F.when(F.col("mirror_probes").isNull(), None).when(F.col("annotated").isNull(), "local_newer").when(F.col("annotated") == F.col("mirror_annotated"), "none").when(F.col("mirror_annotated") > F.col("annotated"), "mirror_newer").otherwise("local_newer")
    gaps = F.concat_ws(
        "; ", F.when(F.col("probes").isNull(), "no local map"), F.when(F.col("mirror_probes").isNull(), "not in the mirror"), F.when(F.col("annotated") == 0, "no annotated probe"),
        F.when(~F.col("joins"), "no row id in the map"), F.when(F.col("pct") < 60, F.concat(F.lit("only "), F.format_string("%.2f", "pct"), F.lit(" % annotated"))),
    )
    out = out.withColumn("divergence", apart).withColumn("gaps", gaps)
    poor = F.col("probes").isNull() | (F.col("annotated") == 0) | (F.col("pct") < 40) | (F.col("joins") == F.lit(False))
    some = (F.col("pct") < 90) | (F.col("divergence") != "none") | (F.col("gaps") != "")
    policy = F.when(F.coalesce(poor, F.lit(False)), "insufficient-annotation").when(F.coalesce(some, F.lit(False)), "usable-with-caveat").otherwise("ok")
    return out.select("platform", "probes", "annotated", "pct", "representation", "joins", "mirror_annotated", "divergence", F.nullif("gaps", F.lit("")).alias("gaps"), policy.alias("policy"))


def compare_maps(a: DataFrame, b: DataFrame) -> DataFrame:
    """EX20: per platform pairs on each side, pairs on one side only, and the verdict."""
    key = ["platform", "probe_id", "gene"]
    both = a.select(*key, F.lit(1).alias("l")).distinct().join(b.select(*key, F.lit(1).alias("r")).distinct(), key, "full_outer")
    g = both.groupBy("platform").agg(F.count("l").alias("left_pairs"), F.count("r").alias("right_pairs"), F.sum((F.col("r").isNull()).cast("int")).alias("only_left"), F.sum((F.col("l").isNull()).cast("int")).alias("only_right"))
    return g.withColumn("verdict", F.when((F.col("only_left") == 0) & (F.col("only_right") == 0), "same").otherwise("differs"))


def qc_row(expr: DataFrame, surv: DataFrame) -> DataFrame:
    """EX21: per dataset samples, probes, genes, endpoint rows, events, time range."""
    e = expr.groupBy("dataset").agg(F.countDistinct("sample_id").alias("samples"), F.countDistinct("probe_id").alias("probes"), F.countDistinct("gene").alias("genes"))
    s = surv.groupBy("dataset").agg(F.count(F.lit(1)).alias("endpoint_rows"), F.sum("status").alias("events"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    return e.join(s, "dataset", "full_outer")


def split_platforms(expr: DataFrame, members: DataFrame, platform_map: DataFrame) -> DataFrame:
    """EX22: a combined matrix as one dataset per platform, with that platform's probes only."""
    named = expr.join(members, "sample_id").join(platform_map.select("platform", "probe_id").distinct(), ["platform", "probe_id"], "left_semi")
    return named.withColumn("dataset", F.concat("dataset", F.lit("_"), "platform"))


def batch_diagnostics(df: DataFrame, top_pct: float = 30) -> DataFrame:
    """EX23: per dataset and gene n, missing, quartiles, spread, group sizes at median and top cut, median_z."""
    g = df.groupBy("dataset", "gene").agg(
        F.count("value").alias("n"), F.sum(F.col("value").isNull().cast("int")).alias("missing"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
    )
    g = g.join(quantiles(df, ["dataset", "gene"], "value", (0.25, 0.5, 0.75, 1 - top_pct / 100)), ["dataset", "gene"], "left")
    g = g.select("*", *[F.col("q")[k].alias(n) for k, n in enumerate(("q25", "median", "q75", "top_cut"))]).drop("q")
    sizes = df.join(g.select("dataset", "gene", "median", "top_cut"), ["dataset", "gene"]).groupBy("dataset", "gene").agg(F.sum((F.col("value") > F.col("median")).cast("int")).alias("high_median"), F.sum((F.col("value") > F.col("top_cut")).cast("int")).alias("high_top"))
    out = g.join(sizes, ["dataset", "gene"]).withColumn("iqr", F.col("q75") - F.col("q25"))
    w = Window.partitionBy("gene")
    return out.withColumn("median_z", (F.col("median") - F.avg("median").over(w)) / F.stddev_samp("median").over(w))


def median_shift(diag: DataFrame) -> DataFrame:
    """EX23: per gene the cohorts that have it and the range of their medians."""
    return diag.groupBy("gene").agg(F.count(F.lit(1)).alias("cohorts"), (F.max("median") - F.min("median")).alias("shift"))


_TOKEN = re.compile(r"\s*(?:([A-Za-z][A-Za-z0-9._]*(?:#[0-9]+)?)|([0-9]*\.?[0-9]+)|([-+*/():]))")


def parse_expression(text: str) -> tuple[list[str], str]:
    """EX24: genes of an arithmetic marker, and the expression over quoted columns. Only names, numbers, + - * / ( ) pass."""
    at, genes, out = 0, [], []
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not allowed in a marker: {text[at:]!r}")
        if m[1]:
            genes += [m[1]] if m[1] not in genes else []
            out.append(f"`{m[1]}`")
        else:
            out.append(f"{m[2]}D" if m[2] else "*" if m[3] == ":" else m[3])
        at = m.end()
    if not genes:
        raise ValueError("a marker needs a gene")
    return genes, " ".join(out)


def expression_marker(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """EX24: value of the expression per sample, and datasets left out with the genes they lack altogether."""
    genes, sql = parse_expression(text)
    have = df.where(F.col("gene").isin(*genes)).groupBy("dataset").agg(F.collect_set(F.when(F.col("value").isNotNull(), F.col("gene"))).alias("have"))
    lost = df.select("dataset").distinct().join(have, "dataset", "left").select("dataset", F.array_join(F.array_except(F.array(*map(F.lit, genes)), F.coalesce("have", F.array().cast("array<string>"))), ",").alias("missing")).where("missing <> ''")
    out = wide(df.where(F.col("gene").isin(*genes)), genes).withColumn("value", F.expr(sql)).select("dataset", "sample_id", "value")
    return out.join(lost, "dataset", "left_anti").where("value IS NOT NULL"), lost
