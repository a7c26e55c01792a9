"""Readers and writers (IO1-IO14). Text formats are read as lines, in blocks: a file need not fit in a task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.functions.clinical import number
from cohortspark.sources.shared import kept

#: Gene columns of a platform table, and texts that stand for no gene.
GENE_COLUMNS = ("ENTREZ_GENE_ID", "Entrez_Gene_ID", "GENE_ID", "Gene ID", "GENE", "ENTREZID", "gene_id", "Entrez.Gene", "Entrez Gene ID", "Entrez.ID")
NO_GENE = ("---", "", "NA")


def melt(wide: DataFrame, id_column: str, probes: DataFrame | None = None) -> DataFrame:
    """IO1: probe x sample matrix to probe_id, sample_id, value; text becomes numbers or null; only wanted probes."""
    if probes is not None:
        wide = wide.join(probes.select(F.col("probe_id").alias(id_column)), id_column, "left_semi")
    values = [c for c in wide.columns if c != id_column]
    long = wide.select(id_column, *[F.col(c).cast("string").alias(c) for c in values]).unpivot([id_column], values, "sample_id", "value")
    return long.select(F.col(id_column).alias("probe_id"), "sample_id", F.col("value").try_cast("double").alias("value"))


def survival_table(df: DataFrame) -> DataFrame:
    """IO2: the first column is named ID."""
    return df.withColumnRenamed(df.columns[0], "ID")


def map_for(platform_map: DataFrame, genes: DataFrame) -> DataFrame:
    """IO3: rows of the map for some genes."""
    return platform_map.join(genes, "gene", "left_semi")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at, line of text files without blank lines; ``at`` rises along each file, whose blocks are read apart.

    The numbered lines are written once, as parts of them meet later: all parts see the same numbers.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    return kept(raw.where("trim(line) <> ''")).df


def _headers(names: DataFrame) -> DataFrame:
    """Column names of files, for a join with their cells: the hashed side is this one.

    Lines that repeat take few bytes in a table, so Spark takes their cells for small and would send them all through the driver.
    """
    return names.hint("shuffle_hash")


def _first_lines(lines: DataFrame, rank: int = 1) -> DataFrame:
    """file, at, line of the first lines of each file, numbered from 1 as r: partial minima, no sort of whole files."""
    top = lines.groupBy("file").agg(F.min(F.struct("at", "line")).alias("x")).select("file", "x.at", "x.line", F.lit(1).alias("r"))
    if rank == 1:
        return top
    rest = lines.join(F.broadcast(top.select("file", F.col("at").alias("_at"))), "file").where("at > _at").drop("_at")
    return top.unionByName(_first_lines(rest).withColumn("r", F.lit(2)))


def _between(lines: DataFrame, begin: str, end: str) -> DataFrame:
    """The lines of each file after its first line that starts with ``begin``, up to its first later line that starts with ``end``."""
    marks = lines.where(F.col("line").startswith(begin) | F.col("line").startswith(end)).groupBy("file").agg(
        F.min(F.when(F.col("line").startswith(begin), F.col("at"))).alias("_from"), F.min(F.when(F.col("line").startswith(end), F.col("at"))).alias("_to")
    )
    return lines.join(F.broadcast(marks), "file").where("at > _from AND (_to IS NULL OR at < _to)").drop("_from", "_to")


def _rest(c: str = "c") -> Column:
    """The cells of a line after the first."""
    return F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))


def series_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IO4: (file, key, value) of series lines, (file, sample_id, key, at, value) of sample lines, (file, probe_id, sample_id, value) of the body."""
    split = lambda d: d.withColumn("c", F.transform(F.split("line", "\t"), lambda x: F.regexp_replace(x, '^"|"$', "")))
    lines = ordered_lines(spark, path)
    cells = split(lines)
    series = cells.where(F.col("line").startswith("!Series_")).select("file", F.regexp_replace(F.col("c")[0], "^!Series_", "").alias("key"), F.col("c")[1].alias("value"))
    tagged = cells.where(F.col("line").startswith("!Sample_")).select("file", "at", F.regexp_replace(F.col("c")[0], "^!Sample_", "").alias("key"), F.posexplode(_rest()).alias("place", "value"))
    ids = tagged.where("key = 'geo_accession'").select("file", "place", F.col("value").alias("sample_id"))
    samples = tagged.where("key <> 'geo_accession'").join(_headers(ids), ["file", "place"]).select("file", "sample_id", "key", "at", "value")
    table = _between(lines, "!series_matrix_table_begin", "!series_matrix_table_end")
    top = _first_lines(table)
    head = split(top).select("file", F.posexplode(_rest()).alias("place", "sample_id"))
    body = split(table.join(F.broadcast(top.select("file", F.col("at").alias("_at"))), "file").where("at > _at"))
    rows = body.select("file", F.col("c")[0].alias("probe_id"), F.posexplode(_rest()).alias("place", "value"))
    return series, samples, rows.join(_headers(head), ["file", "place"]).select("file", "probe_id", "sample_id", F.col("value").try_cast("double").alias("value"))


def platform_table(spark: SparkSession, path: str, candidates: Sequence[str] = GENE_COLUMNS) -> DataFrame:
    """IO5: (file, probe_id, gene) from the platform table of SOFT files.

    The gene column is the first of the header that is a candidate; a file without one has null genes. Rows without a
    probe name are left out.
    """
    table = _between(ordered_lines(spark, path), "!platform_table_begin", "!platform_table_end")
    top = _first_lines(table).withColumn("c", F.split("line", "\t"))
    place = F.get(F.filter(F.transform("c", lambda x, i: F.when(x.isin(*candidates), i)), lambda x: x.isNotNull()), F.lit(0))
    head = top.select("file", F.col("at").alias("_at"), place.alias("place"))
    body = table.join(F.broadcast(head), "file").where("at > _at").withColumn("c", F.split("line", "\t")).withColumn("gene", F.get("c", F.col("place")))
    return body.where(~F.col("c")[0].isin("", "---")).select("file", F.col("c")[0].alias("probe_id"), F.when(~F.col("gene").isin(*NO_GENE), F.col("gene")).alias("gene"))


def unique_names(names: Sequence[str]) -> list[str]:
    """IO6: repeated column names get __1, __2 and so on, past names that are there."""
    there, used = set(names), set()
    out = []
    for n in names:
        name, k = n, 0
        while name in used or (k and name in there):
            k += 1
            name = f"{n}__{k}"
        used.add(name)
        out.append(name)
    return out


def sdrf(spark: SparkSession, path: str) -> DataFrame:
    """IO6: tab-separated sample annotation, all text, with trimmed column names made unique; ``file`` names the source.

    Each file is read by its own header. Files of one header are read together; columns that a file lacks are null.
    """
    lines = ordered_lines(spark, path)
    top = _first_lines(lines).select("file", F.col("at").alias("_at"), F.col("line").alias("_head"))
    body = lines.join(F.broadcast(top), "file").where("at > _at").select("file", "_head", F.split("line", "\t").alias("c"))
    out = None
    for row in top.groupBy("_head").agg(F.min("file").alias("file")).orderBy("file").collect():  # one for each layout
        names = unique_names([n.strip() for n in row["_head"].split("\t")])
        part = body.where(F.col("_head") == row["_head"]).select(F.col("file").alias("file"), *[F.get("c", F.lit(k)).alias("file__1" if n == "file" else n) for k, n in enumerate(names)])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return spark.createDataFrame([], "file string") if out is None else out


def pick_column(df: DataFrame, patterns: Sequence[str]) -> str | None:
    """IO6: the first column that matches the first matching pattern."""
    import re

    return next((c for p in patterns for c in df.columns if re.search(p, c, re.IGNORECASE)), None)


def magetab(spark: SparkSession, path: str, value_column: str | None = None) -> DataFrame:
    """IO7: (file, probe_id, sample_id, value) of matrices with two header rows: sample names and kinds of value.

    Only columns of the given kind (all, if none is given); repeated samples of a file are averaged over their numbers.
    """
    lines = ordered_lines(spark, path)
    top = _first_lines(lines, 2).withColumn("c", F.split("line", "\t"))
    names = top.where("r = 1").select("file", F.posexplode(_rest()).alias("place", "sample_id"))
    kinds = top.where("r = 2").select("file", F.col("at").alias("_at"), F.posexplode(_rest()).alias("place", "kind"))
    head = names.join(kinds.drop("_at"), ["file", "place"])
    head = head if value_column is None else head.where(F.col("kind") == value_column)
    body = lines.join(F.broadcast(top.where("r = 2").select("file", F.col("at").alias("_at"))), "file").where("at > _at").withColumn("c", F.split("line", "\t"))
    cells = body.select("file", F.col("c")[0].alias("probe_id"), F.posexplode(_rest()).alias("place", "value"))
    return cells.join(_headers(head), ["file", "place"]).groupBy("file", "probe_id", "sample_id").agg(F.avg(number(F.col("value"))).alias("value"))


def unlabelled_matrix(spark: SparkSession, path: str) -> DataFrame:
    """IO8: (file, probe_id, sample_id, value) of matrices whose header may lack the id column; the first row of a probe that a file repeats counts.

    A file whose rows are neither as long as the header nor one longer gives no rows.
    """
    lines = ordered_lines(spark, path)
    top = _first_lines(lines)
    split = lambda d: d.withColumn("c", F.transform(F.split("line", "\t"), lambda x: F.regexp_replace(x, '^"|"$', "")))
    body = split(lines.join(F.broadcast(top.select("file", F.col("at").alias("_at"), F.size(F.split("line", "\t")).alias("wide"))), "file").where("at > _at"))
    first = body.groupBy("file", "wide", F.col("c")[0].alias("probe_id")).agg(F.min_by("c", "at").alias("c"))
    cells = first.withColumn("ids", F.col("wide") - F.size("c") + 1).where("ids IN (0, 1)").select("file", "probe_id", "ids", F.posexplode(_rest()).alias("place", "value"))
    head = split(top).select("file", F.posexplode("c").alias("at_head", "sample_id"))
    both = cells.withColumn("at_head", F.col("place") + F.col("ids")).join(_headers(head), ["file", "at_head"])
    return both.select("file", "probe_id", "sample_id", number(F.col("value")).alias("value"))


def portal_clinical(spark: SparkSession, path: str) -> DataFrame:
    """IO9: tab-separated clinical file with # lines; trimmed, blank and NA are null."""
    df = spark.read.csv(path, sep="\t", header=True, comment="#")
    return df.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin("", "NA"), F.trim(F.col(f"`{c}`"))).alias(c) for c in df.columns])


def decimal_comma(spark: SparkSession, path: str) -> DataFrame:
    """IO10: semicolon-separated matrix with decimal commas, long; the first comma of a cell is its decimal point."""
    df = spark.read.csv(path, sep=";", header=True)
    return melt(df.select(df.columns[0], *[F.regexp_replace(F.col(f"`{c}`"), "^([^,]*),", "$1.").alias(c) for c in df.columns[1:]]), df.columns[0])


def write_csv(df: DataFrame, path: str) -> None:
    """IO11: CSV with a header, nulls empty."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_curated(df: DataFrame, path: str, by: str = "dataset") -> None:
    """IO11: Parquet by dataset."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def load_gate(catalog: DataFrame, existing: DataFrame, forced: Sequence[str] = (), small: int = 79) -> DataFrame:
    """IO12: what happens to each cohort on loading: kept, skipped as small, or loaded. catalog: accession, n_expr."""
    there = existing.select("accession", F.lit(True).alias("there")).distinct()
    j = catalog.join(there, "accession", "left")
    return j.select("accession", "n_expr", F.when(F.col("there"), "kept").when((F.col("n_expr") <= small) & ~F.col("accession").isin(*forced), "skipped: small").otherwise("loaded").alias("action"))


def append_catalog(old: DataFrame, new: DataFrame) -> DataFrame:
    """IO13: rows of the catalog and new ones; the first per accession counts."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("accession").orderBy("_o", *[c for c in old.columns if c != "accession"])
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_o", "_r")


def align(df: DataFrame, columns: Sequence[str], aliases: Mapping[str, str] | None = None) -> DataFrame:
    """IO14: target columns from exact, then case-insensitive, then alias names, else null."""
    aliases = aliases or {"sex": "gender", "gender": "sex"}
    low = {c.lower(): c for c in df.columns}
    pick = lambda c: c if c in df.columns else low.get(c.lower()) or low.get(aliases.get(c.lower(), ""))
    return df.select(*[F.col(f"`{pick(c)}`").alias(c) if pick(c) else F.lit(None).cast("string").alias(c) for c in columns])
