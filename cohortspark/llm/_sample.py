"""Bounded, repeatable samples of rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 32


def remainder(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % k


def drawn(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows at most, drawn by a hash of the whole row: the same ones in every run and for every partitioning.

    Equal rows of a larger table are drawn together and put down to one, so one id with very many rows, alike or not,
    makes the sample no larger.
    """
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*df.columns, F.lit(17)), F.lit(_SPACE)) < F.lit(int(_SPACE * rows / n))).dropDuplicates()


def drawn_with(df: DataFrame, column: str, rows: int, least: int, most: int) -> DataFrame:
    """``drawn``, and of each value of the column that has few rows in it about ``least`` (or all it has).

    More than ``most`` such values are an error, so the sample stays bounded; the values are counted over the whole table.
    """
    n = df.count()
    if n <= rows:
        return df
    few = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * F.lit(rows / n) < least)
    if few.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rare values of {column}")
    draw = F.pmod(F.xxhash64(*df.columns, F.lit(19)), F.lit(_SPACE)) < F.lit(float(_SPACE * least)) / F.col("_n")
    return drawn(df, rows).unionByName(df.join(F.broadcast(few), column).where(draw).drop("_n").select(*df.columns)).dropDuplicates()


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, modulus: int, held: int) -> DataFrame:
    """doc_id, label, text of at most about ``rows`` labelled documents outside the held-out remainder.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the largest counts, of several
    texts the greatest. The ids are so few that they are broadcast; documents are read once.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held))
    ids = drawn(ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")), rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text"))
