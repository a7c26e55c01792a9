"""A corpus pipeline of five operators: quality, near-duplicates, decontamination, secrets, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm._graph import keep
from cohortspark.llm.leaks import without_leaks
from cohortspark.llm.neardups import one_each
from cohortspark.llm.pieces import encode_decode
from cohortspark.llm.quality import accepted, train
from cohortspark.llm.secrets import redact
from cohortspark.llm.tables import model_path, table


#: Rows of a record batch that goes to Python: texts are long, and a batch is there on both sides at once.
BATCH_ROWS = 1_000


def _modest(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of these documents, does not reject."""
    _modest(spark)
    return accepted(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: one with the least id; repeated rows and rows without an id count."""
    _modest(spark)
    return one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _modest(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their text replaced by a mark."""
    _modest(spark)
    return redact(docs, model_path("byte_bpe_50k.tiktoken"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the text they decode to."""
    _modest(spark)
    return encode_decode(docs, model_path("piece_bpe_32k.model"), with_ids=True).drop("decoded")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicate),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", pieces),
]

#: SQL cannot express the classifier, the redaction or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
