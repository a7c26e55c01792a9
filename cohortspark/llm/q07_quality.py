"""Query op7: quality of every document."""

from cohortspark.llm.quality import score, train
from cohortspark.llm.tables import table

NAME = "op7_quality"
SQL = None


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
