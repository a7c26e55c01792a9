"""Query op8: language of every document."""

from cohortspark.llm.language import predict, train
from cohortspark.llm.tables import table

NAME = "op8_language_id"
SQL = None


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
