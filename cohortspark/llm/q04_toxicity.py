"""Query op4: toxicity of every document."""

from cohortspark.llm.tables import table
from cohortspark.sources.shared import shared_dir
from cohortspark.llm.toxicity import score, train

NAME = "op4_toxicity"
SQL = None


def query(spark, sf_dir):
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
