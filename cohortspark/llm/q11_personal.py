"""Query op11: personal data in every document."""

from pyspark.sql import functions as F

from cohortspark.llm.personal import scan, train
from cohortspark.llm.tables import table

NAME = "op11_personal_data"
SQL = None


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")
