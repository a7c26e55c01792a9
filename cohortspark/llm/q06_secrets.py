"""Query op6: secrets in every document."""

from pyspark.sql import functions as F

from cohortspark.llm.secrets import scan
from cohortspark.llm.tables import model_path, table

NAME = "op6_secret_scan"
SQL = None


def query(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"), model_path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")
