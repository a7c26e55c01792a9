"""Query op3: components of near-duplicate documents."""

from cohortspark.llm.neardups import near_duplicates
from cohortspark.llm.tables import table

NAME = "op3_ngram_jaccard"
SQL = None


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
