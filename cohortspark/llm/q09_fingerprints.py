"""Query op9: fingerprints of every document and its edited text."""

from cohortspark.llm.fingerprints import with_neighbours
from cohortspark.llm.tables import table

NAME = "op9_fingerprints"
SQL = None


def query(spark, sf_dir):
    return with_neighbours(table(spark, sf_dir, "documents"))
