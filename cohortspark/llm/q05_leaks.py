"""Query op5: test items found in documents."""

from cohortspark.llm.leaks import leaks
from cohortspark.llm.tables import table

NAME = "op5_decontamination"
SQL = None


def query(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
