"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from cohortspark.llm import q01_licenses, q02_pieces, q03_neardups, q04_toxicity, q05_leaks, q06_secrets, q07_quality, q08_language, q09_fingerprints, q10_urls, q11_personal, q12_ranking, q13_phrases

MODULES = (q01_licenses, q02_pieces, q03_neardups, q04_toxicity, q05_leaks, q06_secrets, q07_quality, q08_language, q09_fingerprints, q10_urls, q11_personal, q12_ranking, q13_phrases)


def queries():
    return {m.NAME: m.query for m in MODULES}


def oracle_sql():
    return {m.NAME: m.SQL for m in MODULES if m.SQL}
