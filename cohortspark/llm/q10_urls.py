"""Query op10: verdict on every page's URL."""

from cohortspark.llm.tables import table
from cohortspark.llm.urls import RULES, SOFT, SOFT_LIMIT, STRICT, judge

NAME = "op10_url_filter"


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


def _hits(terms):
    return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in terms)


def _fits(host, path):
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_LONGEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_RULE = "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in _LONGEST) + " END"
_VERDICT = "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in _LONGEST) + f" WHEN {SOFT_LIMIT} * strict_hits + soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u, translate(coalesce(url, ''), {_AZ}) AS low FROM pages),
b AS (SELECT *, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM b),
d AS (SELECT *, translate(raw, {_AZ}) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path,
      {_hits(STRICT)} AS strict_hits, {_hits(SOFT)} AS soft_hits FROM c)
SELECT page_id, host, path, {_RULE} AS rule, {_VERDICT} AS verdict, strict_hits, soft_hits FROM d
"""
