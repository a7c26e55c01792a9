"""Query op13: the collocations of every language."""

from cohortspark.llm.phrases import collocations
from cohortspark.llm.tables import table

NAME = "op13_collocations"


def query(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""
WITH p AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
q AS (SELECT doc, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS no FROM p),
s AS (SELECT doc, lang, no, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM q),
t AS (SELECT doc, lang, no, unnest(ws) AS w1, generate_subscripts(ws, 1) AS pos FROM s),
u AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM t WINDOW o AS (PARTITION BY doc, no ORDER BY pos)),
total AS (SELECT lang, count(*) AS n FROM u GROUP BY lang),
g AS (SELECT lang, w1 AS phrase, 1 AS k, count(*) AS f FROM u GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM u WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM u WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4, count(*) FROM u WHERE w4 IS NOT NULL GROUP BY ALL),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND f >= 30),
i AS (SELECT lang, k, a, w, unnest(range(1, k)) AS start FROM c WHERE k > 2),
j AS (SELECT lang, a, w, start, unnest(range(start + 1, k + 1)) AS stop, k FROM i),
taken AS (SELECT lang, array_to_string(w[start:stop], ' ') AS phrase, max(a) AS most FROM j WHERE stop - start + 1 < k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN taken USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
x AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS split FROM kept),
y AS (SELECT x.lang, x.phrase, a, split, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM x JOIN g l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:split], ' ') JOIN g r ON r.lang = x.lang AND r.phrase = array_to_string(w[split + 1:x.k], ' ')),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, split) AS b FROM y),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z WHERE b = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
