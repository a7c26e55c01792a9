"""Query op1: licence phrases and templates in every document."""

from cohortspark.llm.licenses import PHRASES, TEMPLATES, parse, scan
from cohortspark.llm.tables import table

NAME = "op1_license_scan"


def query(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).drop("matches")


def _pattern(parts):
    """A regular expression over words, each followed by one space."""
    return "".join(x.decode() + " " if isinstance(x, bytes) else f"(?:{_pattern(x[1])})?" if x[0] == "optional" else f"(?:[^ ]+ ){{{x[1]},}}" for x in parts)


_HITS = ", ".join(f"CASE WHEN regexp_matches(line, ' {_pattern(parse(t))}') THEN '{label}' END" for label, t in TEMPLATES.items())


def _starts(phrase):
    words = phrase.split()
    return "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words)) + ")"


SQL = f"""
WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS line,
      {", ".join(f"{_starts(p)} AS p{k}" for k, (p, _) in enumerate(PHRASES))} FROM a),
c AS (SELECT *, list_concat({", ".join(f"p{k}" for k in range(len(PHRASES)))}) AS places,
      list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))}], lambda x: x IS NOT NULL) AS base,
      list_filter([{_HITS}], lambda x: x IS NOT NULL) AS more FROM b)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base, more))), ','), '') AS labels,
       CASE WHEN len(more) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM c
"""
