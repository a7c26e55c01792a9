"""URL filter: a weighted vocabulary found by one automaton, and host and path rules that go first.

Strict terms weigh as much as the limit, soft terms less; a URL is blocked when the weights of the distinct terms in it
reach the limit, so by one strict term or several distinct soft ones. The built-in vocabulary is small; a larger one is
read from a table of terms and weights. A term counts only between boundaries: the ends
of the URL or characters other than a-z and 0-9 (A-Z are lower-cased first).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._arrow import map_batches

STRICT = ("casino", "casinos", "porn", "porno", "xxx", "viagra", "cialis", "escort", "escorts", "hentai", "gambling", "warez")
SOFT = ("adult", "bet", "bets", "betting", "bonus", "cheap", "crack", "dating", "free", "jackpot", "lottery", "nude", "pharmacy", "pills", "poker", "sexy", "slots", "win", "winner", "wins")
#: Distinct soft terms that together block.
SOFT_LIMIT = 2
#: (verdict, host, path): a rule fits its host and all subdomains of it where the URL's path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


def rule_for(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits, or None; of equally long ones the first."""
    best = None
    for verdict, at, start in rules:
        if (host == at or host.endswith("." + at)) and path.startswith(start) and (best is None or len(at + start) > len(best[0])):
            best = at + start, verdict
    return best


#: Terms and weights of the built-in vocabulary.
WEIGHTS = dict.fromkeys(SOFT, 1.0) | dict.fromkeys(STRICT, float(SOFT_LIMIT))
#: Most terms of a vocabulary: it is sent to every task.
MOST_TERMS = 1_000_000


def vocabulary(terms: DataFrame, most: int = MOST_TERMS) -> dict[str, float]:
    """Weights by term (A-Z lower-cased, as in URLs) from a table (term, weight); of a repeated term the largest counts.

    Null and empty terms and weights that are null or not above 0 are left out. More terms than ``most`` are an error.
    """
    t = terms.select(F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("term"), F.col("weight").cast("double").alias("weight")).where("term <> '' AND weight > 0").groupBy("term").agg(F.max("weight").alias("weight"))
    rows = t.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of more than {most} terms")
    return {r["term"]: r["weight"] for r in rows}


def automaton(terms: Sequence[str]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for t in terms:
        auto.add_word(t, t)
    auto.make_automaton()
    return auto


def term_hits(url: str, auto: ahocorasick.Automaton) -> set[str]:
    """Distinct terms between boundaries."""
    if not len(auto):
        return set()
    low = url.translate(_LOWER)
    found = set()
    for end, term in auto.iter(low):
        start = end + 1 - len(term)
        if (start == 0 or low[start - 1] not in _ALNUM) and (end + 1 == len(low) or low[end + 1] not in _ALNUM):
            found.add(term)
    return found


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, weights: Mapping[str, float] | None = None, limit: float = SOFT_LIMIT) -> DataFrame:
    """One row per page: page_id, host, path, rule (null without one), verdict, strict_hits, soft_hits (distinct terms).

    A term is strict if it weighs ``limit`` or more. A null or empty url has no host, path, rule or hits and is allowed.
    Repeated rows and null ids stay, other columns are ignored (the html column is never read), an empty table gives an
    empty result. Row-local, no shuffle.
    """
    rules, weights = tuple(rules), dict(WEIGHTS if weights is None else weights)

    def make():
        auto = automaton(list(weights))

        def work(cols):
            out = {k: [] for k in ("host", "path", "rule", "verdict", "strict_hits", "soft_hits")}
            for url in cols["url"]:
                host, path = split_url(url)
                hits = [weights[t] for t in term_hits(url or "", auto)]
                hard = sum(w >= limit for w in hits)
                rule = rule_for(host, path, rules)
                out["host"].append(host)
                out["path"].append(path)
                out["rule"].append(rule and rule[0])
                out["verdict"].append(rule[1] if rule else "block" if sum(hits) >= limit else "allow")
                out["strict_hits"].append(hard)
                out["soft_hits"].append(len(hits) - hard)
            return out | {"page_id": cols["page_id"]}

        return work

    return map_batches(pages.select("page_id", "url"), make, "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long")
