"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Text that a byte-level vocabulary was made from packs several characters in a token; random strings pack few. A run of
key-like characters whose ratio of characters to tokens stays below a limit is taken for a secret, unless it is a known
kind of digest or identifier.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._arrow import map_batches
from cohortspark.llm._words import slices

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Candidates of the token test: long runs of key-like characters.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Known digests (hexadecimal in either case, at the usual lengths) and identifiers: UUIDs, numbers and dates,
#: and words or short numbers between single marks. No two alternatives of a part fit the same text, so time is linear.
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
_IDENTIFIER = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9/_+=-]+|(?:[a-z]+|[0-9]{1,4})(?:[-_/](?:[a-z]+|[0-9]{1,4}))*", re.IGNORECASE)
#: Characters a token below which a run counts as random.
MAX_RATIO = 2.2


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """The tiktoken encoding of a rank file, looked up as given, then among the files Spark has shipped."""
    import public_tokenizers
    import tiktoken

    if not os.path.exists(path):
        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and non-overlapping within each kind."""
    low = text.encode().lower()
    out = []
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def random_spans(text: str, encode, max_ratio: float, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs that the token test finds random and that no other span touches.

    Runs and spans are read side by side in order of their starts, so time grows with their number.
    """
    out, order, k, far = [], sorted((s, e) for _, s, e in taken), 0, 0
    for m in _RUN.finditer(text):
        run, a, b = m[0], m.start(), m.end()
        while k < len(order) and order[k][0] < b:
            far = max(far, order[k][1])
            k += 1
        if far > a:
            continue
        if _DIGEST.fullmatch(run) or _IDENTIFIER.fullmatch(run) or not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)):
            continue
        if len(run) / len(encode(run)) < max_ratio:
            out.append(("random", a, b))
    return out


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def scan(docs: DataFrame, vocabulary_path: str, max_ratio: float = MAX_RATIO, redact: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_spans and spans (text form: kind:start:end).

    Positions are code points, end exclusive, over the whole match. With ``redact`` the column ``redacted`` holds the
    text with every stretch of spans replaced by it (null text stays null); else it is null. Null text counts as empty;
    repeated rows and null ids stay; an empty table gives an empty result. Row-local, no shuffle.
    """

    def make():
        encode = vocabulary(vocabulary_path).encode_ordinary

        def one(text):
            base = base_spans(text or "")
            spans = base + random_spans(text or "", encode, max_ratio, base)
            count = {k: sum(s[0] == k for s in spans) for k in KINDS}
            return (*(count[k] for k in KINDS), spelled(base), spelled(spans), hide(text, spans, redact) if redact is not None and text else text if redact is not None else None)

        names = ("n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans", "redacted")

        def work(cols):
            rows = [one(t) for t in cols["text"]]
            return {n: cols[n] for n in cols if n != "text"} | {n: [r[k] for r in rows] for k, n in enumerate(names)}

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string, redacted string")


def hide(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with each stretch of overlapping spans replaced."""
    parts, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, vocabulary_path: str, mark: str = "<SECRET>", max_ratio: float = MAX_RATIO) -> DataFrame:
    """The documents with their secrets replaced by ``mark``; same columns and rows, n_chars follows the new text."""

    at = docs.columns.index("text")

    def run(batches):
        encode = vocabulary(vocabulary_path).encode_ordinary

        def safe(text):
            if not text:
                return text
            base = base_spans(text)
            return hide(text, base + random_spans(text, encode, max_ratio, base), mark)

        for b in batches:
            for part in slices(b.column("text")):
                piece = b.slice(part.start, part.stop - part.start)
                yield piece.set_column(at, piece.schema.field(at), pa.array(map(safe, piece.column(at).to_pylist()), piece.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
