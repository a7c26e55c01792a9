"""Phrase collocations by prefix-free parsing.

Every text is cut into overlapping chunks where its own words say so: a window of three words whose hash is a multiple of
CHUNK ends one chunk and begins the next. No chunk is the beginning of another that ends by a window too, and copies fall into the same chunks
wherever they stand, so the distinct chunks of a language with their numbers (the parse frequencies) stand for the
corpus. A phrase of up to four words lies whole in the chunk that holds its first word before the last window; phrases
that begin in the last window belong to the next chunk, so each occurrence is counted once. Phrases are counted inside
the distinct chunks, times their frequency, from one word upwards: a longer phrase is only counted where both
shorter ones in it are frequent, as a bitmap of fixed size says (a chance hit costs a count, not the result).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm._arrow import map_arrow
from cohortspark.llm._graph import keep
from cohortspark.llm._tokens import Words, kinds
from cohortspark.llm._words import mix

#: Words in a window (one less than in the longest phrase), and the mean number of words between windows that cut.
WINDOW, CHUNK = 3, 48
LONGEST = WINDOW + 1
#: Occurrences of a candidate, and the percentage of them that a longer phrase takes over.
LEAST, SUBSUMED = 30, 80
#: Rows of a language.
TOP = 2000
#: Bits of the bitmap of frequent phrases, and of one row of it.
BITS, ROW = 26, 6
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Words stand between blanks, pieces between these marks.
_KIND = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")


def phrase_hashes(words: np.ndarray, lang: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the phrases of n words that begin at each word (the last n - 1 have none); lang: a hash for each word."""
    full = len(words) - n + 1
    return mix(sum(words[k : full + k] * _ODD[k] for k in range(n)) + lang[:full] * np.uint64(2 * n + 1))


def chunks(docs: DataFrame) -> DataFrame:
    """The distinct chunks of each language: lang, ends (nothing follows it in its text), chunk (bytes), n (parse frequency)."""

    def work(part: pa.RecordBatch) -> dict:
        words = Words(part.column("text"), _KIND)
        h, count = words.hashes(), np.diff(words.bounds)
        cut = np.zeros(len(h), dtype=bool)
        if len(h) >= WINDOW:
            full = len(h) - WINDOW + 1
            cut[:full] = mix(sum(h[k : full + k] * _ODD[k] for k in range(WINDOW))) % np.uint64(CHUNK) == 0
            cut[:full] &= words.text[:full] == words.text[WINDOW - 1 :]
        cut[words.bounds[:-1][count > 0]] = True
        first = np.flatnonzero(cut)
        stop = np.append(first[1:], len(h))
        ends = np.append(words.text[first[1:]] != words.text[first[:-1]], True) if len(first) else np.zeros(0, dtype=bool)
        last = np.where(ends, stop, np.minimum(stop + WINDOW, len(h))) - 1
        data = words.data.tobytes()
        return {"lang": part.column("lang").take(pa.array(words.text[first])), "ends": pa.array(ends), "chunk": pa.array([data[a:b] for a, b in zip(words.start[first].tolist(), words.end[last].tolist(), strict=True)], type=pa.binary())}

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(rows, work, "lang string, ends boolean, chunk binary", "text").groupBy("lang", "ends", "chunk").agg(F.count(F.lit(1)).alias("n"))


def _ids(columns: list[np.ndarray]) -> np.ndarray:
    """Positions of one row of each distinct combination of the columns, and the combination of each row."""
    key = columns[0]
    for c in columns[1:]:
        wide = int(c.max(initial=0)) + 1
        if int(key.max(initial=0)) + 1 > (1 << 62) // wide:
            key = np.unique(key, return_inverse=True)[1]
        key = key * wide + c
    return np.unique(key, return_index=True, return_inverse=True)[1:]


def counted(parsed: DataFrame, size: int, frequent: np.ndarray | None) -> DataFrame:
    """lang, phrase, f: occurrences of phrases of so many words in the parsed corpus.

    frequent: the bitmap of shorter phrases; phrases with a part that is not in it may be left out.
    """
    shared = parsed.sparkSession.sparkContext.broadcast(frequent)

    def work(part: pa.RecordBatch) -> dict:
        words = Words(part.column("chunk"), _KIND)
        code, known, h = words.coded()
        if len(code) < size:
            return {"lang": [], "phrase": [], "f": []}
        langs = part.column("lang").dictionary_encode()
        lang_h = mix(np.array([int.from_bytes(x.encode()[:8].ljust(8), "little") + len(x) for x in langs.dictionary.to_pylist()], dtype=np.uint64))
        lang = langs.indices.to_numpy().astype(np.int64)[words.text]
        ends, n = part.column("ends").to_numpy(zero_copy_only=False)[words.text], part.column("n").to_numpy(zero_copy_only=False)[words.text]
        # a phrase belongs to the chunk with its first word, but for the last window
        full = len(code) - size + 1
        use = (ends | (np.arange(len(code)) < words.bounds[1:][words.text] - WINDOW))[:full]
        for k in range(size - 1):
            use = use & words.joined[k : full + k]
        if size > 1:
            at = phrase_hashes(h[code], lang_h[lang], size - 1)
            bit = at >> np.uint64(64 - BITS)
            hit = (shared.value[(bit >> np.uint64(ROW)).astype(np.int64)] >> (bit & np.uint64((1 << ROW) - 1)) & np.uint64(1)).astype(bool)
            use &= hit[:full] & hit[1:]
        where = np.flatnonzero(use)
        first, of = _ids([lang[where], *(code[where + k] for k in range(size))])
        total = np.zeros(len(first), dtype=np.int64)
        np.add.at(total, of, n[where])
        where = where[first]
        text = known.take(pa.array(code[where]))
        for k in range(1, size):
            text = pc.binary_join_element_wise(text, known.take(pa.array(code[where + k])), pa.scalar(b" ", pa.large_binary()))
        return {"lang": langs.dictionary.take(pa.array(lang[where])), "phrase": text.cast(pa.large_string()).cast(pa.string()), "f": pa.array(total)}

    return map_arrow(parsed, work, "lang string, phrase string, f long", "chunk").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bitmap(grams: DataFrame, size: int) -> np.ndarray:
    """The phrases as 2^BITS bits by their hashes, made of at most 2^(BITS - ROW) sums."""

    def work(part: pa.RecordBatch) -> dict:
        words = Words(part.column("phrase"), _KIND)
        langs = np.array([int.from_bytes(x.encode()[:8].ljust(8), "little") + len(x) for x in part.column("lang").to_pylist()], dtype=np.uint64)
        h = phrase_hashes(words.hashes(), mix(langs)[words.text], size)[::size] if len(words.size) else np.zeros(0, dtype=np.uint64)
        bit = h >> np.uint64(64 - BITS)
        return {"row": pa.array((bit >> np.uint64(ROW)).astype(np.int64)), "bit": pa.array((bit & np.uint64((1 << ROW) - 1)).astype(np.int32))}

    rows = map_arrow(grams.select("lang", "phrase"), work, "row long, bit int", "phrase").groupBy("row").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - ROW), dtype=np.uint64)
    out[rows.column("row").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def collocations(docs: DataFrame, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """The phrases of two to four words of each language whose words stand together most: lang, rank, phrase, a, l, r, n, score.

    a: occurrences, at least ``least``; cut after some word, l and r: those of its parts; score: floor(2000000 * a / (l + r)) of the
    lowest cut (of equal ones the first); n: words of the language. A phrase inside a longer one that has ``subsumed`` percent of
    its occurrences or more is left out. Equal scores fall to the larger a, then to the lesser phrase in UTF-8 order. Null
    text counts as empty and null language as und; repeated rows count as often as they stand; an empty table gives no rows;
    other columns are not read. Words of any length and texts of any length count whole.
    """
    parsed = keep(chunks(docs))
    words = keep(counted(parsed, 1, None))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = [keep(words.where(F.col("f") >= least))]
    for size in range(2, LONGEST + 1):
        found.append(keep(counted(parsed, size, bitmap(found[-1], size - 1)).where(F.col("f") >= least)))
    grams = found[0]
    for more in found[1:]:
        grams = grams.unionByName(more)
    several = None
    for size in range(2, LONGEST + 1):
        part = found[size - 1].withColumn("w", F.split("phrase", " ")).withColumn("k", F.lit(size))
        several = part if several is None else several.unionByName(part)
    piece = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    # what a longer phrase takes over
    inner = several.where("k > 2").select("lang", "f", F.explode(F.expr("flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1), i -> array_join(slice(w, i, n), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("taken"))
    left = several.join(inner, ["lang", "phrase"], "left").where(f"taken IS NULL OR CAST(taken AS DECIMAL(20, 0)) * 100 < CAST(f AS DECIMAL(20, 0)) * {int(subsumed)}")
    cut = left.select("lang", "phrase", F.col("f").alias("a"), "w", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("at"))
    cut = cut.select("lang", "phrase", "a", "at", piece(F.lit(1), F.col("at")).alias("head"), piece(F.col("at") + 1, F.col("k") - F.col("at")).alias("tail"))
    part = lambda name, value: grams.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cut = cut.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    cut = cut.withColumn("score", F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) div (CAST(l AS DECIMAL(20, 0)) + r)"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each share of a language, then of the language: no task has all candidates of a language
    share = best.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    share = share.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
