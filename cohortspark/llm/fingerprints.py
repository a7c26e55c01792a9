"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Five-word shingles are hashed once; the hash names a bin and a value, and each bin keeps its least value. An empty bin
takes the value of a filled one chosen by a hash of (bin, attempt) alone, so equal sets fill alike. Of each value the low
BITS bits are stored; likeness corrects the share of equal entries for chance agreement.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from cohortspark.llm._arrow import map_arrow
from cohortspark.llm._sample import drawn
from cohortspark.llm._words import mix, shingle_sets, slices

BINS, BITS = 128, 8
_SHIFT = np.uint64(64 - (BINS - 1).bit_length())
#: Rows of a range of ids that share a task while neighbours are matched.
RANGE_ROWS = 500
MOST_RANGES = 100_000
_DRAWS = [mix(np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 7919 + 1)) % np.uint64(BINS) for k in range(64)]


def sketch(hashes: np.ndarray) -> np.ndarray | None:
    """BINS entries of BITS bits for the distinct shingle hashes; None for an empty set."""
    if not len(hashes):
        return None
    h = mix(hashes)
    where = (h >> _SHIFT).astype(np.int64)
    least = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, where, h)
    full = np.zeros(BINS, dtype=bool)
    full[where] = True
    todo = np.flatnonzero(~full)
    attempt = 0
    while len(todo):
        draw = _DRAWS[attempt] if attempt < len(_DRAWS) else mix(np.arange(BINS, dtype=np.uint64) + np.uint64(attempt << 20)) % np.uint64(BINS)
        source = draw[todo].astype(np.int64)
        hit = full[source]
        least[todo[hit]] = least[source[hit]]
        todo = todo[~hit]
        attempt += 1
    return (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(entries: np.ndarray | None) -> str:
    """Hex of the entries; empty for an empty set."""
    return "" if entries is None else entries.tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity, 0 to 1. Two empty sets are alike, an empty and another one are not."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    return float(np.clip(((a == b).mean() - chance) / (1 - chance), 0, 1))


def likeness_of(a: str, b: str) -> float:
    """The same for packed fingerprints."""
    return likeness(*(np.frombuffer(bytes.fromhex(x), dtype=np.uint8) if x else None for x in (a, b)))


def marks(texts: pa.Array) -> list[np.ndarray | None]:
    """The sketch of every text."""
    flat, ends = shingle_sets(texts)
    return [sketch(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text (null: empty); repeated rows and null ids stay. Row-local."""

    def run(b):
        return {"doc_id": b.column("doc_id"), "fingerprint": [packed(m) for m in marks(b.column("text"))]}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fingerprint string", by_text="text")


def with_neighbours(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; one row per document.

    The edited text has its last floor(n_chars/3) code points replaced by the first as many (or all) of the next
    document in descending doc_id (after the last: the first). Ties of an id are ordered by the text's hash and text,
    null ids come last; an only document is its own next one. Null text counts as empty. An empty table gives an empty
    result.

    The order is cut into ranges of about ``range_rows`` rows (at most MOST_RANGES, so that the cuts stay small); cuts are
    quantiles of a drawn sample and only set the balance. Different texts of one id, or without one, may fall into several
    ranges. Each range also gets the first row of the range after it, so the text is shuffled once and a task holds one row
    besides the current batch. Other columns are ignored; every id from the least to the greatest long is allowed.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    parts = max(1, min(base.count() // range_rows, MOST_RANGES))
    place = [F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"), "hash"]
    some = sorted(drawn(base.select(*place), 20 * parts).toPandas().itertuples(index=False, name=None)) if parts > 1 else []
    cuts = sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []

    @F.pandas_udf("int")
    def number(none: pd.Series, down: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, k) for k in zip(none.tolist(), down.tolist(), h.tolist(), strict=True)], dtype=np.int32)

    order = [F.col("doc_id").isNull(), F.desc("doc_id"), "hash", "text"]
    ranged = base.withColumn("range", number(*place))
    # the first row of each range that has rows follows the range before; the very first follows the last
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("id"), "hash")
    firsts = ranged.groupBy("range").agg(F.min(key).alias("k")).select("range", "k.id", "k.hash").orderBy("range").collect()
    halo = [(firsts[i - 1]["range"], r["range"], r["id"], r["hash"]) for i, r in enumerate(firsts)]
    targets = F.broadcast(docs.sparkSession.createDataFrame(halo, "target int, range int, id long, hash long"))
    first = (
        ranged.join(targets, ["range", "hash"]).where(F.bitwise_not("doc_id").eqNullSafe(F.col("id")))
        .groupBy("target").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("target").alias("range"), F.xxhash64("text").alias("hash"), F.lit(True).alias("tail"))
    )
    both = ranged.withColumn("tail", F.lit(False)).unionByName(first).repartition("range").sortWithinPartitions("range", "tail", *order)

    kind = _parse_datatype_string(_SCHEMA)

    def run(batches):
        fields = to_arrow_schema(kind)
        held = None  # the row that waits for its next one: (range, doc_id, text, its sketch)
        for batch in batches:
            for part in slices(batch.column("text")):
                b = batch.slice(part.start, part.stop - part.start)
                done, held = paired(held, list(zip(*(b.column(c).to_pylist() for c in ("range", "doc_id", "text")), marks(b.column("text")), strict=True)), b.column("tail").to_pylist())
                if done:
                    new = marks(pa.array([x[2] for x in done]))
                    out = [[i, n, hashlib.sha256(e.encode()).hexdigest(), packed(own), packed(m), likeness(own, m), likeness(own, after)] for (i, n, e, own, after), m in zip(done, new, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for f, c in zip(fields, zip(*out, strict=True), strict=True)], schema=fields)

    return both.select("range", "doc_id", "text", "tail").mapInArrow(run, kind)


def paired(held, rows, tails):
    """(id, length, edited text, own sketch, next one's sketch) of the rows whose next row is there, and the row that waits."""
    done = []
    for row, tail in zip(rows, tails, strict=True):
        at, _, text, mark = row
        if held is not None and held[0] == at:
            _, i, before, own = held
            k = len(before) // 3
            done.append((i, len(before), before[: len(before) - k] + text[:k], own, mark))
        held = None if tail else row
    return done, held


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
