"""N-gram Jaccard join with adaptive multi-match prefixes.

A text is the set of its distinct five-word shingles; two texts link when 100 * |A & B| >= 75 * |A | B|. Shingles stand in
one global order: those that a count sketch of the corpus finds frequent last, the others by hash. A partner shares at
least ceil(0.75 n) of a text's n shingles, so the prefixes of n - ceil(0.75 n) + m shingles of two such texts share at
least m. Each text takes the m (1 to MOST_MATCHES) with the least estimated cost of candidates: a longer prefix that must
show more shared shingles, min(m) of the two, before the pair is verified on the whole sets.

Only components are asked for, so links inside what is already one component are not looked for. Rounds first try the
texts of each large group (texts that share a prefix shingle) against one drawn member; the exact round then takes all
pairs of different components. There the texts of a large group that are outside its greatest component are compared with all of
it, block by block inside tasks, by parity bitmaps of the sets, and a pair leaves once: from the first large group that holds
both, with the number of groups that do.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._arrow import map_arrow
from cohortspark.llm._graph import components, small_batches
from cohortspark.llm._graph import keep_in_few as keep
from cohortspark.llm._words import mix, shingle_sets, slices

#: Similarity limit in hundredths.
LIMIT = 75
MOST_MATCHES = 4
#: Cost of verifying a pair against that of reading one posting.
VERIFY_COST = 8.0
#: Bins of the count sketch (fixed size, broadcast as one byte each), and ranges of bins that tasks sum.
SKETCH_BITS, RANGES = 21, 64
#: Postings of a shingle whose bin has this level are dealt to two tasks, of the next level to four, and so on.
SPLIT_LEVEL = 10
#: Groups of texts at a shingle above this size are linked by rounds first, then compared in blocks of so many texts; the
#: pairs of smaller groups are rows, which up to about this size are fewer bytes than what a block needs of each text.
LARGE, BLOCK = 32, 1024
#: Another linking round follows one in which at least one of so many tried pairs linked (no effect on results).
WORTH_A_ROUND = 4
#: Number of shared prefix shingles of a pair that was drawn, not counted.
UNCOUNTED = 1 << 30
#: Bits of a parity bitmap: four for each shingle within these bounds.
LEAST_BITS, MOST_BITS = 256, 4096
#: Least and most bits of the filter that keeps most texts out of a verification; eight for each wanted text between.
FILTER_BITS = (1 << 20, 1 << 27)
_BINS = 1 << SKETCH_BITS


def linked(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= LIMIT * (a + b - shared)


def node_of(s: np.ndarray) -> bytes:
    """128-bit name of a set of shingles."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of a power of two of bins. Bins of a half fold by exclusive or."""
    bits = int(min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(s) - 1).bit_length())))
    at = (mix(s) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(b: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded to so many words."""
    while b.shape[-1] > words:
        half = b.shape[-1] // 2
        b = b[..., :half] ^ b[..., half:]
    return b


def may_link(na: int, a: bytes, nb: int, b: bytes) -> bool:
    """False only if sizes or bitmaps show that the sets cannot link."""
    return bool(may_link_all(np.array([na]), [a], np.array([nb]), [b])[0])


def may_link_all(na: np.ndarray, a: list[bytes], nb: np.ndarray, b: list[bytes]) -> np.ndarray:
    """The same for many pairs: those with bitmaps of two given sizes at once."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    apart = np.zeros(len(a), dtype=np.int64)
    for x, y in set(zip(la.tolist(), lb.tolist(), strict=True)):
        at = np.flatnonzero((la == x) & (lb == y))
        whole = lambda maps, size: np.frombuffer(b"".join(maps[k] for k in at), dtype=np.uint64).reshape(len(at), size // 8)  # noqa: E731, B023
        apart[at] = np.bitwise_count(folded(whole(a, x), min(x, y) // 8) ^ folded(whole(b, y), min(x, y) // 8)).sum(axis=1, dtype=np.int64)
    total = na + nb
    shared = (total - apart) // 2
    return (100 * np.minimum(na, nb) >= LIMIT * np.maximum(na, nb)) & (100 * shared >= LIMIT * (total - shared))


class Prefix(NamedTuple):
    matches: int
    tokens: np.ndarray
    levels: np.ndarray
    #: Place of the last shingle of the prefix in the global order.
    last: int


def prefix_of(s: np.ndarray, level: np.ndarray) -> Prefix:
    """The adaptive prefix of a set: level holds, per bin of the sketch, the binary logarithm of its surplus count."""
    n = len(s)
    need = -(-LIMIT * n // 100)
    rank = level[(s & np.uint64(_BINS - 1)).astype(np.int64)]
    order = np.lexsort((mix(s), rank))
    most = min(MOST_MATCHES, need)
    first = n - need + 1
    cost = np.exp2(rank[order[: first + most - 1]].astype(float)).cumsum()
    total = [cost[first - 1 + k] * (1 + VERIFY_COST / (k + 1)) for k in range(most)]
    m = int(np.argmin(total)) + 1
    taken = order[: first + m - 1]
    return Prefix(m, s[taken], rank[taken], (int(rank[taken[-1]]) << 58) | int(mix(s[taken[-1:]])[0] >> np.uint64(6)))


def sketch(docs: DataFrame) -> np.ndarray:
    """Level of every bin: 0 for bins about the mean, else the logarithm of count over mean. All documents count.

    Tasks send dense counts by range of bins; other tasks sum each range as it streams by.
    """
    width = _BINS // RANGES

    def counted(batches):
        total = np.zeros(_BINS, dtype=np.int64)
        for b in batches:
            for part in slices(b.column(0)):
                hashes, _ = shingle_sets(b.column(0)[part])
                np.add.at(total, (hashes & np.uint64(_BINS - 1)).astype(np.int64), 1)
        if total.any():
            small = np.minimum(total, 2**31 - 1).astype(np.uint32).reshape(RANGES, width)
            # bytes of equal weight together: the high ones are nearly all 0 and pack well
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([r.view(np.uint8).reshape(-1, 4).T.tobytes() for r in small], pa.binary())], ["range", "counts"])

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = np.ascontiguousarray(np.frombuffer(c, dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                total[r] = total.get(r, 0) + counts.astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["range", "counts"])

    kind = "range int, counts binary"
    with small_batches(docs.sparkSession):
        rows = docs.select("text").mapInArrow(counted, kind).repartition(RANGES, "range").mapInArrow(summed, kind).collect()
    counts = np.zeros((RANGES, width), dtype=np.int64)
    for r in rows:
        counts[r["range"]] = np.frombuffer(r["counts"], dtype=np.int64)
    flat = counts.ravel()
    mean = max(1.0, flat.mean())
    surplus = np.maximum(flat - (mean + 6 * np.sqrt(mean)), 0)
    return np.where(surplus > 0, np.ceil(np.log2(surplus + 1)), 0).astype(np.uint8)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, print (a hash of the text), node (null for a text without words), n, matches, bitmap and prefix of every row.

    The prefix is in two parts: tokens, and split_tokens with the number of tasks that share the postings of each; last is the
    place of its end in the global order.
    """
    level = docs.sparkSession.sparkContext.broadcast(sketch(docs))

    def run(b):
        flat, ends = shingle_sets(b.column("text"))
        node, n, matches, last, maps, tokens, split, parts = [], np.diff(ends), [], [], [], [], [], []
        for x, y in zip(ends[:-1], ends[1:], strict=True):
            if x == y:
                for column, v in zip((node, matches, last, maps, tokens, split, parts), (None, 0, 0, None, [], [], []), strict=True):
                    column.append(v)
                continue
            s = flat[x:y]
            p = prefix_of(s, level.value)
            hot = p.levels >= SPLIT_LEVEL
            node.append(node_of(s))
            matches.append(p.matches)
            last.append(p.last)
            maps.append(bitmap(s))
            tokens.append(p.tokens[~hot].view(np.int64))
            split.append(p.tokens[hot].view(np.int64))
            parts.append(1 << (p.levels[hot].astype(np.int32) - SPLIT_LEVEL + 1))
        return {"doc_id": b.column("doc_id"), "print": b.column("print"), "node": node, "n": n, "matches": matches, "last": last, "bitmap": maps, "tokens": tokens, "split_tokens": split, "parts": parts}

    kind = "doc_id long, print long, node binary, n long, matches int, last long, bitmap binary, tokens array<long>, split_tokens array<long>, parts array<int>"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print")), run, kind, by_text="text")


def _shared_runs(batches):
    """Of postings sorted by token, those of tokens that come twice, with the number of each token's postings.

    A token has few postings here: its bin of the sketch is at most 2^SPLIT_LEVEL above the mean.
    """

    def put(t, n):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(t)) + 1, [len(t)]])
        size = np.repeat(np.diff(edges), np.diff(edges)).astype(np.int64)
        ok = size >= 2
        return pa.RecordBatch.from_arrays([pa.array(t[ok]), pa.array(n[ok]), pa.array(size[ok])], ["token", "id", "size"])

    t = n = np.zeros(0, dtype=np.int64)
    for b in batches:
        t, n = np.concatenate([t, b.column(0).to_numpy()]), np.concatenate([n, b.column(1).to_numpy()])
        cut = int(np.searchsorted(t, t[-1])) if len(t) else 0  # the last token may go on
        if cut:
            yield put(t[:cut], n[:cut])
            t, n = t[cut:], n[cut:]
    if len(t):
        yield put(t, n)


def shared_postings(texts: DataFrame) -> DataFrame:
    """(token, part, parts, id, size) of the prefix shingles that at least two texts have; size is their number of texts.

    Frequent shingles are dealt over parts by the text, so that no task gets all postings of one.
    """
    posts = texts.select(F.explode("tokens").alias("token"), "id").repartition("token").sortWithinPartitions("token", "id")
    kept = keep(posts.mapInArrow(_shared_runs, "token long, id long, size long"))
    split = texts.where(F.size("split_tokens") > 0).select("id", F.explode(F.arrays_zip(F.col("split_tokens").alias("token"), F.col("parts").alias("parts"))).alias("s"))
    split = split.select("s.token", F.pmod(F.xxhash64("id"), F.col("s.parts")).cast("int").alias("part"), "s.parts", "id")
    sizes = split.groupBy("token", "parts").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    counted = split.drop("parts").join(_by_part(sizes), ["token", "part"]).select("token", "part", "parts", "id", "size")
    return kept.select("token", F.lit(0).alias("part"), F.lit(1).alias("parts"), "id", "size").unionByName(keep(counted))


def _by_part(groups: DataFrame) -> DataFrame:
    """Rows with token and parts, once for each part: postings meet them without all of a token in one task."""
    return groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _small_pairs(batches):
    """Pairs (a < b) of the texts of each token, from postings sorted by token and text; groups have at most LARGE texts."""
    token = ids = np.zeros(0, dtype=np.int64)

    def put(t, i):
        a, b = [], []
        for k in range(1, LARGE):
            same = np.flatnonzero(t[k:] == t[:-k])
            a.append(i[same])
            b.append(i[same + k])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        token, ids = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((token, ids)))
        cut = int(np.searchsorted(token, token[-1])) if len(token) else 0
        if cut:
            yield put(token[:cut], ids[:cut])
            token, ids = token[cut:], ids[cut:]
    if len(token):
        yield put(token, ids)


def _blocks(df: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of every block of postings; rows come sorted by the keys, one block is in memory at a time."""
    df = df.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def flush():
            out = _block_pairs(last, pa.Table.from_batches(held).combine_chunks())
            if len(out["a"]):
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))

        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(k).to_numpy() for k in keys]
            edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            for x, y in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                key = tuple(int(c[x]) for c in columns)
                if held and key != last:
                    yield from flush()
                    held = []
                last = key
                held.append(b.slice(x, y - x))
        if held:
            yield from flush()

    return df.mapInArrow(run, "a long, b long, seen long")


def _block_pairs(key: tuple[int, int, int], rows: pa.Table) -> dict[str, list[int]]:
    """Pairs of different components that bitmaps leave, of a block of texts outside a large group's greatest component and a block of all.

    A pair of two texts outside comes from the one with the lesser number. A pair comes from the first large group that
    holds both of its texts only, with the number of those groups.
    """
    token, _, _ = key
    outside = rows.column("outside").to_numpy(zero_copy_only=False)
    sides = []
    for side in (np.flatnonzero(outside), np.flatnonzero(~outside)):
        part = rows.take(pa.array(side))
        n = part.column("n").to_numpy()
        order = np.argsort(n, kind="stable")
        lists = part.column("groups").combine_chunks()
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        groups = [flat[ends[k] : ends[k + 1]] for k in order]  # ascending
        maps = part.column("bitmap").to_pylist()
        raw = [np.frombuffer(maps[k], dtype=np.uint64) for k in order]
        sides.append((n[order], *(part.column(c).to_numpy(zero_copy_only=False)[order] for c in ("id", "label", "minor")), groups, np.array([g[0] for g in groups]), raw))
    (n, ids, label, _, groups, leads, raw), (n2, ids2, label2, minor2, groups2, leads2, raw2) = sides
    out: dict[str, list[int]] = {"a": [], "b": [], "seen": []}
    if not len(n) or not len(n2):
        return out
    level = {w: np.stack([folded(r, w) if len(r) >= w else np.zeros(w, np.uint64) for r in raw2]) for w in {len(r) for r in raw}}
    shorter = {w: np.array([len(r) < w for r in raw2]) for w in level}
    for i in range(len(n)):
        first, end = int(np.searchsorted(n2, -(-n[i] * LIMIT // 100))), int(np.searchsorted(n2, n[i] * 100 // LIMIT, side="right"))
        at = np.arange(first, end)
        at = at[(label2[at] != label[i]) & (~minor2[at] | (ids2[at] > ids[i]))]
        if leads[i] != token:  # the same first group, before this one
            at = at[leads2[at] != leads[i]]
        if not len(at):
            continue
        w = len(raw[i])
        apart = np.bitwise_count(level[w][at] ^ raw[i]).sum(axis=1, dtype=np.int64)
        for j in np.flatnonzero(shorter[w][at]).tolist():  # the other text's bitmap is the shorter one
            apart[j] = int(np.bitwise_count(raw2[at[j]] ^ folded(raw[i], len(raw2[at[j]]))).sum())
        total = n2[at] + n[i]
        shared = (total - apart) // 2
        for j in at[100 * shared >= LIMIT * (total - shared)].tolist():
            both = np.intersect1d(groups[i], groups2[j], assume_unique=True)
            if both[0] == token:
                out["a"].append(int(min(ids[i], ids2[j])))
                out["b"].append(int(max(ids[i], ids2[j])))
                out["seen"].append(len(both))
    return out


def crossed(labelled: DataFrame, block: int = BLOCK) -> DataFrame:
    """The postings of large groups as blocks to compare: token, low, high, id, label, minor, outside.

    All pairs of different components have a text outside the group's greatest component (minor). Each such text goes to every block of
    all texts (outside), each text to every block of those: with few texts outside, rows grow with the group, not with its
    square. Postings have token, part, parts, size, id and label.
    """
    counts = labelled.groupBy("token", "parts", "label").agg(F.count(F.lit(1)).alias("c"))
    about = counts.groupBy("token", "parts").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.sum("c").alias("all"), F.max("c").alias("most"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / F.lit(block))).cast("int")
    about = about.select("token", "parts", "top", blocks(F.col("all")).alias("wide"), blocks(F.col("all") - F.col("most")).alias("narrow"))
    one = labelled.drop("parts").join(_by_part(about).drop("parts"), ["token", "part"]).withColumn("minor", F.col("label") != F.col("top"))
    every = one.withColumn("low", F.explode(F.sequence(F.lit(0), F.col("narrow") - 1))).withColumn("high", F.pmod(F.xxhash64("id"), F.col("wide")).cast("int")).withColumn("outside", F.lit(False))
    some = one.where("minor").withColumn("low", F.pmod(F.xxhash64("id", F.lit(1)), F.col("narrow")).cast("int")).withColumn("high", F.explode(F.sequence(F.lit(0), F.col("wide") - 1))).withColumn("outside", F.lit(True))
    names = ["token", "low", "high", "id", "label", "minor", "outside"]
    return every.select(*names).unionByName(some.select(*names))


def _passing(pairs: DataFrame, texts: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b) of pairs of different components that sizes, bitmaps and the number of shared prefix shingles (seen) do not rule out.

    All shingles that the prefix which ends first shares with the other text are in the other's prefix: the two share at
    most ``seen`` and what stands after that prefix.
    """
    side = lambda s: texts.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "matches", "last", "behind", "label")))
    maps = lambda s: whole.select(F.col("id").alias(s), F.col("bitmap").alias(f"map_{s}"))
    left = F.expr("CASE WHEN last_a < last_b THEN behind_a WHEN last_a > last_b THEN behind_b ELSE greatest(behind_a, behind_b) END")
    fits = (F.col("seen") >= F.least("matches_a", "matches_b")) & ((100 + LIMIT) * (F.col("seen") + left) >= LIMIT * (F.col("n_a") + F.col("n_b")))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(fits & (F.col("label_a") != F.col("label_b")) & (100 * F.least("n_a", "n_b") >= LIMIT * F.greatest("n_a", "n_b")))
    both = both.select("a", "b", "n_a", "n_b").join(maps("a"), "a").join(maps("b"), "b")

    def run(b):
        ok = pa.array(may_link_all(b.column("n_a").to_numpy(), b.column("map_a").to_pylist(), b.column("n_b").to_numpy(), b.column("map_b").to_pylist()))
        return {"a": b.column("a").filter(ok), "b": b.column("b").filter(ok)}

    return map_arrow(both.select("a", "b", "n_a", "n_b", "map_a", "map_b"), run, "a long, b long", by_text="map_a")


def verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, on the whole sets of their texts.

    Texts come from the documents: a bit filter over the ids of the wanted ones keeps most rows out, the rest are named
    again and joined by name.
    """
    wanted = keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(texts.select("id", "node", "rep"), "id"))
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (8 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64("rep"), F.lit(bits))
    marks = wanted.select((place / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(rep), {bits}), 64) as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    filled = np.zeros(bits // 64, dtype=np.int64)
    got = marks.toArrow()
    filled[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def named(b):
        flat, ends = shingle_sets(b.column("text"))
        full = np.flatnonzero(np.diff(ends))
        return {"node": [node_of(flat[ends[k] : ends[k + 1]]) for k in full], "text": b.column("text").take(pa.array(full))}

    def hit(b):
        at = b.column("place").to_numpy()
        return b.filter(pa.array(((shared.value[at // 64] >> (at % 64)) & 1).astype(bool)))

    there = docs.select("text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits)).alias("place"))
    found = map_arrow(there, named, "node binary, text string", by_text="text", first=hit)
    found = found.join(wanted.select("node", "id"), "node").groupBy("node", "id").agg(F.first("text").alias("text"))
    both = pairs.join(found.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(found.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def compare(b):
        (x, xe), (y, ye) = shingle_sets(b.column("ta")), shingle_sets(b.column("tb"))
        ok = []
        for k in range(b.num_rows):
            s, t = x[xe[k] : xe[k + 1]], y[ye[k] : ye[k + 1]]
            ok.append(linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)))
        ok = pa.array(ok, pa.bool_())
        return {"a": b.column("a").filter(ok), "b": b.column("b").filter(ok)}

    return map_arrow(both.select("a", "b", "ta", "tb"), compare, "a long, b long", by_text="ta")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles (set size) and component_id (least doc_id reachable by links, itself included), row by row.

    Whole texts count, as sets of 64-bit hashes. A null, empty or blank text has no shingles and links with nothing: its
    component is its own id. Texts with equal sets are one; null ids belong to their text's component and are never its
    name unless it has no other. Repeated rows repeat; other columns are ignored; an empty table gives an empty result.
    """
    rows, named = _components(docs)
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    of_node = named.join(least, "label").select("node", "component")
    return rows.select("doc_id", "node", "n").join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def one_each(docs: DataFrame) -> DataFrame:
    """One row of each component: of its least id (rows without an id come last), then of the least hash of the text.

    Of rows with one id and one text, one stays. Texts without words link with nothing: one row for each id and text. Rows
    are named by id and a 64-bit hash of the text; copies of a chosen row are put down to one by a minimum of its columns.
    """
    rows, named = _components(docs)
    copies = rows.groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias("copies"), F.max(F.col("node").isNull()).alias("blank"))
    best = named.groupBy("label").agg(F.min("best").alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.print").alias("hash"))
    chosen = best.join(copies, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("print"))).select("id", "hash", "copies")
    chosen = keep(chosen.unionByName(copies.where("blank").select(F.col("doc_id").alias("id"), F.col("print").alias("hash"), "copies")))
    there = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"))
    of = lambda c: there.join(c.select("id", "hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("print") == F.col("hash")), "left_semi")
    single = of(chosen.where("copies = 1")).select("row.*")
    repeated = of(chosen.where("copies > 1")).groupBy("doc_id", "print").agg(F.min("row").alias("row")).select("row.*")
    return single.unionByName(repeated)


def _relabelled(texts: DataFrame, links: DataFrame) -> DataFrame:
    """The texts with the labels that new links (a, b) give their components."""
    of = lambda s: texts.select(F.col("id").alias(s), F.col("label").alias(f"l{s}"))
    joined = links.join(of("a"), "a").join(of("b"), "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    over = components(joined).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return texts.join(over, "label", "left").withColumn("label", F.coalesce("top", "label")).drop("top")


def _mixed(large: DataFrame, texts: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Labelled postings of the large groups, and those groups that hold several components, with a member drawn by hash."""
    labelled = large.join(texts.select("id", "label"), "id")
    draw = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "label")).alias("k")
    groups = labelled.groupBy("token", "parts").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), draw).where("lo <> hi")
    return labelled, groups.select("token", "parts", F.col("k.id").alias("pivot"), F.col("k.label").alias("of"))


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The described rows, and for every set (node) its least id (rep), best row and the label of its component."""
    rows = keep(described(docs))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("best")
    whole = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), best, *(F.first(c).alias(c) for c in ("n", "matches", "last", "bitmap", "tokens", "split_tokens", "parts")))
    whole = keep(whole.withColumn("id", F.monotonically_increasing_id()))  # written at once: the number stays
    posts = shared_postings(whole)
    behind = (F.col("n") - F.size("tokens") - F.size("split_tokens")).alias("behind")
    texts = whole.select("id", "node", "rep", "n", "matches", "last", behind, F.col("id").alias("label"))
    large = keep(posts.where(F.col("size") > LARGE))

    # linking rounds: in each large group of several components, all are tried against a drawn member
    turn = 0
    while True:
        labelled, groups = _mixed(large, texts, turn)
        tried = labelled.join(_by_part(groups).drop("parts"), ["token", "part"]).where("label <> of")
        stars = keep(tried.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"), F.lit(UNCOUNTED).alias("seen")).distinct())
        links = keep(verified(keep(_passing(stars, texts, whole)), texts, docs))
        texts = keep(_relabelled(texts, links))
        if links.count() * WORTH_A_ROUND < max(1, stars.count()):
            break
        turn += 1

    # exact round: all pairs of different components, from small and from large groups
    alike = posts.where(F.col("size") <= LARGE).select("token", "id").repartition("token").sortWithinPartitions("token", "id")
    small = alike.mapInArrow(_small_pairs, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("seen"))
    labelled, groups = _mixed(large, texts, turn)
    labelled = keep(labelled.join(_by_part(groups).select("token", "part"), ["token", "part"], "left_semi"))
    lists = labelled.groupBy("id").agg(F.array_sort(F.collect_set("token")).alias("groups"))  # at most a prefix
    wide = crossed(labelled).join(whole.select("id", "n", "bitmap").join(lists, "id"), "id")
    broad = _blocks(wide, ["token", "low", "high"])
    counted = small.unionByName(broad).groupBy("a", "b").agg(F.sum("seen").alias("seen"))
    second = keep(verified(keep(_passing(counted, texts, whole)), texts, docs))
    return rows, whole.select("id", "node", "rep", "best").join(_relabelled(texts.select("id", "label"), second), "id")
