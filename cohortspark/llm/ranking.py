"""Ranked lexical search of many items at once, with common subexpressions of their scores.

An item's score of a document is a sum over the item's terms. Items share terms, so sums of term sets that several
items have in common are mined first: the terms of each item stand in one order (most shared first), and pairs of neighbours that two items
or more have become a node of their own, again and again, until no pair is left. The nodes form a graph whose leaves are
terms and whose roots are items. For a block of documents every node's partial sums are made once and serve all nodes
and items above it; nodes without a term in the block are passed over.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from cohortspark.llm._arrow import map_arrow
from cohortspark.llm._tokens import Words, kinds
from cohortspark.llm._words import slices

#: Everything in ASCII but digits and letters stands between terms.
_KIND = kinds(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Documents of an item.
TOP = 10
#: Items and characters of items that are searched in one scan, so that what is broadcast stays bounded (some 4 KB an item).
SHARD_ITEMS, SHARD_CHARS = 10_000, 32_000_000
#: Shares in which the best documents of an item are ranked before the last step.
SHARES = 64


class Graph(NamedTuple):
    """Sums of terms that items share. Node k is leaf k (a term and how often it counts) or the sum of two earlier nodes."""

    leaves: list[tuple[int, int]]
    nodes: list[tuple[int, int]]
    #: The nodes whose sum is an item's score.
    roots: list[list[int]]


def shared_sums(items: list[Counter]) -> Graph:
    """The graph of items given as term: count. A node stands for terms that two items or more have in common."""
    use = Counter(leaf for item in items for leaf in item.items())
    leaves = sorted(use, key=lambda x: (-use[x], x))
    number = {leaf: k for k, leaf in enumerate(leaves)}
    rows = [sorted(number[leaf] for leaf in item.items()) for item in items]
    nodes: list[tuple[int, int]] = []
    while True:
        count = Counter(p for row in rows for p in set(pairwise(row)))
        good = {p: n for p, n in count.items() if n > 1}
        if not good:
            return Graph(leaves, nodes, rows)
        made: dict[tuple[int, int], int] = {}
        merged = []
        for row in rows:
            out, k = [], 0
            while k < len(row):
                pair = tuple(row[k : k + 2])
                after = good.get(tuple(row[k + 1 : k + 3]), 0)
                if good.get(pair, 0) > 0 and good[pair] >= after:
                    if pair not in made:
                        made[pair] = len(leaves) + len(nodes)
                        nodes.append(pair)
                    out.append(made[pair])
                    k += 2
                else:
                    out.append(row[k])
                    k += 1
            merged.append(out)
        rows = merged


def evaluate(graph: Graph, of_term: dict[int, np.ndarray]) -> Iterator[np.ndarray | None]:
    """The score of each item for the documents of a block; None: none has a term of the item. of_term: gains by term."""
    sums: list[np.ndarray | None] = []
    for term, times in graph.leaves:
        gain = of_term.get(term)
        sums.append(gain if gain is None or times == 1 else gain * times)
    for a, b in graph.nodes:
        x, y = sums[a], sums[b]
        sums.append(y if x is None else x if y is None else x + y)
    for row in graph.roots:
        parts = [sums[k] for k in row if sums[k] is not None]
        yield sum(parts[1:], parts[0]) if parts else None


def terms_of(text: str | None) -> list[str]:
    words = Words(pa.array([text or ""]), _KIND).array()
    return words.cast(pa.large_string()).to_pylist()


class Found(NamedTuple):
    """Searched terms in a batch of documents: terms of each document, and (document, term, occurrences) of the searched ones."""

    n: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def find(texts: pa.Array, vocabulary: pa.Array) -> Found:
    words = Words(texts, _KIND)
    at = pc.index_in(words.array(), value_set=vocabulary)
    hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
    key = words.text[hit] * len(vocabulary) + at.drop_null().to_numpy().astype(np.int64)
    key, tf = np.unique(key, return_counts=True)
    return Found(np.diff(words.bounds), key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), tf)


def statistics(docs: DataFrame, vocabulary: pa.Array) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each term of the vocabulary; of the whole table."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(part: pa.RecordBatch) -> dict:
        got = find(part.column("text"), shared.value)
        term, df = np.unique(got.term, return_counts=True)
        return {"term": pa.array(np.concatenate([term, [-1, -2]])), "n": pa.array(np.concatenate([df, [np.count_nonzero(got.n), got.n.sum()]]))}

    rows = map_arrow(docs, work, "term long, n long", "text").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = dict(zip(rows.column("term").to_pylist(), rows.column("n").to_pylist(), strict=True))
    return n.get(-1, 0), n.get(-2, 0), np.array([n.get(k, 0) for k in range(len(vocabulary))], dtype=np.int64)


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for k in df.tolist()], dtype=np.int64)


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 75 + (75 * n * docs) div total, exact beyond 64 bits too."""
    if 75 * int(n.max(initial=0)) * docs < 1 << 63:
        return 25 + (75 * docs * n) // max(1, total)
    return np.array([25 + 75 * int(k) * docs // total for k in n], dtype=np.int64)


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, dtype=np.int64)
        self.rows: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64),) * 2 for _ in range(items)]

    def add(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        near = np.flatnonzero(score >= self.least[item])
        if len(near):
            s, d = (np.concatenate(x) for x in zip(self.rows[item], (score[near], ids[near]), strict=True))
            order = np.lexsort((d, -s))[: self.top]
            self.rows[item] = s[order], d[order]
            if len(order) == self.top:
                self.least[item] = s[order[-1]]


def _shard(docs: DataFrame, items: list[tuple[int | None, str]], top: int) -> DataFrame:
    """The best documents of each item within each task."""
    counts = [Counter(terms_of(text)) for _, text in items]
    names = sorted({t for c in counts for t in c})
    number = {t: k for k, t in enumerate(names)}
    vocabulary = pa.array([t.encode() for t in names], type=pa.large_binary())
    n_docs, total, df = statistics(docs, vocabulary)
    graph = shared_sums([Counter({number[t]: n for t, n in c.items()}) for c in counts])
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights(n_docs, df), graph, [i for i, _ in items]))
    kind = _parse_datatype_string("item int, item_id long, doc_id long, score long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight, graph, names = shared.value
        best = Best(len(names), top)
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
            for part in slices(batch.column("text")):
                piece = batch.slice(part.start, part.stop - part.start)
                got, ids = find(piece.column("text"), vocabulary), piece.column("doc_id").to_numpy()
                gain = weight[got.term] * ((1_000_000_000 * got.tf) // (1000 * got.tf + 8 * lengths(got.n, n_docs, total)[got.doc]))
                order = np.argsort(got.term, kind="stable")
                term, first = np.unique(got.term[order], return_index=True)
                of_term = {}
                for t, rows in zip(term.tolist(), np.split(order, first[1:]) if len(term) else [], strict=True):
                    column = np.zeros(len(ids), dtype=np.int64)
                    column[got.doc[rows]] = gain[rows]
                    of_term[t] = column
                for item, score in enumerate(evaluate(graph, of_term)):
                    if score is not None:
                        best.add(item, score, ids)
        for item, (score, ids) in enumerate(best.rows):
            if len(ids):
                columns = [pa.array(np.full(len(ids), item, dtype=np.int32)), pa.array([names[item]] * len(ids), type=pa.int64()), pa.array(ids), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(kind))

    return docs.mapInArrow(run, kind)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank (from 1), doc_id, score (above 0; equal ones by ascending doc_id).

    Scores are whole numbers: a term's weight floor(1000 * ln((2N + 2) / (2 df + 1))) times 10^9 tf div (1000 tf + 8 m), m the
    document's length against the mean, over the item's terms with repeats; N, df and lengths are counted over all rows. Null
    texts have no terms. Equal rows of items are one item, other rows of an item id are ranked apart; rows of documents
    count and are listed as often as they stand; those without an id count, but are not listed. Empty tables give no
    rows, other columns are not read. A task keeps its best documents of each item, shares of tasks are ranked first, then all.
    Each SHARD_ITEMS items take two scans of the documents.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    asked = items.where("text IS NOT NULL").select("item_id", "text").distinct()
    size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(1, -(-size[0] // SHARD_ITEMS), -(-size[1] // SHARD_CHARS))
    out = None
    for k in range(shards):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).collect()
        part = _shard(docs, sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])), top)
        part = part.withColumn("shard", F.lit(k))
        out = part if out is None else out.unionByName(part)
    order = [F.desc("score"), F.asc("doc_id")]
    first = Window.partitionBy("shard", "item", "share").orderBy(*order)
    last = Window.partitionBy("shard", "item").orderBy(*order)
    some = out.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
