"""Benchmark decontamination: passages of every document against a BM25 index of the test items.

The items (in units of at most UNIT words) form an inverted index of impacts, each divided by the unit's score for its
own text, so a passage that holds a unit scores 1 and one threshold fits all. Posting lists are in unit order, in blocks
with their greatest impact. Every passage is a query: the cursors of its terms stand in unit order, greatest impacts of
whole lists name the pivot, the greatest impacts of the blocks there decide whether it is scored or skipped together with
all that follows up to the end of a block. Units are sorted so that alike ones are neighbours, and a first table of
greatest impacts by (term, one of at most RANGES ranges of units) leaves for each passage the ranges to walk; its sums are
taken for all passages of a slice at once, a range at a time. What reaches the threshold is verified: shared five-word
sequences of the question (or shared pairs of neighbours, where words were changed or lost) and shared words of the answer, of
the whole item and around the passage, as far as the item reaches. An item of fewer than GRAM words names no passage: it is found where it is all of a document.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._arrow import map_batches
from cohortspark.llm._graph import keep
from cohortspark.llm._words import slices

#: Words of an index unit, of a passage and between passages: each unit lies whole in some passage.
UNIT, PASSAGE, STEP = 64, 128, 64
THRESHOLD = 0.6
QUESTION_SHARE, ANSWER_SHARE = 0.6, 0.6
#: Share of the question's neighbouring words that does as well: a changed word breaks five sequences, but two pairs.
PAIR_SHARE = 0.7
#: Postings in a block, and words of a sequence.
BLOCK, GRAM = 8, 5
K1, B = 1.2, 0.75
#: Ranges of units in the first table.
RANGES = 64
#: Items in an index (some 4 KB each), so what is broadcast stays bounded; a larger benchmark takes a scan for each.
SHARD_ITEMS = 10_000
#: Words that are searched at once: bounds the memory of a task, besides a single text.
SLICE_WORDS = 500_000
#: Allowance for sums in another order.
_EPS = 1e-9
_WORD = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    return _WORD(text.lower()) if text else []


def grams(words: list[str], n: int = GRAM) -> set[tuple[str, ...]]:
    """Sequences of n words."""
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def question_answer(words_by_sentence: list[list[str]]) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; of one sentence, its last quarter."""
    whole = [w for s in words_by_sentence for w in s]
    n = len(words_by_sentence[-1]) if len(words_by_sentence) > 1 else max(1, len(whole) // 4)
    return whole[:-n] or whole, whole[-n:]


def sentences_of(text: str | None) -> list[list[str]]:
    """Words of every sentence that has any."""
    return [s for s in map(words_of, re.split(r"(?<=[.!?])\s+|\n", text or "")) if s]


def unit_starts(n: int) -> list[int]:
    """First words of the units of an item of n words: all are of UNIT words, the last one overlaps; a shorter item is one."""
    starts = list(range(0, max(1, n - UNIT + 1), UNIT))
    return starts if starts[-1] + UNIT >= n else [*starts, n - UNIT]


class Stats(NamedTuple):
    """Of the units of a whole benchmark: their number, mean length, and the number of units with each word (of a shard's)."""

    n: int
    mean: float
    df: Mapping[str, int]


def stats_of(units: Iterable[list[str]]) -> Stats:
    n = total = 0
    df: dict[str, int] = {}
    for words in units:
        n, total = n + 1, total + len(words)
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    return Stats(n, total / n if n else 1, df)


class Unit(NamedTuple):
    item: int
    words: list[str]
    #: Words of the item before and after the unit.
    before: int
    after: int
    #: Of the whole item.
    #: Sequences of the question, and their length: a short question is one sequence.
    question: set
    gram: int
    pairs: set
    answer: set


class Index:
    """Posting lists in unit order with block maxima, for one shard of items."""

    def __init__(self, items: list[tuple[int, str]], stats: Stats | None = None):
        units: list[Unit] = []
        #: Words of an item that is too short for a passage -> items.
        self.short: dict[tuple[str, ...], set[int]] = {}
        for item, text in items:
            sentences = sentences_of(text)
            if not sentences:
                continue
            whole = [w for s in sentences for w in s]
            if len(whole) < GRAM:
                self.short.setdefault(tuple(whole), set()).add(item)
                continue
            q, a = question_answer(sentences)
            gram = min(GRAM, len(q))
            question, pairs, answer = grams(q, gram), grams(q, 2), set(a)
            for start in unit_starts(len(whole)):
                words = whole[start : start + UNIT]
                units.append(Unit(item, words, start, len(whole) - start - len(words), question, gram, pairs, answer))
        n, mean, df = stats or stats_of(u.words for u in units)
        units.sort(key=lambda u: (sorted(set(u.words), key=lambda w: (-df[w], w))[:3], u.item))
        self.units = units
        self.vocab = {w: i for i, w in enumerate(sorted({w for u in units for w in u.words}))}
        self.per_range = max(1, -(-len(units) // RANGES))
        lists: list[list[tuple[int, float]]] = [[] for _ in self.vocab]
        for k, u in enumerate(units):
            count: dict[str, int] = {}
            for w in u.words:
                count[w] = count.get(w, 0) + 1
            impact = {w: float(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(u.words) / mean))) for w, c in count.items()}
            own = sum(impact.values())
            for w, x in impact.items():
                lists[self.vocab[w]].append((k, x / own))
        #: Of each term: its postings, its blocks (last unit and greatest impact), and its greatest impact.
        self.first, self.block_first = array("q", [0]), array("q", [0])
        self.unit, self.impact = array("i"), array("d")
        self.block_last, self.block_max = array("i"), array("d")
        self.most = array("d")
        ranges = -(-len(units) // self.per_range)
        self.bound = np.zeros((len(self.vocab) + 1, ranges))
        for t, posts in enumerate(lists):
            for k, x in posts:
                self.unit.append(k)
                self.impact.append(x)
                self.bound[t, k // self.per_range] = max(self.bound[t, k // self.per_range], x)
            for at in range(0, len(posts), BLOCK):
                part = posts[at : at + BLOCK]
                self.block_last.append(part[-1][0])
                self.block_max.append(max(x for _, x in part))
            self.first.append(len(self.unit))
            self.block_first.append(len(self.block_last))
            self.most.append(max(x for _, x in posts))

    def ids(self, words: list[str]) -> np.ndarray:
        """Term numbers; words outside the index get the last one, whose bounds are 0."""
        get, none = self.vocab.get, len(self.vocab)
        return np.fromiter((get(w, none) for w in words), dtype=np.int64, count=len(words))

    def live(self, texts: list[np.ndarray], threshold: float) -> dict[tuple[int, int], list[int]]:
        """(text, first word) of the passages that may reach the threshold -> ranges of units where they may.

        Distinct terms of a passage count once. One range is summed at a time, so memory follows the words alone.
        """
        none = len(self.vocab)
        lengths = np.array([len(t) for t in texts])
        # texts stand apart by more than a passage, at multiples of the step
        room = (-(-(lengths + PASSAGE) // STEP)) * STEP
        start = np.concatenate([[0], np.cumsum(room)[:-1]]).astype(np.int64)
        total = int(room.sum()) // STEP
        term = np.concatenate(texts)
        place = np.repeat(start, lengths) + np.arange(len(term)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        used = term != none
        term, place = term[used], place[used]
        order = np.argsort(term, kind="stable")
        before = np.full(len(term), -(10**9))
        same = term[order][1:] == term[order][:-1]
        before[order[1:][same]] = place[order[:-1][same]]
        # passages k with k*STEP <= place < k*STEP + PASSAGE that the same term has not entered before
        low = np.maximum(before // STEP + 1, -((PASSAGE - 1 - place) // STEP))
        low, high = np.maximum(low, 0), place // STEP
        ok = low <= high
        term, low, high = term[ok], low[ok], high[ok]
        own = np.repeat(np.arange(len(texts)), room // STEP)
        first = np.arange(total) * STEP - start[own]
        real = first < lengths[own]
        out: dict[tuple[int, int], list[int]] = {}
        for r in range(self.bound.shape[1]):
            w = self.bound[term, r]
            sums = (np.bincount(low, weights=w, minlength=total + 1) - np.bincount(high + 1, weights=w, minlength=total + 1)[: total + 1]).cumsum()[:-1]
            for k in np.flatnonzero((sums >= threshold - 1e-6) & real).tolist():
                out.setdefault((int(own[k]), int(first[k])), []).append(r)
        return out

    def retrieve(self, terms: list[int], low: int, high: int, threshold: float) -> list[tuple[int, float]]:
        """(unit, score) of the units from low to below high that reach the threshold, by block-max WAND."""
        unit, first, most = self.unit, self.first, self.most
        cursors = []  # [unit, place in the postings, term], of lists that have not ended
        for t in terms:
            at = bisect_left(unit, low, first[t], first[t + 1])
            if at < first[t + 1] and unit[at] < high:
                cursors.append([unit[at], at, t])
        found = []

        def forward(moved, target):
            for c in moved:
                if c[0] < target:
                    end = first[c[2] + 1]
                    c[1] = bisect_left(unit, target, c[1], end)
                    c[0] = unit[c[1]] if c[1] < end else high

        while cursors:
            cursors.sort()
            while cursors and cursors[-1][0] >= high:
                cursors.pop()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += most[c[2]]
                if total >= threshold - _EPS:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            bound, edge = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else high
            for c in cursors[: pivot + 1]:
                end = self.block_first[c[2] + 1]
                k = bisect_left(self.block_last, at, self.block_first[c[2]], end)
                if k < end:
                    bound += self.block_max[k]
                    edge = min(edge, self.block_last[k] + 1)
            if bound < threshold - _EPS:
                forward(cursors[: pivot + 1], max(edge, at + 1))
            elif cursors[0][0] < at:
                forward(cursors[: pivot + 1], at)
            else:
                score = sum(self.impact[k] for _, k in sorted((c[2], c[1]) for c in cursors[: pivot + 1]))
                if score >= threshold - _EPS:
                    found.append((at, score))
                forward(cursors[: pivot + 1], at + 1)
        return found

    def search(self, texts: list[list[str]], threshold: float) -> list[dict[int, tuple[float, float, float]]]:
        """For each text: item -> best (score, question share, answer share) of its verified passages."""
        found: list[dict] = [{i: (1.0, 1.0, 1.0) for i in self.short.get(tuple(t), ())} if len(t) < GRAM else {} for t in texts]
        if not self.units:
            return found
        start = 0
        while start < len(texts):
            stop, words = start + 1, len(texts[start])
            while stop < len(texts) and words + len(texts[stop]) <= SLICE_WORDS:
                words += len(texts[stop])
                stop += 1
            for (k, a), ranges in self.live([self.ids(t) for t in texts[start:stop]], threshold).items():
                for item, hit in self._verified(texts[start + k], a, ranges, threshold):
                    found[start + k][item] = max(found[start + k].get(item, (0.0, 0.0, 0.0)), hit)
            start = stop
        return found

    def _verified(self, text: list[str], a: int, ranges: list[int], threshold: float):
        words = text[a : a + PASSAGE]
        terms = sorted(self.vocab[w] for w in set(words) if w in self.vocab)
        near: dict[tuple[int, int, int], tuple[set, set, set]] = {}
        for r in ranges:
            for k, score in self.retrieve(terms, r * self.per_range, min((r + 1) * self.per_range, len(self.units)), threshold):
                u = self.units[k]
                around = u.gram, u.before, u.after
                if around not in near:
                    reach = text[max(0, a - u.before) : a + PASSAGE + u.after]
                    near[around] = grams(reach, u.gram), grams(reach, 2), set(reach)
                sequences, pairs, there = near[around]
                q, w = len(u.question & sequences) / len(u.question), len(u.answer & there) / len(u.answer)
                same = q >= QUESTION_SHARE or (u.pairs and len(u.pairs & pairs) / len(u.pairs) >= PAIR_SHARE)
                if same and w >= ANSWER_SHARE:
                    yield u.item, (min(score, 1.0), q, w)


def indexes(benchmark: DataFrame, shard_items: int = SHARD_ITEMS):
    """An index for each shard of items with an id and text; of repeated ids every text counts.

    Words are weighed over all units of the benchmark and all texts of an id share a shard, so results do not depend on
    the number of shards.
    """
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    shards = max(1, -(-items.count() // shard_items))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    if shards > 1:
        items = keep(items)
        units = keep(map_batches(items, _unit_words, "shard long, words array<string>, length long"))
        total = units.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
        used = units.select("shard", F.explode("words").alias("word"))
        df = keep(used.groupBy("word").agg(F.count(F.lit(1)).alias("units")))
    for k in range(shards):
        part = items.where(F.col("shard") == k)
        rows = [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]
        stats = None
        if shards > 1:
            own = df.join(used.where(F.col("shard") == k), "word", "left_semi")
            stats = Stats(total["n"], total["mean"] or 1, {r["word"]: r["units"] for r in own.collect()})
        index = Index(rows, stats)
        if index.units or index.short:
            yield index


def _unit_words():
    def work(cols):
        out = {"shard": [], "words": [], "length": []}
        for shard, text in zip(cols["shard"], cols["text"], strict=True):
            whole = [w for s in sentences_of(text) for w in s]
            for start in unit_starts(len(whole)) if len(whole) >= GRAM else ():
                words = whole[start : start + UNIT]
                out["shard"].append(shard)
                out["words"].append(sorted(set(words)))
                out["length"].append(len(words))
        return out

    return work


def _matcher(spark, index: Index, threshold: float):
    shared = spark.sparkContext.broadcast(index)
    return lambda texts: shared.value.search([words_of(t) for t in texts], threshold)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row and leaked item: doc_id, item_id, score, question_share, answer_share.

    Clean documents have no row. Whole texts are searched; null and empty texts have no passage, an empty benchmark no
    item. Repeated rows repeat, null ids stay, other columns are ignored. Row-local, no shuffle.
    """
    schema = "doc_id long, item_id long, score double, question_share double, answer_share double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark):
        match = _matcher(docs.sparkSession, index, threshold)

        def make(match=match):
            def work(cols):
                rows = [(i, item, *x) for i, hit in zip(cols["doc_id"], match(cols["text"]), strict=True) for item, x in sorted(hit.items())]
                return {n: [r[k] for r in rows] for k, n in enumerate(("doc_id", "item_id", "score", "question_share", "answer_share"))}

            return work

        out = out.unionByName(map_batches(docs.select("doc_id", "text"), make, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no test item; same columns, whatever their names and types, rows in place."""
    for index in indexes(benchmark):
        match = _matcher(docs.sparkSession, index, threshold)

        def run(batches, match=match):
            for b in batches:
                for part in slices(b.column("text")):
                    piece = b.slice(part.start, part.stop - part.start)
                    clean = pa.array([not hit for hit in match(piece.column("text").to_pylist())], pa.bool_())
                    yield piece.filter(clean)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
