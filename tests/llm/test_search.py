"""Personal data, ranked search and collocations against brute force and SQL, and their behaviour on odd rows."""

import itertools
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import personal, phrases, q12_ranking, q13_phrases, ranking

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score double, rank string, w string"
ODD = [(1, None, "en", 0.5, "x", "y"), (2, "", "en", None, None, None), (2, "", "en", None, None, None), (None, "plain words a@b.co", None, 1.0, "y", "z"), (3, "long " * 40_000, "en", 0.0, "z", None), (4, "one\ttwo  three.", None, 0.0, "z", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def weight():
    return personal.train(None)


def plain_spans(text):
    """The fixed patterns as they are written."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and personal.luhn(re.sub("[^0-9]", "", m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_fixed_patterns_equal_the_plain_ones(docs):
    g = random.Random(3)
    texts = [r.text or "" for r in docs.collect()]
    texts += ["".join(g.choice(["1", "23", "255", "256", "0", ".", ".", " ", "-", "+", "(", ")", "a", "@", "b-c", "_", "%", "é", "4111 1111 1111 1111", "\n"]) for _ in range(g.randint(0, 40))) for _ in range(4000)]
    assert all(sorted(personal.base_spans(t)) == sorted(plain_spans(t)) for t in texts)


def segmentations(n, segments):
    """All ways to cover n tokens by single tokens and segments: lists of segments."""
    if n == 0:
        yield []
        return
    yield from segmentations(n - 1, segments)
    for e, (i, k, _) in enumerate(segments):
        if k == n:
            for rest in segmentations(i, segments):
                yield [*rest, e]


def total(way, segments, own, touch):
    return sum(own[e] for e in way) + sum(touch for a, b in itertools.pairwise(way) if segments[a][1] == segments[b][0])


def test_sums_and_best_segmentation_equal_enumeration(weight):
    g = random.Random(4)
    for text in ["12 345 67-89", "(743) 555-3824", "1.2.3.4 5678", "a@b.c", "4111 1111 1111 1111"]:
        for s in personal.stretches(text):
            segments = [(i, k, names, kind) for k in range(1, len(s.tokens) + 1) for i, kind, names in personal._candidates(s, k)]
            names = sorted({n for x in segments for n in x[2]})
            w = {n: g.uniform(-1, 1) for n in names} | {"touch": 0.7}
            own = [sum(w[n] for n in x[2]) for x in segments]
            ways = list(segmentations(len(s.tokens), [x[:3] for x in segments]))
            scores = [total(x, segments, own, 0.7) for x in ways]
            best = ways[int(np.argmax(scores))]
            assert personal.decode(s, w) == [(segments[e][3], s.tokens[segments[e][0]][0], s.tokens[segments[e][1] - 1][1]) for e in best]
            number = {n: k for k, n in enumerate(names)}
            right = ways[len(ways) // 2]
            case = personal.Known(len(s.tokens), [(i, k, [number[n] for n in f]) for i, k, f, _ in segments], frozenset(right))
            flat = [w[n] for n in names] + [0.7]
            value, grad = personal.step(case, flat, len(names))
            z = math.log(sum(map(math.exp, scores)))
            assert value == pytest.approx(total(right, segments, own, 0.7) - z)
            for f in random.Random(1).sample(range(len(flat)), min(8, len(flat))):
                up = [x + 1e-6 * (k == f) for k, x in enumerate(flat)]
                assert grad.get(f, 0.0) == pytest.approx((personal.step(case, up, len(names))[0] - value) / 1e-6, abs=1e-4)


def test_held_out_notations_are_found(weight):
    right = wrong = missed = 0
    for text, spans in personal._examples(99, 600):
        base, added = personal.found_spans(text, weight)
        got = set(base) | set(added)
        right, missed, wrong = right + len(got & set(spans)), missed + len(set(spans) - got), wrong + len(set(added) - set(spans))
    assert right / (right + missed) > 0.93 and wrong / right < 0.03
    for plain in ("met on 2021-03-04 at 12.30", "version 1.20.3 of 1990-1995", "about 1234567 people", "see (at) page [2] of 300"):
        assert personal.found_spans(plain, weight) == ([], [])


def test_personal_data_on_odd_rows(spark, docs, odd, weight):
    rows = personal.scan(odd, weight).collect()
    assert len(rows) == len(ODD) and [r.spans for r in rows if r.doc_id is None] == ["email:12:18"] and sum(r.n_email for r in rows) == 1
    assert personal.scan(odd.limit(0), weight).count() == 0 and personal.train(odd.limit(0)) == weight
    own = personal.train(docs)
    got = {r.doc_id: r for r in personal.scan(docs, own).collect()}
    for r in docs.collect():
        base = plain_spans(r.text or "")
        assert got[r.doc_id].base_spans == personal.spelled(base) and set(got[r.doc_id].spans.split(",")) >= set(got[r.doc_id].base_spans.split(","))
    clean = [r for r in docs.collect() if not re.search("[0-9@]", r.text or "")]
    assert clean and all(got[r.doc_id].spans == "" for r in clean)


@pytest.mark.parametrize("part", ["a", "1", "1.", "(", "+1 ", "a@", "12 ", "@", "4111 1111 1111 1111 ", "x (at) "])
def test_personal_data_in_linear_time(weight, part):
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        personal.found_spans(part * (n // len(part)), weight)
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * max(took[0], 0.02)


def agree(got, sql, tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    rows = con.execute(sql)
    names = [x[0] for x in rows.description]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=key) == sorted(rows.fetchall(), key=key)


def test_shared_sums_equal_plain_sums():
    g = random.Random(6)
    items = [Counter(min(int(g.expovariate(0.2)), 40) for _ in range(g.randint(0, 30))) for _ in range(60)]
    items += items[:5]
    graph = ranking.shared_sums(items)
    gain = {t: np.array([g.randrange(1000) for _ in range(7)]) for t in range(30)}
    for item, got in zip(items, ranking.evaluate(graph, gain), strict=True):
        want = [n * gain[t] for t, n in item.items() if t in gain]
        assert (got is None and not want) or (got == sum(want)).all()
    adds = len(graph.nodes) + sum(max(0, len(r) - 1) for r in graph.roots)
    assert graph.nodes and adds < 0.8 * sum(max(0, len(i) - 1) for i in items)
    assert graph.roots[:5] == graph.roots[-5:]
    assert ranking.shared_sums([]).roots == [] and ranking.shared_sums([Counter()]).roots == [[]]


@pytest.mark.parametrize("items", [3, 10_000])
def test_search_equals_sql(spark, docs, odd, monkeypatch, items):
    monkeypatch.setattr(ranking, "SHARD_ITEMS", items)
    few = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(7)
    few = few.unionByName(spark.createDataFrame([(900, "the the long"), (901, "long words"), (902, None), (903, ""), (904, "...")], few.schema))
    both = docs.select("doc_id", "text").unionByName(odd.where("doc_id IS NOT NULL").select("doc_id", "text"))
    agree(ranking.search(both, few), q12_ranking.SQL, {"documents": both, "benchmark": few})


def test_search_on_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "plain LONG", "q"), (1, "plain LONG", "r"), (None, "two", "s"), (2, "nowhere", "t")], "item_id long, text string, rank string")
    rows = sorted((str(r.item_id), r.rank, r.doc_id) for r in ranking.search(odd, items).collect())
    assert rows == [("1", 1, 3), ("None", 1, 4)]  # the row without an id is not listed
    ties = spark.createDataFrame([(k % 12, "same words here") for k in range(30)], "doc_id long, text string")
    got = ranking.search(ties, spark.createDataFrame([(1, "same")], "item_id long, text string")).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in got] == [(k + 1, d) for k, d in enumerate([0, 0, 0, 1, 1, 1, 2, 2, 2, 3])]
    assert ranking.search(odd.limit(0), items).count() == 0 and ranking.search(odd, items.limit(0)).count() == 0


def test_lengths_beyond_64_bits():
    n = np.array([3, 10**9])
    assert ranking.lengths(n, 10**11, 10**15).tolist() == [25 + 75 * int(k) * 10**11 // 10**15 for k in n]


def test_collocations_equal_sql(spark, docs, odd):
    g = random.Random(8)
    rows = [(k, " ".join(g.choice(["a", "b", "c", "Dé", "e.", "f,", "g\n", "h"]) for _ in range(g.choice([0, 3, 50, 2000]))), g.choice(["xx", "y", None])) for k in range(60)] + [(100, "a b c d " * 50, "xx"), (101, "a b c d " * 50, "xx")]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    both = docs.select("text", "lang").unionByName(odd.select("text", "lang")).unionByName(made.select("text", "lang"))
    got = phrases.collocations(both)
    assert got.count() > 100
    agree(got, q13_phrases.SQL, {"documents": both})
    assert phrases.collocations(odd.limit(0)).count() == 0


def test_chunks_do_not_begin_one_another_and_count_each_phrase_once(spark, docs):
    parsed = phrases.chunks(docs).collect()
    by_lang = {}
    for r in parsed:
        if not r.ends:
            by_lang.setdefault(r.lang, []).append(bytes(r.chunk).split())
    for chunks in by_lang.values():
        chunks = sorted(map(tuple, {tuple(c) for c in chunks}))
        assert all(b[: len(a)] != a for a, b in itertools.pairwise(chunks))
    assert max(r.n for r in parsed) > 1 and sum(len(bytes(r.chunk)) for r in parsed) < sum(len((r.text or "").encode()) for r in docs.collect()) * 1.1
    pairs = Counter()
    for r in docs.collect():
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            pairs.update((r.lang, " ".join(p)) for p in itertools.pairwise(words))
    everything = np.full(1 << (phrases.BITS - phrases.ROW), ~np.uint64(0), dtype=np.uint64)
    got = {(r.lang, r.phrase): r.f for r in phrases.counted(phrases.chunks(docs), 2, everything).collect()}
    assert got == pairs


def test_words_of_odd_arrays():
    words = phrases.Words(pa.array(["", "A b", None, "c.d", ""]), phrases._KIND)
    assert words.text.tolist() == [1, 1, 3, 3] and words.joined.tolist() == [True, False, False]
