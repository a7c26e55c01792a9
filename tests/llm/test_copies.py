"""Fingerprints, near-duplicates and the pipeline against brute force."""

import hashlib
import pathlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortspark.llm import _graph as graph
from cohortspark.llm import fingerprints as fp
from cohortspark.llm import neardups as nd
from cohortspark.llm._words import mix, shingle_sets, slices

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def exact_components(rows):
    """Component names by comparing all pairs on string shingles."""
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            name[find(i)] = min(name.get(find(i), d), d)
    return [(d, len(s), name.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def chains(n, seed):
    """Texts of one base with random edits: pairs around the limit, exact copies, a shared passage."""
    g = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(30)]
    out = []
    for k in range(n):
        w = list(base) if k % 3 else [f"x{g.randrange(10**6)}" for _ in range(60)] + passage
        for _ in range(g.randrange(6) if k % 3 else 0):
            w[g.randrange(len(w))] = f"e{g.randrange(10**6)}"
        out.append((k, " ".join(w)))
    return out + [(1000 + k, t) for k, t in out[:5]] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "A b"), (2004, "a B"), (None, "a b"), (None, "alone here"), (2003, "A b"), (2005, "w " * 20_000)]


def compare(spark, rows):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, node int")
    got = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in nd.near_duplicates(df).collect())))
    assert got == sorted(map(str, exact_components(rows)))


def test_components_on_edited_texts(spark):
    compare(spark, chains(60, 1))


def test_components_on_documents(spark):
    compare(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_components_of_a_large_group(spark, monkeypatch):
    """Near copies, most of which link with some others only, in groups of several blocks; frequent shingles are split."""
    monkeypatch.setattr(nd, "LARGE", 8)
    monkeypatch.setattr(nd, "BLOCK", 40)
    monkeypatch.setattr(nd, "SPLIT_LEVEL", 4)
    g = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(260):
        w = list(base)
        for _ in range(g.randrange(7)):
            w[g.randrange(len(w))] = f"e{g.randrange(10**6)}"
        rows.append((k, " ".join(w[g.randrange(12) :])))
    compare(spark, rows)


def test_kept_tables_have_few_files(spark, monkeypatch):
    """With hundreds of partitions that are not put together, the tables of a run have a file or two for each core, and the same rows."""
    found, real = [], graph.kept

    def counted(df):
        out = real(df)
        found.append(len(list(pathlib.Path(out.path.removeprefix("file:")).glob("part-*"))))
        return out

    monkeypatch.setattr(graph, "kept", counted)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in names]
    try:
        for k, v in zip(names, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        compare(spark, chains(40, 3))
        assert len(found) > 10 and max(found) <= 2 * spark.sparkContext.defaultParallelism
        spark.conf.set(names[0], "1600")
        assert graph.files(spark) == 100  # more partitions, more files
    finally:
        for k, v in zip(names, before, strict=True):
            spark.conf.set(k, v)


def test_no_documents(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bitmaps_and_prefixes_lose_no_link():
    g = np.random.default_rng(4)
    level = np.zeros(1 << nd.SKETCH_BITS, dtype=np.uint8)
    level[:: 3] = 5
    for _ in range(400):
        n = int(g.integers(5, 300))
        base = g.integers(0, 2**63, n + 40).astype(np.uint64)
        a, b = np.unique(base[:n]), np.unique(np.concatenate([base[int(g.integers(0, max(1, n // 6))) : n], base[n : n + int(g.integers(0, 20))]]))
        if nd.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            assert nd.may_link(len(a), nd.bitmap(a), len(b), nd.bitmap(b))
            p, q = nd.prefix_of(a, level), nd.prefix_of(b, level)
            seen = len(np.intersect1d(p.tokens, q.tokens))
            assert seen >= min(p.matches, q.matches)
            first, whole = (p, a) if p.last < q.last else (q, b)
            assert seen + len(whole) - len(first.tokens) >= len(np.intersect1d(a, b))


def test_block_pairs_leave_once(spark):
    g = np.random.default_rng(6)
    base = g.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 180 - int(g.integers(0, 30))], g.integers(0, 2**63, int(g.integers(0, 30))).astype(np.uint64)])) for _ in range(60)] + [base[:3], base[:4], base[:5]]
    count = len(sets)
    groups = [sorted(g.choice(9, int(g.integers(1, 6)), replace=False).tolist()) for _ in sets]
    label = [0 if i % 3 else i for i in range(count)]
    ok = lambda i, j: label[i] != label[j] and nd.may_link(len(sets[i]), nd.bitmap(sets[i]), len(sets[j]), nd.bitmap(sets[j]))
    want = {(j, i): len(set(groups[i]) & set(groups[j])) for i in range(count) for j in range(i) if ok(i, j) and set(groups[i]) & set(groups[j])}
    size = {t: sum(t in x for x in groups) for t in range(9)}
    posts = spark.createDataFrame([(t, i % (1 + t % 2), 1 + t % 2, size[t], i, label[i]) for i in range(count) for t in groups[i]], "token long, part int, parts int, size long, id long, label long")
    for block in (7, 1024):
        got: dict = {}
        blocks: dict = {}
        for r in nd.crossed(posts, block).collect():
            blocks.setdefault((r.token, r.low, r.high), []).append(r)
        for key, rows in blocks.items():
            table = pa.table({"n": [len(sets[r.id]) for r in rows], "id": [r.id for r in rows], "label": [r.label for r in rows], "minor": [r.minor for r in rows], "outside": [r.outside for r in rows], "bitmap": [nd.bitmap(sets[r.id]) for r in rows], "groups": [groups[r.id] for r in rows]})
            out = nd._block_pairs(key, table)
            for a, b, n in zip(out["a"], out["b"], out["seen"], strict=True):
                assert (a, b) not in got
                got[a, b] = n
        assert want and got == want


def test_rows_of_a_large_group_grow_with_it(spark):
    """A group of 20,000 texts, all but 50 in one component: blocks of rows, not of pairs."""
    for size in (5_000, 20_000):
        posts = spark.range(size).select(F.lit(1).cast("long").alias("token"), F.pmod("id", F.lit(4)).cast("int").alias("part"), F.lit(4).alias("parts"), F.lit(size).cast("long").alias("size"), "id", F.when(F.col("id") < 50, F.col("id")).otherwise(99).cast("long").alias("label"))
        rows = nd.crossed(posts)
        assert rows.count() == size + 50 * -(-size // nd.BLOCK)


@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_postings_in_pieces(piece):
    g = np.random.default_rng(8)
    token = np.sort(np.concatenate([np.repeat(7, 40), np.repeat(9, 5), np.repeat(12, 2), g.integers(100, 160, 50)])).astype(np.int64)
    ids = np.arange(len(token))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[a : a + piece]) for x in (token, ids)], ["token", "id"]) for a in range(0, len(token), piece)]
    got = {(r["token"], r["id"]): r["size"] for out in nd._shared_runs(iter(batches)) for r in out.to_pylist()}
    count = {t: int((token == t).sum()) for t in set(token.tolist())}
    assert got == {(t, k): count[t] for t, k in zip(token.tolist(), ids.tolist(), strict=True) if count[t] > 1}
    small = [(r["a"], r["b"]) for out in nd._small_pairs(pa.RecordBatch.from_arrays([pa.array(x[a : a + piece]) for x in (token[40:], ids[40:])], ["token", "id"]) for a in range(0, len(token) - 40, piece)) for r in out.to_pylist()]
    assert sorted(small) == [(i, j) for i in range(40, len(token)) for j in range(i + 1, len(token)) if token[i] == token[j]]


def test_fingerprint_estimates():
    g = np.random.default_rng(3)
    err = []
    for _ in range(150):
        n, k = int(g.integers(20, 600)), float(g.random())
        a = np.unique(g.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(n * k)], g.integers(0, 2**63, n - int(n * k)).astype(np.uint64)]))
        err.append(fp.likeness(fp.sketch(a), fp.sketch(b)) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.06
    assert fp.likeness_of(fp.packed(fp.sketch(a)), fp.packed(fp.sketch(a))) == 1 and fp.likeness(None, None) == 1 and fp.likeness(None, fp.sketch(a)) == 0


def slow_sketch(text):
    """Bins and densification one by one, over the shingle hashes of the text."""
    flat, _ = shingle_sets(pa.array([text]))
    if not len(flat):
        return None
    number = lambda x: int(mix(np.array([x % 2**64], dtype=np.uint64))[0])
    least = {}
    for h in map(number, flat.tolist()):
        least[h >> 57] = min(h, least.get(h >> 57, h))
    out = []
    for b in range(128):
        source, attempt = b, 0
        while source not in least:
            source = number(b * 0x9E3779B97F4A7C15 + attempt * 7919 + 1) % 128 if attempt < 64 else number(b + (attempt << 20)) % 128
            attempt += 1
        out.append(number(least[source]) & 255)
    return np.array(out, dtype=np.uint8)


def test_shingles_are_those_of_the_words():
    texts = [None, "", " \n", "a", "A  b", "a b c d", "a b c d e", " x" * 9 + "\t", "é\u00a0É \x0bfoo\x1cbar baz Q q q q q", "w " * 3000, "tail"]
    flat, ends = shingle_sets(pa.array(texts))
    got = [set(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words_of(t)) else set() for t in texts]
    assert [len(s) for s in got] == [len(s) for s in sets] == np.diff(ends).tolist()
    assert all((len(a & b) > 0) == (len(x & y) > 0) for a, x in zip(got, sets, strict=True) for b, y in zip(got, sets, strict=True))
    alone, _ = shingle_sets(pa.array(texts)[7:9])
    assert set(alone.tolist()) == got[7] | got[8]
    assert [(s.start, s.stop) for s in slices(pa.array(["x" * (5 << 20), "y", None]))] == [(0, 1), (1, 3)]


def hash_order(spark, df):
    return [r.text for r in df.selectExpr("text", "xxhash64(text) AS h").orderBy("h").collect()]


@pytest.mark.parametrize("rows_per_range", [3, 10_000])
def test_edited_texts(spark, rows_per_range):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + [(5000, None), (5001, "é😀" * 7)]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, range int")
    got = {r.doc_id: r for r in fp.with_neighbours(df, rows_per_range).collect()}
    order = sorted(((d, t or "") for d, t in docs), reverse=True)
    mark = lambda t: slow_sketch(t)
    for k, (d, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fp.packed(mark(t)) and r.near_edited == fp.likeness(mark(t), mark(edited)) and r.near_next == fp.likeness(mark(t), mark(nxt))
    assert len(got) == len(docs)
    least, most = -(2**63), 2**63 - 1
    ends = spark.createDataFrame([(least, "a b c d e f g"), (most, "h i j k l m"), (None, "n o p q"), (0, None)], "doc_id long, text string")
    assert {r.doc_id: r.edited_sha256 for r in fp.with_neighbours(ends, 1).collect()}[most] == hashlib.sha256(b"h i j k ").hexdigest()
    assert {r.doc_id: r.edited_sha256 for r in fp.with_neighbours(ends, 1).collect()}[least] == hashlib.sha256(b"a b c d en o ").hexdigest()
    hot = spark.createDataFrame([(7, f"t{i} " * 9) for i in range(300)] + [(None, f"n{i} " * 9) for i in range(300)], "doc_id long, text string")
    rows = fp.with_neighbours(hot, 20).collect()
    nxt = hash_order(spark, hot.where("doc_id = 7")) + hash_order(spark, hot.where("doc_id IS NULL"))
    want = {hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[(k + 1) % len(nxt)][: len(t) // 3]).encode()).hexdigest() for k, t in enumerate(nxt)}
    assert len(rows) == 600 and {r.edited_sha256 for r in rows} == want
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (1, "c")], "doc_id long, text string")
    assert fp.with_neighbours(odd, 1).count() == 4 and fp.with_neighbours(odd.limit(0)).count() == 0 and fp.with_neighbours(odd.limit(1)).first().near_next == 1.0


def test_one_row_of_each_component(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(60)) for w in "abcd")
    rows = [(1, a, 10), (1, a, 9), (2, a, 8), (None, a, 7), (3, b, 6), (3, a + " end", 5), (None, c, 4), (None, c, 3), (None, c + " end", 2), (4, d, 1), (5, None, 0), (5, None, 0), (6, "", 0), (7, "", 0), (None, None, 0), (None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = [tuple(r) for r in corpus_pipeline.near_duplicate(spark, docs, SF).collect()]
    worded = [r for r in got if r[1]]
    assert len(worded) == 4 and {(1, a, 9), (3, b, 6), (4, d, 1)} < set(worded)
    assert [r for r in worded if r[0] is None and r[1].startswith("c0 ")]
    assert sorted(map(str, (r for r in got if not r[1]))) == sorted(map(str, [(5, None, 0), (6, "", 0), (7, "", 0), (None, None, 0)]))
    assert corpus_pipeline.near_duplicate(spark, docs.limit(0), SF).count() == 0


def test_pipeline_stages(spark):
    from cohortspark.llm import leaks, pieces
    from cohortspark.llm.tables import model_path

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"]
    good = corpus_pipeline.quality(spark, docs, SF).cache()
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    single = corpus_pipeline.near_duplicate(spark, good, SF).cache()
    want = {c for _, _, c in exact_components([(r.doc_id, r.text) for r in good.collect()])}
    assert {r.doc_id for r in single.collect()} == want
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = corpus_pipeline.decontamination(spark, single, SF).cache()
    bad = {r.doc_id for r in leaks.leaks(single, bench).collect()}
    assert {r.doc_id for r in clean.collect()} == want - bad
    safe = corpus_pipeline.secrets(spark, clean, SF)
    assert safe.columns == docs.columns and safe.count() == clean.count()
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    enc = pieces.Encoder(pieces.load(model_path("piece_bpe_32k.model")))
    assert {d: enc.ids(t) for d, t in safe.select("doc_id", "text").collect()} == {d: r.ids for d, r in out.items()}


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns that are named like those the stages use inside."""
    from cohortspark.llm import leaks

    text = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").select("text").collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    base = [r.text for r in text if r.text and len(r.text) > 200][:6]
    texts = [None, "", " \n", base[0], base[0], base[0] + " more", "long " * 60_000, base[1], base[2] + " password = 'abcd1234efgh' end", base[3] + " " + item + " " + base[4], base[5]]
    names = ["id", "hash", "_print", "print", "label", "score", "predicted", "held_out", "node", "token", "ids", "decoded", "n", "range"]
    rows = [(None if k in (1, 7) else 5 if k in (3, 4) else k, t, None, "s", None if t is None else len(t), *([k] * len(names))) for k, t in enumerate(texts)]
    rows += [rows[3], rows[7], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, SF)
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).count() <= len(rows)
    single = corpus_pipeline.near_duplicate(spark, docs, SF).collect()
    kept = [r for r in single if r.text and r.text.strip()]
    assert len(kept) == len({r.text for r in kept}) == 6 and sum(r.text.startswith(base[0]) for r in kept) == 1
    assert sum(r.text is None for r in single) == 1
    assert {r.text for r in corpus_pipeline.decontamination(spark, docs, SF).collect()} == {t for t in texts if t is None or item not in t}
    safe = corpus_pipeline.secrets(spark, docs, SF).collect()
    assert len(safe) == len(rows) and [r for r in safe if r.doc_id == 8][0].text == (base[2] + " <SECRET>' end") and all(r.text is None or r.n_chars == len(r.text) for r in safe)
    last = corpus_pipeline.pieces(spark, docs, SF)
    assert last.count() == len(rows) and last.where("n_tokens = 1").count() == 3
    assert leaks.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").distinct().count() == 1
