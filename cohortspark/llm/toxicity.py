"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the presence of word and character n-gram features is fitted from confirmed toxic texts and
unlabelled ones. The risk of the unlabelled part is corrected by the class prior; where the corrected negative risk turns
negative, the step goes against it, so the model cannot overfit by calling every unlabelled text clean. Texts labelled clean are
no part of that risk; a bounded number of them is read to estimate the class prior, and for nothing else.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._arrow import map_batches
from cohortspark.llm._memory import Remembered
from cohortspark.llm._sample import drawn, labelled, remainder

MODULUS, HELD = 4, 2
#: At most about so many confirmed toxic and unlabelled rows are fitted, and clean ones read for the class prior.
POSITIVE_ROWS, UNLABELLED_ROWS, CLEAN_ROWS = 4_000, 8_000, 2_000
#: Hash space of features, and how many of them the model uses.
SPACE, CHOSEN = 1 << 20, 768
#: Share of the greatest possible log lift (that of the class prior) that a chosen feature shows at least.
LEAST_LIFT = 0.6
#: Standard deviations that its toxic count lies above the expected one at least: words, n-grams.
LEAST_Z = 2.5, 5.0
#: Weight of the squared weights: what few texts show counts little.
RIDGE = 2e-3
CUT = 0.3
_WORD = re.compile(r"[^\W_]+").findall
#: Tasks that count features of the sample; each sends two arrays of SPACE counts.
_COUNTERS = 8


def features_of(word: str) -> list[int]:
    """Hashed features of a lower-cased word: the word (even) and its n-grams of 3 to 5 characters, ends marked (odd)."""
    data = f"<{word}>"
    grams = {zlib.crc32(data[i : i + n].encode()) % SPACE | 1 for n in (3, 4, 5) for i in range(len(data) - n + 1)}
    return [*grams, zlib.crc32(word.encode()) % SPACE & ~1]


class Model(NamedTuple):
    features: np.ndarray
    weight: np.ndarray
    bias: float


def nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative risk: prior R+(P) + max(0, R-(U) - prior R-(P)), logistic loss."""
    k = xp.shape[1]
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, steps + 1):
        fp, fu = xp @ w + b, xu @ w + b
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        dp = -prior * sig(-fp) / len(fp)
        dn_u, dn_p = sig(fu) / len(fu), -prior * sig(fp) / len(fp)
        if negative >= 0:
            gp, gu = dp + dn_p, dn_u
        else:
            gp, gu = -dn_p, -dn_u
        g = np.append(gp @ xp + gu @ xu + ridge * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _features(make_value):
    """The distinct features of a text, from those of its words."""
    known = Remembered(make_value, lambda features: 40 * len(features))
    return lambda text: set().union(*map(known.__getitem__, set(_WORD(text.lower()))))


def unlabelled_prior(x: np.ndarray, kind: np.ndarray, start: float) -> float:
    """Share of toxic texts among the unlabelled ones (kind 0), by adjusted counting.

    A model of half the toxic rows (kind 1) is read on the other half, on clean rows (kind -1) and on the unlabelled ones:
    the share it flags there, less what it flags of clean rows, over what it finds of toxic rows beyond that. ``start`` is the prior of
    that model, and the answer where it tells nothing apart.
    """
    toxic = np.flatnonzero(kind == 1)
    if len(toxic) < 4 or not (kind == -1).any():
        return start
    w, b = nnpu(x[toxic[::2]], x[kind == 0], start, steps=100)
    flagged = x @ w + b >= 0
    found, false, share = flagged[toxic[1::2]].mean(), flagged[kind == -1].mean(), flagged[kind == 0].mean()
    return float(np.clip((share - false) / (found - false), 0.001, 0.9)) if found - false > 0.2 else start


def train(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, clean_rows: int = CLEAN_ROWS) -> Model | None:
    """The model from confirmed toxic rows and unlabelled documents outside the held-out remainder; None without toxic rows.

    The class prior starts as the share of toxic rows among the labelled ones and is then estimated for the unlabelled
    rows, which are drawn from all documents. Of several labels of an id the largest counts.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & (remainder("doc_id", MODULUS) != HELD))
    prior = usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not prior:
        return None
    prior = float(np.clip(prior, 0.001, 0.9))
    of = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pos = labelled(docs, of.where("toxic = 1"), "toxic", positive_rows, MODULUS, HELD)
    clean = labelled(docs, of.where("toxic = 0"), "toxic", clean_rows, MODULUS, HELD).withColumn("label", F.lit(-1))
    unl = drawn(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (remainder("doc_id", MODULUS) != HELD)), unlabelled_rows)
    sample = pos.unionByName(clean).unionByName(unl.select("doc_id", F.lit(0).alias("label"), "text")).repartition(_COUNTERS).checkpoint()

    def count():
        def work(cols):
            get = _features(features_of)
            sums = np.zeros((2, SPACE), dtype=np.int32)
            for text, label in zip(cols["text"], cols["label"], strict=True):
                if label >= 0:
                    sums[label, list(get(text or ""))] += 1
            at = np.flatnonzero(sums.any(axis=0))
            return {"at": [at.astype(np.int32).tobytes()], "n": [sums[:, at].tobytes()]}

        return work

    sums = np.zeros((2, SPACE), dtype=np.int64)
    for row in map_batches(sample, count, "at binary, n binary").toLocalIterator():
        at = np.frombuffer(row["at"], dtype=np.int32)
        sums[:, at] += np.frombuffer(row["n"], dtype=np.int32).reshape(2, -1)
    n_unl, n_pos = sample.where("label = 0").count(), sample.where("label = 1").count()
    if not n_pos or not n_unl:
        return None
    lift = np.log((sums[1] + 0.5) / (n_pos + 1)) - np.log((sums[0] + 0.5) / (n_unl + 1))
    expected = sums[0] * (n_pos / n_unl)
    clear = (sums[1] - expected) / np.sqrt(expected + 1) >= np.where(np.arange(SPACE) % 2 == 0, *LEAST_Z)
    # a feature of toxic texts only has the lift 1 / prior, as the unlabelled part holds toxic texts too
    gain = np.where(clear & (lift >= LEAST_LIFT * np.log(1 / prior)), sums[1] * lift, 0)
    chosen = np.sort(np.argsort(-gain, kind="stable")[: min(CHOSEN, int((gain > 0).sum()))])
    if not len(chosen):
        return Model(chosen, np.zeros(0), float(np.log(prior / (1 - prior))))

    def pick():
        place = {int(f): k for k, f in enumerate(chosen)}
        get = _features(lambda w: [place[f] for f in features_of(w) if f in place])
        return lambda cols: {"label": cols["label"], "doc_id": cols["doc_id"], "at": [sorted(get(t or "")) for t in cols["text"]]}

    got = map_batches(sample, pick, "doc_id long, label int, at array<int>").toPandas()
    got["spelled"] = got["at"].map(lambda at: tuple(at))
    got = got.sort_values(["label", "doc_id", "spelled"])
    x = np.zeros((len(got), len(chosen)), dtype=np.float32)
    for i, at in enumerate(got["at"]):
        x[i, np.asarray(at, dtype=int)] = 1
    kind = got["label"].to_numpy()
    w, b = nnpu(x[kind == 1], x[kind == 0], unlabelled_prior(x, kind, prior))
    used = np.flatnonzero(w)
    return Model(chosen[used], w[used], b)


def score(docs: DataFrame, model: Model | None, cut: float = CUT) -> DataFrame:
    """Score of every document's whole text: doc_id, held_out, score, predicted.

    Null text scores like empty text; without a model every score is 0. A null id is not held out; repeated rows stay;
    an empty table gives an empty result. Row-local, no shuffle.
    """

    def make():
        weight = dict(zip(model.features.tolist(), model.weight.tolist(), strict=True)) if model else {}
        get = _features(lambda w: [f for f in features_of(w) if f in weight])

        def work(cols):
            raw = np.array([model.bias + sum(weight[f] for f in sorted(get(t or ""))) for t in cols["text"]]) if model else np.full(len(cols["text"]), -np.inf)
            p = 1 / (1 + np.exp(-np.clip(raw, -700, 700)))
            return {"doc_id": cols["doc_id"], "score": p.tolist(), "predicted": (p >= cut).astype(int).tolist()}

        return work

    scored = map_batches(docs.select("doc_id", "text"), make, "doc_id long, score double, predicted int")
    return scored.withColumn("held_out", F.coalesce(remainder("doc_id", MODULUS) == HELD, F.lit(False)))
