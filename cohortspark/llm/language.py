"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier over hashed character n-grams of words predicts each bit. Decoding
takes the codeword with the least loss, each bit weighted by how well its classifier separates the training rows; two
codewords nearly as close flag the text as ambiguous.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm._arrow import map_batches
from cohortspark.llm._memory import LONGEST_KEY, Remembered
from cohortspark.llm._sample import drawn_with, remainder

MODULUS, HELD = 3, 1
#: At most about so many rows are fitted, and so many more of each language that is rare among them; languages of that kind at most.
TRAIN_ROWS, RARE_ROWS, MOST_RARE = 4_000, 50, 200
#: Hashed n-grams (1 to 4 characters of a word with its ends marked).
FEATURES, LONGEST = 1 << 12, 4
#: Most bits of a codeword.
MOST_BITS = 31
#: Texts whose best probability is not this far above the next are flagged.
MARGIN = 0.2
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+").findall
#: Words whose sums a task remembers.
MOST_WORDS = 200_000


def grams_of(word: str) -> list[int]:
    """Hashed n-grams of a lower-cased word; none if it has no letter."""
    if not any(map(str.isalpha, word)):
        return []
    data = f"<{word}>"
    return [zlib.crc32(data[i : i + n].encode()) % FEATURES for n in range(1, LONGEST + 1) for i in range(len(data) - n + 1)]


def codewords(k: int) -> np.ndarray:
    """k codewords of +1/-1: all distinct two-way splits for few languages, else random ones kept far apart."""
    if k < 2:
        return np.ones((k, 1))
    if 2 ** (k - 1) - 1 <= MOST_BITS:
        bits = [[1 if i == 0 or not (m >> (i - 1)) & 1 else -1 for i in range(k)] for m in range(1, 2 ** (k - 1))]
        return np.array(bits, dtype=float).T
    best, apart = None, -1
    for seed in range(200):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], size=(k, MOST_BITS))
        far = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        if far > apart:
            best, apart = code, far
    return best


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray
    #: [feature, bit], read per n-gram; the sum over a text is divided by its number of n-grams.
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability and the lead over the next, for rows of bit scores."""
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        top = np.sort(p, axis=1)
        return p.argmax(axis=1), top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], steps: int = 100, rate: float = 0.05, ridge: float = 1e-4) -> Model:
    """Bit classifiers (logistic, full-batch Adam on n-gram shares) from (features, counts) of each text."""
    names = sorted(set(langs))
    code = codewords(len(names))
    y = code[[names.index(x) for x in langs]]
    x = np.zeros((len(rows), FEATURES), dtype=np.float32)
    for i, (at, count) in enumerate(rows):
        x[i, at] = 100 * count / count.sum()
    bits = code.shape[1]
    w, b = np.zeros((FEATURES, bits), dtype=np.float32), np.zeros(bits)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        f = x @ w + b
        d = -y / (1 + np.exp(np.clip(y * f, -50, 50))) / len(rows)
        g = x.T @ d.astype(np.float32) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= 0.5 * d.sum(axis=0)
    right = np.clip((np.sign(f) == y).mean(axis=0), 0.05, 0.999)
    trust = np.clip(np.log(right / (1 - right)), 0.05, None)
    return Model(names, code, (w * 100).astype(np.float32), b, 3 * trust / trust.sum())


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """The model from a bounded sample of rows with a language outside the held-out ones; None without any such row.

    A language with few rows in a plain sample is drawn on its own, so that it is learned however rare it is.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", MODULUS) != HELD))
    sample = drawn_with(known, "lang", rows, RARE_ROWS, MOST_RARE)

    def make():
        known = Remembered(grams_of, lambda g: 40 * len(g))

        def grams(text):
            out: list[int] = []
            for w in _WORD(text.lower()):
                out += known[w]
            return np.unique(np.array(out, dtype=np.int32), return_counts=True)

        def work(cols):
            got = [(i, lang, *grams(t)) for i, t, lang in zip(cols["doc_id"], cols["text"], cols["lang"], strict=True)]
            got = [x for x in got if len(x[2])]
            return {"doc_id": [x[0] for x in got], "lang": [x[1] for x in got], "grams": [x[2].tobytes() for x in got], "counts": [x[3].astype(np.int32).tobytes() for x in got]}

        return work

    got: pd.DataFrame = map_batches(sample, make, "doc_id long, lang string, grams binary, counts binary").toPandas().sort_values(["doc_id", "lang", "grams"])
    if got.empty:
        return None
    pairs = [(np.frombuffer(a, dtype=np.int32), np.frombuffer(b, dtype=np.int32).astype(float)) for a, b in zip(got["grams"], got["counts"], strict=True)]
    return fit(pairs, got["lang"].tolist())


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Language of every whole text: doc_id, held_out, lang_pred, score, ambiguous.

    Of equally near languages the first by name counts, and the text is flagged. Null text, text without a letter and any text without a model give ``und`` with score 0, flagged as ambiguous. A null
    id is not held out; repeated rows stay; an empty table gives an empty result. Row-local, no shuffle.
    """

    def make():
        ids: dict[str, int] = {}
        table = np.zeros((1 << 12, model.code.shape[1] + 1 if model else 1), dtype=np.float32)

        def vectors(words: list[str]) -> np.ndarray:
            """Sum over the words of n-gram weights, and the number of n-grams."""
            nonlocal table
            if len(ids) > MOST_WORDS:
                ids.clear()
            long = False
            for w in set(words).difference(ids):
                k = ids[w] = len(ids)
                long |= len(w) > LONGEST_KEY
                if k >= len(table):
                    table = np.concatenate([table, np.zeros_like(table)])
                g = grams_of(w)
                table[k, :-1] = model.weight[g].sum(axis=0) if g else 0
                table[k, -1] = len(g)
            total = table[np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0, dtype=np.float64)
            if long:  # text without spaces: nothing to remember
                ids.clear()
            return total

        def work(cols):
            n = len(cols["doc_id"])
            out = {"doc_id": cols["doc_id"], "lang_pred": [UNKNOWN] * n, "score": [0.0] * n, "ambiguous": [True] * n}
            sums = np.array([vectors(_WORD(t.lower())) if t and model else np.zeros(table.shape[1]) for t in cols["text"]])
            if model and n:
                at = np.flatnonzero(sums[:, -1] > 0)
                best, p, lead = model.decode(sums[at, :-1] / sums[at, -1:] + model.bias)
                for i, k, s, d in zip(at.tolist(), best.tolist(), p.tolist(), lead.tolist(), strict=True):
                    out["lang_pred"][i], out["score"][i], out["ambiguous"][i] = model.languages[k], s, d < MARGIN
            return out

        return work

    scored = map_batches(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return scored.withColumn("held_out", F.coalesce(remainder("doc_id", MODULUS) == HELD, F.lit(False)))
