"""License scan: template markup compiled to token automata, and places of fixed phrases.

A template is text with ``<<beginOptional>>...<<endOptional>>`` (may be missing, nests) and ``<<var;match=".+">>``
(replaceable: one or more words; ``.*`` also none). Its words, as the scan itself cuts them, become an automaton over
words. A text is accepted where, from some word on, all mandatory words follow exactly, in order. One pass over the text
follows all starts at once; where several meet in a state, the latest one is kept.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import DataFrame

from cohortspark.llm._arrow import map_batches
from cohortspark.llm.license_texts import TEMPLATES

#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;match=\"(\.[+*])\")>>")


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased."""
    return _WORD(text.encode().lower()) if text else []


def parse(template: str) -> list:
    """A tree: words (bytes), ("var", least) and ("optional", [...])."""
    stack: list[list] = [[]]
    at = 0
    for m in _MARKUP.finditer(template):
        stack[-1] += words_of(template[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            inner = stack.pop()
            if not stack:
                raise ValueError("endOptional without beginOptional")
            if inner:
                stack[-1].append(("optional", inner))
        else:
            stack[-1].append(("var", 1 if m[2] == ".+" else 0))
    if len(stack) != 1:
        raise ValueError("beginOptional without endOptional")
    stack[0] += words_of(template[at:])
    if not any(isinstance(x, bytes) for x in stack[0]):
        raise ValueError("a template needs mandatory words")
    return stack[0]


class Automaton:
    """States 0..n-1; word edges, any-word edges and empty edges."""

    def __init__(self, template: str, max_var: int | None = None):
        self.word: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.empty: list[list[int]] = [[]]
        self.end = self._add(parse(template), 0, max_var)
        self.after = [self._close({s}) for s in range(len(self.word))]
        self.begin = self.after[0]
        self.first = {w for s in self.begin for w in self.word[s]}
        #: Words that every accepted text has.
        self.needs = {x for x in parse(template) if isinstance(x, bytes)}
        self.open = any(self.any[s] is not None for s in self.begin)

    def _state(self) -> int:
        self.word.append({})
        self.any.append(None)
        self.empty.append([])
        return len(self.word) - 1

    def _add(self, parts: list, at: int, max_var: int | None) -> int:
        for x in parts:
            if isinstance(x, bytes):
                nxt = self._state()
                self.word[at][x] = nxt
            elif x[0] == "optional":
                entry, nxt = self._state(), self._state()
                self.empty[at] += [entry, nxt]
                self.empty[self._add(x[1], entry, max_var)].append(nxt)
            elif max_var is None:
                loop, nxt = self._state(), self._state()
                if x[1]:
                    self.any[at] = loop
                else:
                    self.empty[at].append(loop)
                self.any[loop] = loop
                self.empty[loop].append(nxt)
            else:
                nxt, here = self._state(), at
                for k in range(max_var + 1):
                    if k >= x[1]:
                        self.empty[here].append(nxt)
                    if k < max_var:
                        self.any[here] = step = self._state()
                        here = step
            at = nxt
        return at

    def _close(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def find(self, words: Sequence[bytes], starts: Sequence[int]) -> list[tuple[int, int]]:
        """(first word, word after) of the accepted stretches that begin at one of the starts (ascending).

        Of the stretches with one end, that of the latest start counts; of those with one start, the shortest.
        """
        found: dict[int, int] = {}
        active: dict[int, int] = {}
        word, free, after, end = self.word, self.any, self.after, self.end
        todo = iter(starts)
        nxt = next(todo, None)
        i = nxt
        while i is not None and i < len(words):
            if i == nxt:
                active.update(dict.fromkeys(self.begin, i))
                nxt = next(todo, None)
            w, new = words[i], {}
            for s, a in active.items():
                for t in (word[s].get(w), free[s]):
                    if t is not None:
                        for u in after[t]:
                            if new.get(u, -1) < a:
                                new[u] = a
            active = new
            i += 1
            if end in active:
                found.setdefault(active[end], i)
            if not active:
                i = nxt
        return sorted(found.items())


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, phrases: Sequence[tuple[str, str]] = PHRASES, max_var: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    n_base counts all places where a phrase's words stand consecutively, first_word and last_word are the smallest and
    largest start of one (null without any). labels also holds the templates accepted anywhere; matches lists each as
    "label:first word:end". A replaceable region takes any number of words unless max_var bounds it. score is 1 with an accepted template, 0.5 with phrases alone, else 0. Null text counts as
    empty; repeated rows and null ids stay; other columns are ignored. Row-local, no shuffle.
    """
    templates = dict(TEMPLATES if templates is None else templates)
    listed = [(words_of(p), label) for p, label in phrases]

    def make():
        autos = [(label, Automaton(t, max_var)) for label, t in templates.items()]
        firsts = frozenset().union(*(a.first for _, a in autos))
        heads: dict[bytes, list] = {}
        for p, label in listed:
            heads.setdefault(p[0], []).append((p, label))
        watched = frozenset(heads) | firsts

        def one(text):
            words = words_of(text)
            base, base_labels, found, there = [], set(), {}, None
            seen: dict[bytes, list[int]] = {}
            for i, w in enumerate(words):
                if w in watched:
                    seen.setdefault(w, []).append(i)
                    for p, label in heads.get(w, ()):
                        if words[i : i + len(p)] == p:
                            base.append(i)
                            base_labels.add(label)
            for label, a in autos:
                starts = range(len(words)) if a.open else sorted(chain.from_iterable(seen.get(w, ()) for w in a.first))
                if starts and a.needs <= (there := there if there is not None else set(words)):
                    got = a.find(words, starts)
                    if got:
                        found[label] = [f"{label}:{x}:{y}" for x, y in got]
            return (
                len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)),
                ",".join(sorted(base_labels | set(found))), 1.0 if found else 0.5 if base else 0.0, [m for k in sorted(found) for m in found[k]],
            )

        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")

        def work(cols):
            rows = [one(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"]} | {n: [r[k] for r in rows] for k, n in enumerate(names)}

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<string>")
