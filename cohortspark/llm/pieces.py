"""SentencePiece encoding and decoding with a merge-type (BPE) model.

Method: every prefix of a chunk of text has exactly one last token in its BPE encoding. A table stores that token for
each prefix: the vocabulary automaton lists the pieces that end at a position, and the one whose predecessor's last
token is compatible with it (BPE keeps the two apart when they stand together) is the entry. Ids are then read
backwards from the end of the chunk. A chunk is a run of spaces and the word after it, up to a mark that no piece
has after a letter; no piece holds a space after another character either, so merges never cross chunks. Equal
short chunks are encoded once per task (bounded memory).
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import ahocorasick
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from cohortspark.llm._arrow import map_batches
from cohortspark.llm._memory import BOUND, Remembered

SPACE = "▁"
UNK, BOS, EOS = 0, 1, 2
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: Pairs of pieces whose compatibility is remembered, some 100 bytes each.
MOST_PAIRS = 500_000
_MARKS = "\n,.!?;:%&*$#|\"'()@/=-"


def merge_all(chars: list[str], score: dict[str, float]) -> list[str]:
    """Plain BPE on a short list: merge the best-scored neighbours, the leftmost of equals, until none is a piece."""
    parts = list(chars)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Pieces:
    """Vocabulary, automaton and the last merge of each piece."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with identity normalisation and kept white space is expected")
        self.dummy = norm.add_dummy_prefix
        self.text = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.score = {p: proto.pieces[i].score for p, i in self.id.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece crosses words")
        #: Marks that no piece has after a letter: a word ends there too, whatever follows.
        after = {(a, b) for p in self.id for a, b in zip(p, p[1:], strict=False)}
        letter = re.compile(_LETTER).match
        marks = "".join(re.escape(m) for m in _MARKS if not any(letter(a) and b == m for a, b in after))
        self.chunks = re.compile(f"{SPACE}*(?:{_LETTER}+(?=[{marks}])|[^{SPACE}]+)|{SPACE}+").findall
        self.byte = [0] * 256
        self.byte_of = {}
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
                self.byte_of[i] = int(p.piece[3:5], 16)
        self.fallback = train.byte_fallback
        #: piece -> the two parts of its last merge; characters have none. Pieces that BPE never builds are left out.
        self.last: dict[str, tuple[str, str] | None] = {c: None for c in set("".join(self.id))}
        self.auto = ahocorasick.Automaton()
        for p in sorted(self.id, key=len):
            if len(p) > 1 and p.strip(SPACE):
                cut = self._last_merge(p)
                if cut is None:
                    continue
                self.last[p] = cut
            elif len(p) > 1:
                continue
            self.auto.add_word(p, (p, len(p)))
        for c in self.last:
            if len(c) == 1 and c not in self.id:
                self.auto.add_word(c, (c, 1))
        self.auto.make_automaton()
        self._pairs: dict[tuple[str, str], bool] = {}
        self.shown = [self._shown(i) for i in range(len(self.text))]
        self.digits = [str(i) for i in range(len(self.text))]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The cut whose halves are pieces that BPE keeps apart until the piece itself is merged."""
        lower = self.score[piece]
        known = {k: v for k, v in ((piece[a:b], self.score.get(piece[a:b])) for a in range(len(piece)) for b in range(a + 2, len(piece) + 1)) if v is not None and v > lower}
        parts = merge_all(list(piece), known)
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def compatible(self, left: str, right: str) -> bool:
        """Whether BPE of left + right keeps exactly these two tokens.

        Undo merges on both sides of the boundary from the latest on; a merge across it that comes earlier than the
        next undone one would have taken place.
        """
        got = self._pairs.get((left, right))
        if got is not None:
            return got
        a, b, ok = left, right, True
        score, last = self.score, self.last
        #: The merge across must be better than the worst still standing inner merge to happen before it.
        bar_a = bar_b = float("inf")
        while True:
            s = score.get(a + b)
            if s is not None:
                # across-merge happens when reached before the piece that swallows a (bar_a) or b (bar_b) is built;
                # on equal scores the leftmost goes first: left's merge, then the one across, then right's
                if (bar_a == float("inf") or s > bar_a) and (bar_b == float("inf") or s >= bar_b):
                    ok = False
                    break
            ca, cb = last.get(a), last.get(b)
            if ca is None and cb is None:
                break
            sa = score[a] if ca else float("inf")
            sb = score[b] if cb else float("inf")
            if sb <= sa:  # the right one was merged later (or last among equals): undo it first
                bar_b, b = sb, cb[0]
            else:
                bar_a, a = sa, ca[1]
        if len(self._pairs) > MOST_PAIRS:
            self._pairs.clear()
        self._pairs[left, right] = ok
        return ok

    def _spaces(self, n: int) -> list[str]:
        """Tokens of n spaces: all merges score alike, so the leftmost grows as far as the vocabulary allows."""
        parts: list[int] = [1] * min(n, 64)
        rest = n - len(parts)
        while True:
            at = next((i for i in range(len(parts) - 1) if SPACE * (parts[i] + parts[i + 1]) in self.id), -1)
            if at >= 0:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            elif rest and len(parts) > 1 and parts[0] == max(len(p) for p in self.id if not p.strip(SPACE)):
                return [SPACE * parts[0]] + self._spaces(n - parts[0]) if n < 4096 else self._many(n, parts[0])
            else:
                return [SPACE * p for p in parts]

    def _many(self, n: int, longest: int) -> list[str]:
        lead = (n - 1024) // longest
        return [SPACE * longest] * lead + self._spaces(n - lead * longest)

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """Ids of one chunk by the prefix table."""
        word = chunk.lstrip(SPACE)
        pad = len(chunk) - len(word)
        body = SPACE + word if pad else word
        if not word:
            return tuple(self.id[p] for p in self._spaces(pad))
        table: list[str | None] = [None] * len(body)
        pairs = self._pairs
        for end, (piece, n) in self.auto.iter(body):  # at each end the longest piece first
            if table[end] is not None:
                continue
            start = end - n
            if start >= 0:
                before = table[start]
                if before is None:  # a character outside the vocabulary merges with nothing
                    before = table[start] = body[start]
                ok = pairs.get((before, piece))
                if ok is None:
                    ok = self.compatible(before, piece)
                if not ok:
                    continue
            table[end] = piece
        out: list[str] = []
        at = len(body)
        while at:
            out.append(table[at - 1] or body[at - 1])
            at -= len(out[-1])
        out.reverse()
        if pad > 1:  # earlier spaces merge after everything else, with the last one only if it stayed alone
            out = self._spaces(pad) + out[1:] if out[0] == SPACE else self._spaces(pad - 1) + out
        ids: list[int] = []
        for p in out:
            i = self.id.get(p)
            if i is not None:
                ids.append(i)
            elif self.fallback:
                ids.extend(self.byte[x] for x in p.encode())
            else:
                ids.append(UNK)
        return tuple(ids)

    def _shown(self, i: int) -> str | None:
        if self.kind[i] == 6:
            return None
        return "" if self.kind[i] == 3 else " ⁇ " if self.kind[i] == 2 else self.text[i].replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, bytes read as UTF-8 (each byte that fits nowhere becomes U+FFFD)."""
        shown = self.shown
        try:
            text = "".join(map(shown.__getitem__, ids))
        except TypeError:
            parts: list[str] = []
            run = bytearray()
            for i in [*ids, None]:
                if i is not None and i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    parts.append(bytes_text(bytes(run)))
                    run.clear()
                if i is not None:
                    parts.append(shown[i])
            text = "".join(parts)
        first = next((i for i in ids if self.kind[i] != 3), None)
        return text[1:] if self.dummy and first is not None and self.text[first].startswith(SPACE) else text


def bytes_text(data: bytes) -> str:
    """UTF-8 text; every byte that is no part of a whole character becomes one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The model in this process; path is looked up as given, then among the files Spark has shipped."""
    import os

    if not os.path.exists(path):
        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        return Pieces(f.read())


class Encoder:
    """Encodes whole texts, with the ids of short chunks remembered up to a bound of memory."""

    def __init__(self, pieces: Pieces, bound: int = BOUND):
        self.p, self.known = pieces, Remembered(pieces.chunk_ids, lambda ids: 8 * len(ids), bound)

    def ids(self, text: str | None, eos: bool = True) -> list[int]:
        if not text:
            return [EOS] if eos else []
        body = (SPACE if self.p.dummy else "") + text.replace(" ", SPACE)
        out = list(chain.from_iterable(map(self.known.__getitem__, self.p.chunks(body))))
        if eos:
            out.append(EOS)
        return out


def encode_decode(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Encode the text of every row (null: empty; end id only) and decode it again.

    Returns doc_id, n_tokens, ids (array<int>, null unless with_ids), ids_sha256, decoded (null unless with_ids) and
    decoded_sha256, one row per input row: repeated rows stay, a null doc_id stays, other columns are ignored, an
    empty table gives an empty result. Row-local: one scan of (doc_id, text), no shuffle.
    """

    def make():
        pieces = load(model_path)
        enc = Encoder(pieces)
        digits = pieces.digits

        def work(cols):
            out = {k: [] for k in ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")}
            for text in cols["text"]:
                ids = enc.ids(text)
                back = pieces.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                out["ids"].append(ids if with_ids else None)
                out["decoded"].append(back if with_ids else None)
            return out | {"doc_id": cols["doc_id"]}

        return work

    return map_batches(
        docs.select("doc_id", "text"), make,
        "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string",
    )
