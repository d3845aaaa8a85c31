"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives Viterbi.

The vocabulary's pieces and scores are read from a model file; nothing is
trained.  The automaton over all pieces is fed a text character by character.
Following the output links from the state reached lists every piece that ends
here, longest first, and each relaxes the best score of the position it ends
at, so one pass gives the segmentation of the largest total score (ties: the
longest last piece).  A character without a piece of its own costs the lowest
score less ten and becomes byte pieces.

Spaces are written as U+2581 and a text starts with one (the model's dummy
prefix).  No piece may continue from a letter into U+2581 (checked when the
vocabulary is loaded), and characters in no piece stand alone, so every
segmentation has a border there.  The automaton therefore runs on the parts
between such borders and a bounded memo keeps the results of short parts; the
outcome equals the run over the whole text.

Round trip: ``decode(encode(text)) == text`` for every valid text.  A literal
U+2581 is written as byte pieces, so it is not mistaken for a space.

Defined results: null counts as the empty text, which has no tokens.  Rows
are never merged; only the named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankfold.llm.common import received, returning_memory, ship
from rankfold.llm.text import text_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: what an unknown character costs beyond the lowest score (the library's constant)
UNKNOWN_COST = 10.0
#: parts in the memo, and the longest one kept
MEMO_PARTS, MEMO_CHARS = 150_000, 48


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], byte_ids: dict[int, int]):
        self.pieces, self.scores, self.special, self.byte_ids = pieces, scores, special, byte_ids
        normal = [i for i in range(len(pieces)) if i not in special]
        if any(re.search(f"[^{SPACE}]{SPACE}", pieces[i]) for i in normal):
            raise ValueError("a piece continues into a space; texts cannot be cut at spaces")
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary needs all byte pieces")
        self.normal = normal

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        return cls(pieces, [sp.get_score(i) for i in range(n)], special, byte_ids)


class Automaton:
    """Aho-Corasick automaton over the normal pieces of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.goto: list[dict[str, int]] = [{}]
        self.piece = [-1]
        for i in v.normal:
            state = 0
            for c in v.pieces[i]:
                to = self.goto[state].get(c)
                if to is None:
                    to = self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.piece.append(-1)
                state = to
            if self.piece[state] < 0:  # the first of equal pieces counts
                self.piece[state] = i
        self.fail = [0] * len(self.goto)
        #: nearest state on the failure path that ends a piece (0: none)
        self.output = [0] * len(self.goto)
        queue = list(self.goto[0].values())
        for state in queue:
            for c, to in self.goto[state].items():
                f = self.fail[state]
                while f and c not in self.goto[f]:
                    f = self.fail[f]
                self.fail[to] = self.goto[f].get(c, 0)
                queue.append(to)
            f = self.fail[state]
            self.output[state] = f if self.piece[f] >= 0 else self.output[f]
        self.length = [len(v.pieces[i]) if i >= 0 else 0 for i in self.piece]
        self.score = [v.scores[i] if i >= 0 else 0.0 for i in self.piece]
        self.unknown = min((v.scores[i] for i in v.normal), default=0.0) - UNKNOWN_COST
        self.byte_ids = v.byte_ids
        #: bytes that a piece decodes to
        table = [b""] * len(v.pieces)
        for i in v.normal:
            table[i] = v.pieces[i].replace(SPACE, " ").encode()
        for b, i in v.byte_ids.items():
            table[i] = bytes([b])
        self.bytes_of = table
        known = {c for i in v.normal for c in v.pieces[i]} - {SPACE}
        inner = "".join(re.escape(c) for c in sorted(known))
        some = f"[{inner}]" if inner else "(?!)"
        other = f"[^{inner}{SPACE}]"
        self.part_pattern = f"{SPACE}*{some}+|{SPACE}+|{other}"

    def segment(self, text: str) -> list[int]:
        """Piece ids of the best segmentation of ``text`` (already with U+2581)."""
        goto, fail, output, piece, length, score = self.goto, self.fail, self.output, self.piece, self.length, self.score
        n = len(text)
        best, back = [0.0] * (n + 1), [0] * (n + 1)
        state = 0
        for i, c in enumerate(text):
            while state and c not in goto[state]:
                state = fail[state]
            state = goto[state].get(c, 0)
            top, via, single = -np.inf, 0, False
            s = state if piece[state] >= 0 else output[state]
            while s:
                n_chars = length[s]
                single |= n_chars == 1
                value = best[i + 1 - n_chars] + score[s]
                if value > top:
                    top, via = value, s
                s = output[s]
            if not single and best[i] + self.unknown > top:
                top, via = best[i] + self.unknown, 0
            best[i + 1], back[i + 1] = top, via
        ids: list[int] = []
        while n:
            s = back[n]
            if s:
                ids.append(piece[s])
                n -= length[s]
            else:
                ids.extend(self.byte_ids[b] for b in reversed(text[n - 1].encode()))
                n -= 1
        ids.reverse()
        return ids

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")
        return raw[1:] if raw.startswith(" ") else raw


class Memo(dict):
    """Part -> packed ids; emptied when full, so its size is bounded."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, part: str) -> bytes:
        out = np.array(self.automaton.segment(part), np.int32).tobytes()
        if len(part) <= MEMO_CHARS:
            if len(self) >= MEMO_PARTS:
                self.clear()
            self[part] = out
        return out


class Encoder:
    """Encodes texts with a memo of parts; one per task."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.memo = automaton, Memo(automaton)
        self.parts = re.compile(automaton.part_pattern, re.DOTALL).findall
        self.literal = np.array([automaton.byte_ids[b] for b in SPACE.encode()], np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        pieces = []
        for k, run in enumerate(text.split(SPACE)):  # a literal U+2581 stands alone
            if k:
                pieces.append(self.literal)
            run = run.replace(" ", SPACE)
            pieces.extend(map(self.memo.__getitem__, self.parts(SPACE + run if k == 0 else run)))
        return np.frombuffer(b"".join(pieces), np.int32)


def _encoder(broadcast, keep: list[str], text: str, check: bool):
    def run(batches):
        encoder = Encoder(received(broadcast))
        decode = encoder.automaton.decode
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column(text)):
                buf, at = data.tobytes(), off.tolist()
                ids, same = [], []
                for r in range(j - i):
                    t = buf[at[r]:at[r + 1]].decode()
                    ids.append(encoder.encode(t))
                    if check:
                        same.append(decode(ids[-1].tolist()) == t)
                n = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids)))
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), lists, pa.array(n), *([pa.array(same)] if check else [])],
                                                 names=[*keep, "ids", "n_tokens", *(["exact"] if check else [])])

    return run


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", vocabulary: Vocabulary | None = None, check: bool = False) -> DataFrame:
    """The kept columns with ``ids`` and ``n_tokens``; with ``check`` also ``exact``:
    whether decoding the ids gives the text again."""
    automaton = Automaton(vocabulary or Vocabulary.load())
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    fields += ", ids array<int>, n_tokens bigint" + ", exact boolean" * check
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(returning_memory(_encoder(ship(docs.sparkSession, automaton), list(keep), text, check)), fields)


def _decoder(broadcast, keep: list[str], ids: str):
    def run(batches):
        automaton = received(broadcast)
        for batch in batches:
            texts = [None if x is None else automaton.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return run


def decode(tokens: DataFrame, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", vocabulary: Vocabulary | None = None) -> DataFrame:
    """The kept columns with the ``text`` that the ids stand for (null ids: null)."""
    automaton = Automaton(vocabulary or Vocabulary.load())
    fields = ", ".join(f"`{c}` {t}" for c, t in tokens.select(*keep).dtypes) + ", text string"
    return tokens.select(*dict.fromkeys([*keep, ids])).mapInArrow(returning_memory(_decoder(ship(tokens.sparkSession, automaton), list(keep), ids)), fields)
