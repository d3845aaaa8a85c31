"""Spelling variants by finite-state composition.

The vocabulary's words that differ by exactly one inserted, deleted or replaced
code point are the pairs that the composition of three machines accepts: the
minimised acceptor of the vocabulary, a transducer that makes one edit, and the
acceptor again.  ``Acceptor`` is the minimised machine; ``replaced`` and
``inserted`` walk the composition: both sides together while nothing is edited,
one edit at the first difference, then only what both still accept.

No machine holds the whole vocabulary.  The composition is split by the state
that its enumeration starts in: with an edit in the back half of a word, that is
the state its front half leads to; with an edit in the front half, the state its
back half leads to in the reversed machine.  Words are dealt out by these halves
(for either length that their partner may have), and each part holds the
machines below its initial state, that is of the halves left over.  A part of
more than ``PART_WORDS`` words is split again, by the halves of the half, until
one code point is left, when no more words than code points can share a part.
So no part grows with the corpus and every pair is found, once.

A word's form is its near word with the largest count, where that is twice its
own or more; roots follow forms to the last.  Counts double at every step, so
chains are short and pointers are doubled until none moves.

Defined results: a null text has no words, and a null doc_id is written as the
empty text.  Repeated rows count as often as they occur.  Ties between forms go
to the smallest in code-point order.  Empty tables give empty results.  Only
doc_id and text (``vocabulary``), or word and n (``near_pairs``, ``group``) are
read.  Runs of any length are taken whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import returning_memory, stored
from rankfold.llm.text import text_buffer

#: code points and occurrences that make a word
MIN_LENGTH, MIN_COUNT = 5, 3
#: a form occurs at least so many times as often
FORM_TIMES = 2
#: one in so many runs of a document loses a code point
SLIP = 97
#: words in one part of the composition before it is split
PART_WORDS = 20_000
#: distinct words a task counts before it passes them on
_HELD = 200_000

_RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")


def document_words(doc_id, text: str) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text whose A-Z are lower-cased; shorter words are left out."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(_RUN.findall(text)).items():
        h = zlib.crc32(word.encode(), seed)
        if h % SLIP == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < MIN_LENGTH:
                continue
        yield word, n


def _counted(batches):
    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts: dict[str, int] = {}
    for batch in batches:
        raw, off = text_buffer(batch.column("text"))
        for i, a, b in zip(batch.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
            # bytes.lower is ASCII only
            for word, n in document_words(i, raw[a:b].tobytes().lower().decode()):
                counts[word] = counts.get(word, 0) + n
            if len(counts) > _HELD:
                yield rows(counts)
                counts = {}
    yield rows(counts)


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts with at least ``min_count`` occurrences."""
    counted = docs.select("doc_id", "text").mapInArrow(returning_memory(_counted), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --------------------------------------------------------- finite-state machines

class Acceptor:
    """The minimised acceptor of sorted distinct words (state 0 is initial)."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        #: whether a state accepts more than one ending
        self.many = [False]
        alike: dict[tuple, int] = {}
        path, before = [0], ""
        for word in [*words, ""]:
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            # what lies beyond the common beginning gets no more arcs: one state for alike ones
            for depth in range(len(before), same, -1):
                s = path.pop()
                arcs = self.arcs[s]
                self.many[s] = len(arcs) + self.final[s] > 1 or any(self.many[t] for t in arcs.values())
                self.arcs[path[-1]][before[depth - 1]] = alike.setdefault((self.final[s], *arcs.items()), s)
            for c in word[same:]:
                self.arcs[path[-1]][c] = len(self.arcs)
                path.append(len(self.arcs))
                self.arcs.append({})
                self.final.append(False)
                self.many.append(False)
            if word:
                self.final[path[-1]] = True
                before = word
        self.many[0] = len(words) > 1


def endings(left: Acceptor, p: int, right: Acceptor, q: int, barred: str = "") -> Iterator[str]:
    """What both accept from states p and q, but for what begins with ``barred``."""
    path: list[str] = []
    stack = [(p, q, 0, "")]
    while stack:
        p, q, depth, c = stack.pop()
        if depth:
            del path[depth - 1:]
            path.append(c)
        if left.final[p] and right.final[q]:
            yield "".join(path)
        other = right.arcs[q]
        for c, to in left.arcs[p].items():
            if c in other and (depth or c != barred):
                stack.append((to, other[c], depth + 1, c))


def _prefixes(left: Acceptor, right: Acceptor, go) -> Iterator[tuple[list[str], int, int]]:
    """Common beginnings with the states that they lead to, where ``go`` holds; the
    list of code points changes from one to the next."""
    path: list[str] = []
    stack = [(0, 0, 0, "")]
    while stack:
        p, q, depth, c = stack.pop()
        if depth:
            del path[depth - 1:]
            path.append(c)
        yield path, p, q
        other = right.arcs[q]
        for c, to in left.arcs[p].items():
            if c in other and go(to, other[c]):
                stack.append((to, other[c], depth + 1, c))


def replaced(machine: Acceptor) -> Iterator[tuple[str, str]]:
    """Pairs of accepted words of equal length with one code point replaced."""
    for begin, s, _ in _prefixes(machine, machine, lambda p, q: machine.many[p]):
        out = list(machine.arcs[s].items())
        for i, (c, p) in enumerate(out):
            for d, q in out[i + 1:]:
                for end in endings(machine, p, machine, q):
                    same = "".join(begin)
                    yield f"{same}{c}{end}", f"{same}{d}{end}"


def inserted(short: Acceptor, long: Acceptor, at_end: bool) -> Iterator[tuple[str, str]]:
    """Pairs of a word and the same with one code point more.  The edit stands at the
    first difference, at the word's end only where ``at_end``."""
    for begin, p, q in _prefixes(short, long, lambda p, q: True):
        for d, to in long.arcs[q].items():
            for end in endings(short, p, long, to, barred=d):
                if end or at_end:
                    same = "".join(begin)
                    yield same + end, f"{same}{d}{end}"


# ------------------------------------------------------------- parts and pairs

def part_pairs(words: list[tuple[str, int]], lo: int, hi: int, size: int) -> Iterator[tuple[str, str]]:
    """Near pairs of a part: words of ``size`` code points (0) or one more (1) that
    agree outside of the stretch [lo, hi) of the shorter ones, edited there."""
    if len(words) < 2 or all(longer for _, longer in words):
        return
    some = words[0]
    left, right = some[0][:lo], some[0][hi + some[1]:]
    short = Acceptor(sorted({w[lo:hi] for w, longer in words if not longer}))
    for a, b in replaced(short):
        yield f"{left}{a}{right}", f"{left}{b}{right}"
    if any(longer for _, longer in words):
        long = Acceptor(sorted({w[lo:hi + 1] for w, longer in words if longer}))
        for a, b in inserted(short, long, hi == size):
            yield f"{left}{a}{right}", f"{left}{b}{right}"


_PART = "part bigint, word string, n bigint, lo int, hi int, longer int"


def _pairs(batches):
    """Near pairs, either way, of the parts in batches sorted by part; a part is held whole."""

    def solved(rows: list[dict]):
        parts: dict[tuple, list[dict]] = {}
        for r in rows:  # parts whose hashes meet come apart here
            w, lo, hi = r["word"], r["lo"], r["hi"]
            parts.setdefault((len(w) - r["longer"], lo, w[:lo], w[hi + r["longer"]:]), []).append(r)
        for (size, lo, _, _), members in parts.items():
            count = {r["word"]: r["n"] for r in members}
            for a, b in part_pairs([(r["word"], r["longer"]) for r in members], lo, members[0]["hi"], size):
                yield a, b, count[b]
                yield b, a, count[a]

    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        part = batch.column("part").to_numpy()
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        held = batch.slice(first[-1])
        ends = np.append(first[1:], len(part))[:-1]
        yield from _pair_rows(batch, first[:-1], ends, solved)
    if held is not None:
        yield from _pair_rows(held, np.array([0]), np.array([held.num_rows]), solved)


def _pair_rows(batch, first, ends, solved, block: int = 50_000):
    out = []
    for a, b in zip(first.tolist(), ends.tolist()):
        if b - a > 1:
            out += solved(batch.slice(a, b - a).to_pylist())
        if len(out) > block:
            yield _pair_batch(out)
            out = []
    yield _pair_batch(out)


def _pair_batch(out):
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())],
        names=["word", "near", "near_n"])


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with their part: what of a word lies outside of its stretch, and where."""
    size = F.char_length("word") - F.col("longer")
    left = F.expr("substring(word, 1, lo)")
    right = F.expr("substring(word, hi + longer + 1)")
    return rows.withColumn("part", F.xxhash64(size, "lo", left, right)).select("part", "word", "n", "lo", "hi", "longer")


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with its stretch's first and its second half."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    stretch = F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi"))))
    return _dealt(rows.select("word", "n", "longer", stretch.alias("s")).select("word", "n", "longer", "s.lo", "s.hi"))


def near_pairs(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, near, near_n): every ordered pair of distinct words one edit apart, from
    (word, n) with distinct words."""
    words = words.select("word", "n")
    roles = F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")
    whole = words.select("word", "n", roles).withColumns({"lo": F.lit(0), "hi": F.char_length("word") - F.col("longer")}).where("hi > 0")
    parts = stored(_halves(whole), "spelling-parts")
    ready = []
    while True:
        sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("words"), F.max(F.col("hi") - F.col("lo")).alias("width"))
        large = sizes.where((F.col("words") > part_words) & (F.col("width") > 1)).select("part")
        if large.isEmpty():
            break
        large = stored(large, "spelling-large")
        ready.append(parts.join(large, "part", "left_anti"))
        again = parts.join(large, "part", "left_semi")
        # meeting hashes may bring a stretch of one code point along
        ready.append(again.where("hi - lo = 1"))
        parts = stored(_halves(again.where("hi - lo > 1")), "spelling-parts")
    for r in ready:
        parts = parts.unionByName(r)
    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(returning_memory(_pairs), "word string, near string, near_n bigint")


def group(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """Per word of (word, n): form, root, n, n_near, form_n (see the module)."""
    words = stored(words.select("word", "n"), "spelling-words")
    near = near_pairs(words, part_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    is_form = -F.col("best.m") >= FORM_TIMES * F.col("n")
    forms = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")), "spelling-forms")
    # (word, root so far) of words with a form; each round doubles the steps taken
    roots = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if roots.join(step, "root", "left_semi").isEmpty():
            break
        roots = stored(roots.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    return group(vocabulary(docs))
