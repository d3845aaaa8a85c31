"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items (words, see ``item_words``) are put into one
suffix automaton: every path from its root spells a run of consecutive words
of some item.  Training texts are streamed through it word by word.  The
state reached and the matched length are the longest run of words ending
here that occurs in an item, so every run of at least ``window`` words, and
every whole item shorter than that, is seen as its last word is read.

Only the automaton is broadcast.  It holds at most ``MAX_WORDS`` item words;
a larger benchmark is split into groups of items, and the texts are streamed
once per group with what was found so far written in between.

Defined results: a null or empty text has no words and no hits.  A null or
wordless item matches nothing.  Items of equal text are all reported.  Rows
are never merged, so repeated rows give repeated results.  Empty tables give
empty results or no hits.  Only the named columns are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import received, returning_memory, ship, stored
from rankfold.llm.text import text_buffer

#: consecutive words that make a window
WINDOW = 10
#: item words in one automaton (two states a word at most, a few hundred bytes each)
MAX_WORDS = 200_000
#: share of a document's words that may be hit before the pipeline drops it
MAX_COVERAGE = 0.5

#: ASCII letters (lower-cased before) and digits, and every non-ASCII character
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def item_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased (``bytes.lower`` is ASCII only)."""
    return _WORD.findall(text.lower())


class SuffixAutomaton:
    """Generalised suffix automaton over words, marked with the items' windows."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.next)
        #: items of the window that a state's words of that length are
        self.window_items: dict[int, set[int]] = {}
        #: (words, item) of short items that a state's words end with
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, words in items:
            if 0 < len(words) < window:
                state = 0
                for w in words:
                    state = self.next[state][w]
                self.short.setdefault(state, []).append((len(words), item))
            state = 0
            for i, w in enumerate(words if len(words) >= window else ()):
                state = self.next[state][w]
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                if i + 1 >= window:
                    self.window_items.setdefault(state, set()).add(item)
        #: per state, the ancestor holding the run of exactly ``window`` words,
        #: and the nearest state on the way to the root with short items
        self.window_state, self.short_state = [0] * n, [-1] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            self.window_state[s] = self.window_state[up] if self.length[up] >= window else s
            self.short_state[s] = s if s in self.short else self.short_state[up]

    def _state(self, length: int, link: int, following: dict[bytes, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, parent: int, word: bytes, child: int) -> int:
        """A copy of ``child`` for just the runs that come through ``parent``."""
        copy = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        child = self.next[last].get(word)
        if child is not None:  # another item begins alike
            return child if self.length[child] == self.length[last] + 1 else self._split(last, word, child)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            child = self.next[last][word]
            self.link[new] = child if self.length[child] == self.length[last] + 1 else self._split(last, word, child)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Merged hit spans (word positions, end exclusive), items found, longest match."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        short_state, window_items, window_state = self.short_state, self.window_items, self.window_state
        state = matched = longest = 0
        hits, items = [], set()
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(w)
            if to is None:
                continue
            state = to
            matched += 1
            if matched > longest:
                longest = matched
            if matched >= window:
                hits.append((i + 1 - window, i + 1))
                items |= window_items.get(window_state[state], items)
            s = short_state[state]
            while s > 0:
                for n, item in self.short[s]:
                    if n <= matched:
                        hits.append((i + 1 - n, i + 1))
                        items.add(item)
                s = short_state[link[s]]
        return merge(hits), items, longest


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans as sorted disjoint spans; touching ones become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "n_words bigint, longest bigint, hits array<struct<a:bigint,b:bigint>>, items array<bigint>"
_ARROW_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _scanner(broadcast, keep: list[str], text: str):
    """Streams the batches' texts through the automaton; earlier hits are added to."""

    def run(batches):
        automaton = received(broadcast)
        for batch in batches:
            raw, off = text_buffer(batch.column(text))
            buf, off = raw.tobytes(), off.tolist()
            before = (batch.column("hits").to_pylist(), batch.column("items").to_pylist(), batch.column("longest").to_pylist()) if "hits" in batch.schema.names else None
            n_words, longest, hits, items = [], [], [], []
            for r in range(batch.num_rows):
                words = item_words(buf[off[r]:off[r + 1]])
                h, it, top = automaton.scan(words)
                if before:
                    h = merge(h + [(x["a"], x["b"]) for x in before[0][r]])
                    it, top = it | set(before[1][r]), max(top, before[2][r])
                n_words.append(len(words))
                longest.append(top)
                hits.append([{"a": a, "b": b} for a, b in h])
                items.append(sorted(it))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(n_words, pa.int64()), pa.array(longest, pa.int64()),
                 pa.array(hits, _ARROW_SPANS), pa.array(items, pa.list_(pa.int64()))],
                names=[*keep, "n_words", "longest", "hits", "items"])

    return run


def _after(first, second):
    """Both functions over batches in one worker."""

    def run(batches):
        yield from second(first(batches))

    return run


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id", "text"),
                  text: str = "text", max_words: int = MAX_WORDS, then=None) -> DataFrame:
    """The kept columns and, per row: ``n_words``, the ``longest`` match in words,
    ``hits`` (disjoint spans of word positions) and the ``items`` found.  ``then``, a
    function over these batches and its fields, goes on with them in the same task."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    # a word takes two characters with its separator, so this is no fewer than the words
    size = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    groups = max(1, -int(-size // max_words))
    keep = list(dict.fromkeys([*keep, text]))
    out = docs.select(*keep)
    fields = ", ".join(f"`{c}` {t}" for c, t in out.dtypes)
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        automaton = SuffixAutomaton([(r["item_id"], item_words(r["text"].encode())) for r in rows], window)
        scan = _scanner(ship(spark, automaton), keep, text)
        if g + 1 < groups:
            out = stored(out.mapInArrow(returning_memory(scan), f"{fields}, {_FOUND}"), "decontaminate")
        elif then is None:
            out = out.mapInArrow(returning_memory(scan), f"{fields}, {_FOUND}")
        else:
            out = out.mapInArrow(returning_memory(_after(scan, then[0])), then[1])
    return out


def overlap_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per document: hit words, items found and a digest of their ids."""
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return find_overlaps(docs, benchmark, window, max_words=max_words).select(
        "doc_id", "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "longest")


def _cutter(names: list[str], max_coverage: float):
    """Removes hit spans from the texts; rows covered beyond the limit go."""

    def run(batches):
        for batch in batches:
            texts, hits = batch.column("text").to_pylist(), batch.column("hits").to_pylist()
            n_words = batch.column("n_words").to_pylist()
            keep, out = [], []
            for r, (t, h) in enumerate(zip(texts, hits)):
                if not h:
                    keep.append(r)
                    out.append(t)
                    continue
                if sum(x["b"] - x["a"] for x in h) > max_coverage * n_words[r]:
                    continue
                raw = t.encode()
                at = [m.span() for m in _WORD.finditer(raw.lower())]
                pieces, last = [], 0
                for x in h:
                    pieces.append(raw[last:at[x["a"]][0]])
                    last = at[x["b"] - 1][1]
                pieces.append(raw[last:])
                keep.append(r)
                out.append(b"".join(pieces).decode())
            rows = batch.select(names).take(pa.array(keep, pa.int64()))
            cols = {c: rows.column(c) for c in names}
            cols["text"] = pa.array(out, pa.string())
            cols["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The documents without their hit spans; those with more than ``max_coverage``
    of their words hit are removed.  ``n_chars`` follows the new text."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    fields = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return find_overlaps(docs, benchmark, window, keep=tuple(names), then=(_cutter(names, max_coverage), fields))


ORACLE = r"""
WITH norm AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM norm, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, i, n FROM grams JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT norm.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM norm LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
