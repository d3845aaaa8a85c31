"""Personal data by bootstrapped contextual extraction.

Base forms (e-mail, IPv4 address, card, phone) are found in every whole text
by their fixed patterns and checks; they are the seeds.  Every occurrence of
a seed or of another identifier-like string (numbers of seven digits or more,
words with a digit or an at sign) has lexical patterns: the two words before
it, the two after it, or one on either side, each with the rough shape of the
string.  Distinct (pattern, string) pairs make a bipartite graph which Spark
scores in rounds:

* a pattern's confidence for a kind is the score of its strings of that kind
  over all its distinct strings plus one (``MIN_SUPPORT`` seeds at least);
* a string's score is the noisy-or of its accepted patterns' confidences
  (seeds keep 1; forms that failed a check are never accepted and count
  against their patterns).

Strings that are no base form and stand in an accepted pattern at the end are
added as spans of the pattern's kind.  Distinct strings count, not
occurrences, so copies of a text add no support.  The graph stays in Spark
(joins and aggregates; each round is written once); nothing is collected.

Defined results: null counts as the empty text; a text without matches has
no spans and the digest of the empty string.  Rows are never merged: repeated
rows give repeated results.  Empty tables give empty results.  Only the named
columns are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm.common import returning_memory, stored

KINDS = ("email", "ip", "card", "phone")
#: distinct seeds that a pattern needs, confidence to be accepted, rounds of scoring
MIN_SUPPORT, MIN_CONFIDENCE, ROUNDS = 3, 0.7, 3
#: characters of context looked at, and the longest string that counts as an identifier
CONTEXT, LONGEST = 48, 64

# The base forms, written so that a failing run of characters is read once
# (no start inside a run of digits, no backtracking into it).
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9])[0-9]++(?:[ ().-]{1,2}+[0-9]++)*+")
_MARK = re.compile(r"[0-9@]")
_BLANK = re.compile(r"\s")
_TOKEN = re.compile(r"[^\W\d_]+|[:=#]|\n")
_EDGE = ".,;:!?()[]{}<>|\"'`*"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """((start, kind, end) sorted, rejected spans) of a text; kinds count from 0."""
    found, rejected = [], []
    if "@" in text:
        last = 0
        for m in _AT.finditer(text):
            s = m.start()
            while s > last and _LOCAL.match(text[s - 1]):
                s -= 1
            if s < m.start():
                found.append((s, 0, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))
        found.append((m.start(), 1, m.end())) if ok else rejected.append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = digits_of(m.group()) if m.end() - m.start() < 40 else ""
            if 12 <= len(d) <= 19:
                found.append((m.start(), 2, m.end())) if luhn(d) else rejected.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            ok = 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15
            found.append((m.start(), 3, m.end())) if ok else rejected.append(m.span())
    return sorted(found), rejected


def _candidates(text: str, taken: bytearray) -> list[tuple[int, int]]:
    """Identifier-like spans that touch no marked character; they are marked too."""
    out = []

    def take(a: int, b: int) -> None:
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\x01" * (b - a)
            out.append((a, b))

    for m in _NUMBER.finditer(text):
        a, b = m.span()
        if 7 <= b - a <= LONGEST and len(digits_of(m.group())) >= 7:
            take(a, b)
    at = 0
    while m := _MARK.search(text, at):
        a = m.start()
        while a > at and not text[a - 1].isspace() and m.start() - a <= LONGEST:
            a -= 1
        end = _BLANK.search(text, m.start())
        b = at = end.start() if end else len(text)
        if b - a > LONGEST + 2 * len(_EDGE):
            continue
        while a < b and text[a] in _EDGE:
            a += 1
        while a < b and text[b - 1] in _EDGE:
            b -= 1
        if 6 <= b - a <= LONGEST:
            take(a, b)
    return out


def _shape(s: str) -> str:
    return "at" if "@" in s else "mixed" if any(c.isalpha() for c in s) else "number"


def patterns_at(text: str, a: int, b: int) -> list[str]:
    """Lexical patterns of the span [a, b): words before, after and around it."""
    shape = _shape(text[a:b])
    left = _TOKEN.findall(text[max(0, a - CONTEXT):a].lower())[-2:]
    right = _TOKEN.findall(text[b:b + CONTEXT].lower())[:2]
    out = []
    if len(left) == 2:
        out.append(f"{shape} before {left[0]} {left[1]}")
    if len(right) == 2:
        out.append(f"{shape} after {right[0]} {right[1]}")
    if left and right:
        out.append(f"{shape} around {left[-1]} {right[0]}")
    return out


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_SEEN = "array<struct<start:bigint,end:bigint,label:int,value:string,pattern:string>>"
_ARROW_SEEN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("value", pa.string()), ("pattern", pa.string())]))


def _scanner(keep: list[str]):
    """Base spans and the occurrences (string, pattern) of each text; label:
    kind + 1 for a seed, 0 for others, -1 for a form that failed its check."""

    def occurrences(text, base, rejected):
        if not _MARK.search(text):
            return
        taken = bytearray(len(text))
        for s, _, e in base:
            taken[s:e] = b"\x01" * (e - s)
        spans = [(s, e, k + 1) for s, k, e in base] + [(s, e, -1) for s, e in rejected if taken.find(1, s, e) < 0]
        for s, e in rejected:
            taken[s:e] = b"\x01" * (e - s)
        spans += [(s, e, 0) for s, e in _candidates(text, taken)]
        for s, e, label in spans:
            value = text[s:e].lower() if label in (0, 1) else digits_of(text[s:e])
            for p in patterns_at(text, s, e):
                yield {"start": s, "end": e, "label": label, "value": value, "pattern": p}

    def run(batches):
        for batch in batches:
            base, seen = [], []
            for text in batch.column("text").to_pylist():
                found, rejected = base_spans(text or "")
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                seen.append(list(occurrences(text or "", found, rejected)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(base, _ARROW_SPANS), pa.array(seen, _ARROW_SEEN)], names=[*keep, "base", "seen"])

    return run


def scan(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns, a ``row`` number, the ``base`` spans and what was ``seen``;
    written once, since three later steps read it."""
    rows = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("row", F.monotonically_increasing_id())
    names = [*keep, "row"]
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(*names).dtypes)
    return stored(rows.mapInArrow(returning_memory(_scanner(names)), f"{fields}, base {_SPANS}, seen {_SEEN}"), "pii-scan")


def learn(scanned: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Accepted patterns (pattern, kind, confidence) after scoring the graph in rounds."""
    edges = (scanned.select(F.explode("seen").alias("x")).select("x.pattern", F.xxhash64("x.value").alias("value"), "x.label")
             .groupBy("pattern", "value").agg(F.max("label").alias("top"), F.min("label").alias("low")))
    edges = stored(edges.select("pattern", "value", F.when(F.col("top") > 0, F.col("top")).otherwise(F.col("low")).alias("label")), "pii-graph")
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    # a pattern needs seeds: the others can never be accepted in the first round
    # and only count once strings found by others have reached the support
    seeds = edges.where("label > 0").select("value", F.col("label").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scores, accepted = seeds, None
    for r in range(rounds):
        mass = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        strong = mass.where(F.col("mass") >= min_support).join(size, "pattern").withColumn("confidence", F.col("mass") / (F.col("n") + 1))
        best = strong.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("b"))
        accepted = stored(best.select("pattern", "b.kind", "b.confidence").where(F.col("confidence") >= min_confidence), f"pii-patterns-{r}")
        found = (edges.where("label = 0").join(accepted, "pattern").groupBy("value", "kind")
                 .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")))
        scores = seeds.unionByName(found.where(F.col("score") >= min_confidence))
    return accepted


def added(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """(row, extra): spans that accepted patterns add, no two overlapping."""
    spots = scanned.select("row", F.explode("seen").alias("x")).select("row", "x.start", "x.end", "x.label", "x.pattern").where("label = 0")
    best = (spots.join(patterns, "pattern").groupBy("row", "start", "end")
            .agg(F.max(F.struct(F.col("confidence"), (-F.col("kind")).alias("k"))).alias("b")))
    return best.groupBy("row").agg(F.collect_list(F.struct("start", (-F.col("b.k") - 1).cast("int").alias("kind"), "end")).alias("extra"))


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``base`` spans and all ``spans``, sorted by start and kind."""
    scanned = scan(docs, keep)
    extra = added(scanned, learn(scanned))
    joined = scanned.drop("seen").join(extra, "row", "left")
    return joined.select(*keep, "base", F.sort_array(F.concat("base", F.coalesce("extra", F.array().cast(_SPANS)))).alias("spans"))


def _listed(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document the base counts, the digest of the base spans, and all spans."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return find(docs).select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
                             F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def _redactor(names: list[str]):
    marks = [f"<{k.upper()}>" for k in KINDS]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for r, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    t, out, last = texts[r], [], 0
                    for x in spans:
                        if x["start"] >= last:  # spans of two kinds may overlap: one mark
                            out += [t[last:x["start"]], marks[x["kind"]]]
                        last = max(last, x["end"])
                    texts[r] = "".join([*out, t[last:]])
            cols = {c: batch.column(c) for c in names}
            cols["text"] = pa.array(texts, pa.string())
            cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return run


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    found = find(docs, tuple(names)).drop("base")
    return found.mapInArrow(returning_memory(_redactor(names)), "doc_id bigint, text string, lang string, source string, n_chars bigint")
