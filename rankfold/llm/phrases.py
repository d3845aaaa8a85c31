"""Phrase collocations by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z) and split into pieces and words.  Prefix polynomials
over the bytes hash every word, prefix polynomials over the word hashes hash
every run of one to five words inside a piece, all in numpy: the fingerprint of
a run is a difference of two prefixes, mixed with its language.

1. Tasks count words and pairs by fingerprint and a check (a second polynomial over
   the same bytes), with a pointer: the hash of a text they stand in.  A shuffle adds
   the counts up and keeps the smallest pointer.  What reaches ``MIN_COUNT`` sets a
   bit in a filter of fixed size.
2. Runs of three to five words whose pairs all pass the filter (no others can be
   frequent) are counted the same way.
3. Frequent fingerprints go to the text that they point at.  There the words are
   hashed again, the run with the wanted fingerprint and check is found, and its text
   is made: once a frequent phrase, and of no other.

Runs whose fingerprints collide are told apart by their checks, and the text at the
pointer is taken for a fingerprint only if both agree: some 95 bits that depend on
every byte, so that two of 10^14 different runs share both with a chance of a few per
cent, and a frequent one is touched far more rarely still.  As the smallest pointer is
kept, frequent phrases share few texts: only these are read again.  The filters (2^27
bits) are all that is broadcast.  Beyond some 10^8 frequent runs one fills up: more is
counted, or read again, and the result stays.

Score of a cut: floor(1000 a n / (l r)), in decimals of 38 digits.

Defined results: a null text is empty, a null language is ``und``.  Repeated rows
count as often as they occur; ties follow the given order.  Empty tables give empty
results.  A null doc_id only shows in the pointer, as the smallest.  Only doc_id,
text and lang are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm.common import returning_memory, stored
from rankfold.llm.text import LOWER, Powers, class_table, mix, prefix_hash, span_hash, spans, text_chunks

#: longest phrase in words, occurrences of a phrase, factor of the score, phrases a language
WORDS, MIN_COUNT, SCALE, TOP = 5, 100, 1000, 2000
UNKNOWN = "und"

_BREAK = class_table([(0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?")], False)
_WORD = ~(_BREAK | class_table([(0x09, 0x09), (0x20, 0x20)], False))
_FILTER_BITS = 1 << 27
#: an odd multiplier of its own for the checks (fixed value)
_CHECK_BASE = 0xD6E8FEB86659FD93
#: runs that a task holds before it passes their counts on, and rows of a batch of these
_HELD, _ROWS = 1 << 21, 1 << 18


class Runs:
    """Words of some texts, and fingerprints and checks of their runs inside pieces."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, salt: np.ndarray, powers: tuple[Powers, Powers]):
        self.data, self.powers = LOWER[data], powers
        self.start, self.end, self.row = spans(_WORD[data], offsets)
        breaks = np.cumsum(_BREAK[data], dtype=np.int64)
        at = breaks[self.start] if len(self.start) else self.start
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (self.row[1:] != self.row[:-1])
        self.piece = np.cumsum(new)
        self.salt = salt[self.row]
        self.pairs, self.prefixes = None, []
        for p in powers:
            words = span_hash(prefix_hash(self.data, p), self.start, self.end, p)
            up, _ = p.get(len(words) + 1)
            prefix = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words * up[:len(words)], out=prefix[1:])
            self.prefixes.append(prefix)

    def places(self, n: int) -> np.ndarray:
        """First words of the runs of ``n`` words."""
        i = np.arange(max(0, len(self.piece) - n + 1))
        return i[self.piece[i] == self.piece[i + n - 1]]

    def fingerprints(self, places: np.ndarray, n: int) -> np.ndarray:
        return mix(span_hash(self.prefixes[0], places, places + n, self.powers[0]) + self.salt[places])

    def checks(self, places: np.ndarray, n: int) -> np.ndarray:
        """31 bits, so none is negative."""
        return (span_hash(self.prefixes[1], places, places + n, self.powers[1]) >> np.uint64(33)).astype(np.int32)

    def passing(self, passed, n: int) -> np.ndarray:
        """First words of the runs of ``n`` words whose pairs all pass a filter."""
        if self.pairs is None:
            self.pairs = np.zeros(len(self.piece), bool)
            i = self.places(2)
            self.pairs[i[passed(self.fingerprints(i, 2))]] = True
        i = self.places(n)
        for step in range(n - 1):
            i = i[self.pairs[i + step]]
        return i

    def phrase(self, place: int, n: int) -> str:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[place:place + n].tolist(), self.end[place:place + n].tolist())).decode()


def _powers() -> tuple[Powers, Powers]:
    return Powers(), Powers(_CHECK_BASE)


def _filter(broadcast):
    bits = np.frombuffer(broadcast.value, np.uint64)

    def passed(hashes):
        slot = hashes & np.uint64(_FILTER_BITS - 1)
        return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)

    return passed


_COUNTED = "fingerprint bigint, check int, pointer int, n int"


def _count_batch(fingerprint, check, pointer, n):
    return pa.RecordBatch.from_arrays([pa.array(fingerprint.view(np.int64)), pa.array(check), pa.array(pointer), pa.array(n.astype(np.int32))],
                                      names=["fingerprint", "check", "pointer", "n"])


def summed(fingerprint: np.ndarray, check: np.ndarray, pointer: np.ndarray):
    """Occurrences by fingerprint and check, with the smallest pointer."""
    order = np.argsort(fingerprint)
    fingerprint, check, pointer = fingerprint[order], check[order], pointer[order]
    new = np.ones(len(order), bool)
    # where checks of one fingerprint mix, it has more rows than one a check: they add up later
    new[1:] = (fingerprint[1:] != fingerprint[:-1]) | (check[1:] != check[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return fingerprint, check, pointer, np.zeros(0, np.int64)
    return fingerprint[first], check[first], np.minimum.reduceat(pointer, first), np.diff(np.append(first, len(order)))


def _counter(sizes: range, broadcast=None):
    """Counts runs of these sizes (those whose pairs pass the filter); with the first
    sizes also all words of a language, under its salt and a check of -1."""

    def run(batches):
        powers, held, many = _powers(), [], 0
        passed = _filter(broadcast) if broadcast else None
        words: dict[int, int] = {}

        def counts():
            columns = [np.concatenate(c) for c in zip(*held)]
            rows = summed(*columns)
            for a in range(0, len(rows[0]), _ROWS):
                yield _count_batch(*(c[a:a + _ROWS] for c in rows))

        for batch in batches:
            salt = batch.column("salt").to_numpy().view(np.uint64)
            pointer = batch.column("pointer").to_numpy()
            for i, j, data, off in text_chunks(batch.column("text")):
                runs = Runs(data, off, salt[i:j], powers)
                for n in sizes:
                    at = runs.passing(passed, n) if passed else runs.places(n)
                    held.append((runs.fingerprints(at, n), runs.checks(at, n), pointer[i:j][runs.row[at]]))
                    many += len(at)
                if not passed:
                    for s, n in zip(*np.unique(runs.salt, return_counts=True)):
                        words[int(s)] = words.get(int(s), 0) + int(n)
                if many > _HELD:
                    yield from counts()
                    held, many = [], 0
        if held:
            yield from counts()
        if words:
            salts, n = np.array(list(words), np.uint64), np.array(list(words.values()), np.int64)
            yield _count_batch(salts, np.full(len(n), -1, np.int32), np.zeros(len(n), np.int32), n)

    return run


def _frequent(docs: DataFrame, sizes: range, min_count: int, broadcast=None) -> DataFrame:
    """Frequent fingerprints of runs of these sizes, written once."""
    counted = docs.mapInArrow(returning_memory(_counter(sizes, broadcast)), _COUNTED)
    rows = counted.groupBy("fingerprint", "check").agg(F.sum("n").alias("n"), F.min("pointer").alias("pointer"))
    return stored(rows.where((F.col("n") >= min_count) | (F.col("check") < 0)), "phrase-fingerprints")


def _bits(hashes: DataFrame):
    """Broadcast filter of a column of hashes; 64 bits a row, at most 2^21 rows, reach the driver."""
    column = F.col(hashes.columns[0]).cast("long")
    rows = hashes.select(column.bitwiseAND(_FILTER_BITS - 1).alias("slot")).groupBy(F.expr("slot div 64").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits")).toArrow()
    out = np.zeros(_FILTER_BITS // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(out.tobytes())


def _pointed(broadcast):
    """Rows whose pointer passes the filter."""

    def run(batches):
        passed = _filter(broadcast)
        for batch in batches:
            yield batch.filter(pa.array(passed(batch.column("pointer").to_numpy().astype(np.int64).view(np.uint64))))

    return run


_MADE = "fingerprint bigint, check int, lang string, phrase string, size int, doc_id bigint, word bigint"


def _maker(batches):
    """Phrases of the wanted fingerprints, from the texts that they point at."""
    powers = _powers()
    for batch in batches:
        salt, doc_ids = batch.column("salt").to_numpy().view(np.uint64), batch.column("doc_id").to_pylist()
        lang, wanted = batch.column("lang").to_pylist(), batch.column("wanted")
        out = []
        for i, j, data, off in text_chunks(batch.column("text")):
            runs = Runs(data, off, salt[i:j], powers)
            first_word = np.searchsorted(runs.row, np.arange(j - i))
            at, size, fingerprint, check = ([] for _ in range(4))
            for n in range(1, WORDS + 1):
                p = runs.places(n)
                at.append(p)
                size.append(np.full(len(p), n))
                fingerprint.append(runs.fingerprints(p, n))
                check.append(runs.checks(p, n))
            at, size, check = np.concatenate(at), np.concatenate(size), np.concatenate(check)
            fingerprint = np.concatenate(fingerprint).view(np.int64)
            # in the order of rows, fingerprints and places; the first of each is found by search
            order = np.lexsort((at, check, fingerprint, runs.row[at]))
            at, size, check, fingerprint = at[order], size[order], check[order], fingerprint[order]
            bounds = np.searchsorted(runs.row[at], np.arange(j - i + 1))
            for r in range(j - i):
                a, b = bounds[r], bounds[r + 1]
                for w in wanted[i + r].as_py():
                    k = a + np.searchsorted(fingerprint[a:b], w["fingerprint"])
                    while k < b and fingerprint[k] == w["fingerprint"] and check[k] != w["check"]:
                        k += 1
                    # a pointer's hash may lead to other texts too
                    if k < b and fingerprint[k] == w["fingerprint"]:
                        out.append((w["fingerprint"], w["check"], lang[i + r], runs.phrase(int(at[k]), int(size[k])), int(size[k]), doc_ids[i + r], int(at[k] - first_word[r])))
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(types)],
                                         names=["fingerprint", "check", "lang", "phrase", "size", "doc_id", "word"])


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, size, n, doc_id, word): every run of one to five words with at
    least ``min_count`` occurrences, and one place where it stands (words from 0); a
    null phrase has the number of all words."""
    lang = F.coalesce("lang", F.lit(UNKNOWN))
    docs = docs.select("doc_id", "text", lang.alias("lang"), F.xxhash64(lang).alias("salt"), F.hash(F.coalesce("text", F.lit(""))).alias("pointer"))
    counting = docs.select("text", "salt", "pointer")
    short = _frequent(counting, range(1, 3), min_count)
    long = _frequent(counting, range(3, WORDS + 1), min_count, _bits(short.where("check >= 0").select("fingerprint")))
    frequent = short.unionByName(long)
    runs = frequent.where("check >= 0")
    # no more than the runs of one text
    wanted = runs.groupBy("pointer").agg(F.collect_list(F.struct("fingerprint", "check")).alias("wanted"))
    fields = "doc_id bigint, text string, salt bigint, pointer int, lang string"
    near = docs.select("doc_id", "text", "salt", "pointer", "lang").mapInArrow(returning_memory(_pointed(_bits(runs.select("pointer")))), fields)
    # of equal texts in one language, one
    texts = near.groupBy("pointer", "salt", "lang", "text").agg(F.min("doc_id").alias("doc_id"))
    # a text in two languages has rows for both; a fingerprint holds its language and fits one
    made = texts.join(wanted, "pointer").select("doc_id", "text", "salt", "lang", "wanted").mapInArrow(returning_memory(_maker), _MADE)
    phrases = runs.join(made, ["fingerprint", "check"]).select("lang", "phrase", "size", "n", "doc_id", "word")
    words = short.where("check < 0").join(docs.select("lang", F.col("salt").alias("fingerprint")).distinct(), "fingerprint")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("phrase", "string"), ("size", "int"))]
    nowhere = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "word")]
    return stored(phrases.unionByName(words.select("lang", *nothing, "n", *nowhere)), "phrases")


def collocations(counted: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` phrases a language of ``count_phrases`` by the score of their worst cut,
    without those that lie inside a longer one as often."""
    total = counted.where("phrase IS NULL AND n > 0").select("lang", F.col("n").alias("n"))
    parts = counted.where("phrase IS NOT NULL").select("lang", "phrase", "size", F.col("n").alias("a"), "doc_id", "word")
    whole = parts.where("size >= 2").withColumn("w", F.split("phrase", " "))

    def run(first, size):
        return F.array_join(F.slice("w", first, size), " ")

    # one word less at either end is enough: what lies further inside is no rarer
    # than that, so it is as frequent as the longer phrase only if both are
    inner = whole.where("size > 2").select("lang", "a", F.explode(F.array(run(1, F.col("size") - 1), run(2, F.col("size") - 1))).alias("phrase"))
    kept = whole.join(inner, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", run(1, F.col("k")).alias("first"), run(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    wide = {c: f"CAST({c} AS decimal(38, 0))" for c in "alrn"}
    score = F.expr(f"({SCALE}BD * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})")
    scored = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(total, "lang")
              .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
            .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def report(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    return collocations(count_phrases(docs, min_count), top)


ORACLE = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i
        FROM pieces, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 100),
whole AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
inside AS (
  SELECT DISTINCT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, size, m, unnest(range(1, size - m + 2)) AS i
        FROM whole, (SELECT unnest(range(2, 5)) AS m) WHERE m < size)),
kept AS (SELECT * FROM whole ANTI JOIN inside USING (lang, phrase, a)),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:size], ' ') AS q
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r, n,
         CAST((CAST(1000 AS HUGEINT) * cuts.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p JOIN f y ON y.lang = cuts.lang AND y.phrase = q
  JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""
