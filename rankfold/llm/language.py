"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one slot per hash position and one bit per
language in each slot: ``k`` probes of an n-gram, combined with AND, return
the set of all languages that contain it at once.  A text's n-grams give a
popcount per language; the expected share of false positives (the language's
share of set bits to the power ``k``) is taken out, and the largest corrected
count decides.

n-grams are four consecutive bytes of the text with A-Z lower-cased, every
run of ASCII non-letters as one space and two spaces at either end.  A
language contains an n-gram that makes up at least ``MIN_SHARE`` of its
training n-grams.  So it has at most ``1 / MIN_SHARE`` of them, which bounds
what is collected and broadcast whatever the corpus size; the counts behind
that are taken over all training rows and summed in Spark.

Defined results: ``und`` with score 0 if the text is null or has no letter,
or nothing was learned.  If no n-gram is known, the language with the most
training n-grams is returned with score 1 / languages.  Ties go to the
alphabetically first language.  Rows are never merged; only the named columns
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import id_bucket, received, ship, stored
from rankfold.llm.text import LOWER, class_table, mix, text_buffer, text_chunks

NGRAM = 4
PROBES = 3
#: least share of a language's n-grams; its inverse bounds the n-grams of a language
MIN_SHARE = 1e-6
#: remainder classes of crc32(doc_id) that make the held-out part
FOLDS, HELD_OUT = 5, 0
#: distinct (language, n-gram) counts that a task holds before passing them on
FLUSH = 1 << 20

LETTER = class_table([(65, 90), (97, 122)], True)
ASCII_LETTER = class_table([(65, 90), (97, 122)], False)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes (the four bytes) of the texts in a buffer, and their rows."""
    n = len(offsets) - 1
    letter = LETTER[data]
    norm = np.where(letter, LOWER[data], 32).astype(np.uint8)
    keep = np.ones(len(data), bool)
    keep[1:] = letter[1:] | letter[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    keep[starts] = letter[starts]
    total = np.concatenate([[0], np.cumsum(keep)])
    row_off = total[offsets] + 4 * np.arange(n + 1)
    out = np.full(row_off[-1], 32, np.uint8)
    length = np.diff(total[offsets])
    out[np.arange(total[-1]) + np.repeat(4 * np.arange(n) + 2, length)] = norm[keep]
    if len(out) < NGRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    v = out.astype(np.uint32)
    code = v[:-3] << np.uint32(24) | v[1:-2] << np.uint32(16) | v[2:-1] << np.uint32(8) | v[3:]
    row = np.repeat(np.arange(n), np.diff(row_off))[:len(code)]
    inside = np.arange(len(code)) + NGRAM <= row_off[row + 1]
    # rows without a letter hold four spaces and nothing else
    inside &= (length > 0)[row]
    return code[inside], row[inside]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def _counter(batches):
    """(lang, gram, n) counts of a task's texts, in bounded portions."""
    held: dict[str, list] = {}

    def flush():
        for lang, parts in held.items():
            codes, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(codes), np.int32))), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for i, j, data, off in text_chunks(batch.column("text")):
            code, row = grams(data, off)
            ids = {x: k for k, x in enumerate(dict.fromkeys(langs[i:j]))}
            of_row = np.array([ids[x] for x in langs[i:j]], np.int64)[row]
            for lang, k in ids.items():
                part = np.unique(code[of_row == k], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append(part)
                if sum(len(p[0]) for p in parts) > FLUSH:
                    held[lang] = [_merged(parts)]
            if sum(len(p[0]) for parts in held.values() for p in parts) > 2 * FLUSH:
                yield from flush()
    yield from flush()


class Filter:
    """Bit-sliced Bloom filter: a mask of 64 languages per slot and layer."""

    def __init__(self, langs: list[str], grams_of: dict[str, np.ndarray], totals: dict[str, int]):
        self.langs = langs
        self.likeliest = max(range(len(langs)), key=lambda i: (totals[langs[i]], -i)) if langs else -1
        most = max([1, *(len(g) for g in grams_of.values())])
        self.slots = 1 << int(np.ceil(np.log2(4 * PROBES * most)))
        self.layers = [np.zeros(self.slots, np.uint64) for _ in range(0, len(langs), 64)]
        for i, lang in enumerate(langs):
            for at in self.positions(grams_of.get(lang, np.zeros(0, np.uint32))):
                self.layers[i // 64][at] |= np.uint64(1 << i % 64)
        fill = [float(np.count_nonzero(self.layers[i // 64] >> np.uint64(i % 64) & np.uint64(1))) / self.slots for i in range(len(langs))]
        self.false = np.array(fill) ** PROBES

    def positions(self, code: np.ndarray):
        h = mix(code.astype(np.uint64) + np.uint64(1))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield ((h + np.uint64(i) * step) & np.uint64(self.slots - 1)).astype(np.int64)

    def counts(self, code: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams per row, and per row and language those that the filter holds."""
        total = np.bincount(row, minlength=n)
        hits = np.zeros((n, len(self.langs)))
        at = list(self.positions(code))
        for k, layer in enumerate(self.layers):
            mask = layer[at[0]]
            for p in at[1:]:
                mask &= layer[p]
            for i in range(64 * k, min(64 * k + 64, len(self.langs))):
                hits[:, i] = np.bincount(row[(mask & np.uint64(1 << i % 64)) != 0], minlength=n)
        return total, hits

    def decide(self, total: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score per row."""
        true = np.maximum(0, (hits - total[:, None] * self.false) / np.maximum(1e-9, 1 - self.false))
        best, mass = true.argmax(1), true.sum(1)
        score = np.divide(true.max(1), mass, out=np.full(len(best), 1 / len(self.langs)), where=mass > 0)
        return np.where(mass > 0, best, self.likeliest), score


def fit(train: DataFrame, min_share: float = MIN_SHARE) -> Filter:
    """Filter from rows of (text, lang); null texts and languages are left out."""
    rows = train.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.mapInArrow(_counter, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts, "language-counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    least = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min_share * totals[lang])]) if langs else F.create_map()
    found: dict[str, np.ndarray] = {}
    for lang in langs:  # at most 1 / min_share rows each
        t = counts.where((F.col("lang") == lang) & (F.col("n") >= least[F.col("lang")])).select("gram").toArrow()
        found[lang] = t.column("gram").to_numpy().astype(np.uint32)
    return Filter(langs, found, totals)


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows with a letter; texts without ASCII letters are looked at by character."""
    seen = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
    out = seen[off[1:]] > seen[off[:-1]]
    for r in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[r] = any(c.isalpha() for c in data[off[r]:off[r + 1]].tobytes().decode())
    return out


def _predictor(broadcast, keep: list[str]):
    def run(batches):
        model = received(broadcast)
        names = pa.array([*model.langs, "und"])
        for batch in batches:
            label, score = [], []
            for i, j, data, off in text_chunks(batch.column("text")):
                known = has_letter(data, off) & bool(model.langs)
                if model.langs:
                    best, s = model.decide(*model.counts(*grams(data, off), j - i))
                else:
                    best, s = np.zeros(j - i, np.int64), np.zeros(j - i)
                label.append(np.where(known, best, len(model.langs)))
                score.append(np.where(known, s, 0.0))
            label = np.concatenate(label) if label else np.zeros(0, np.int64)
            score = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), names.take(pa.array(label)), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Filter, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ``lang_pred`` and ``score``."""
    rows = docs.select(*keep, "text")
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return rows.mapInArrow(_predictor(ship(docs.sparkSession, model), list(keep)), f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows outside the held-out fold, predict all rows."""
    split = docs.select("doc_id", "text", "lang", (id_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    model = fit(split.where(~F.col("held_out")))
    return predict(split, model, ("doc_id", "held_out"))
