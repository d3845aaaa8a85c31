"""Phrase collocations against direct counting."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rankfold.llm import phrases
from rankfold.llm.text import text_chunks


def counted(texts):
    f, total = collections.Counter(), collections.Counter()
    for t, lang in texts:
        t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    f[lang or "und", tuple(w[i:i + n])] += 1
    return f, total


def brute(texts, least, top=2000):
    f, total = counted(texts)
    whole = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    inside = set()
    for (lang, p), a in whole.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                if 100 * a >= 100 * f[lang, p[i:i + n]]:
                    inside.add((lang, p[i:i + n]))
    out = collections.defaultdict(list)
    for (lang, p), a in whole.items():
        if (lang, p) in inside:
            continue
        cut = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-cut[0], -a, " ".join(p).encode(), f[lang, p[:cut[1]]], f[lang, p[cut[1]:]]))
    rows = set()
    for lang, found in out.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            rows.add((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return rows


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "of", "tea", "a-b", "É", "x y", "new", "york", "CITY", " "]
    glue = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r", "\x0b", "! ", "?"]
    texts = [("".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None])) for _ in range(n)]
    return texts + [(None, "en"), ("", None), ("  .. ", "fr"), ("New york city " * 3000, "en")] + [texts[0]] * 5


def frame(spark, texts, parts=3):
    rows = [(i, t, lang, 1, "p", 2) for i, (t, lang) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n int, phrase string, size int").repartition(parts)


@pytest.mark.parametrize("least, top", [(2, 2000), (10, 7)])
def test_against_direct_counting(spark, least, top):
    texts = made(least)
    df = phrases.report(frame(spark, texts), least, top)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in df.dtypes} == {"string", "bigint"}
    rows = [tuple(r) for r in df.collect()]
    want = brute(texts, least, top)
    assert len(rows) == len(set(rows)) == len(want) > 5 and set(rows) == want


def test_counts_and_places(spark):
    texts = made(3)
    f, total = counted(texts)
    rows = phrases.count_phrases(frame(spark, texts), 4).collect()
    assert {(r.lang, tuple(r.phrase.split(" "))): r.n for r in rows if r.phrase is not None} == {k: a for k, a in f.items() if a >= 4}
    assert {r.lang: r.n for r in rows if r.phrase is None and r.n} == dict(+total)
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    words = [re.findall("[^\x20\x09\x0a-\x0d.,;:!?]+", lower(t)) for t, _ in texts]
    for r in rows:
        if r.phrase is not None:
            assert words[r.doc_id][r.word:r.word + r.size] == r.phrase.split(" ") and (texts[r.doc_id][1] or "und") == r.lang
            assert texts.index(texts[r.doc_id]) == r.doc_id  # of equal texts the first


def runs_of(texts, kind=phrases.Runs):
    _, _, data, off = next(text_chunks(pa.array(texts, pa.string())))
    return kind(data, off, np.zeros(len(texts), np.uint64), phrases._powers())


def test_colliding_fingerprints_come_apart():
    """With five bits of fingerprint nearly all collide; the checks keep runs apart."""
    texts = [t for t, _ in made(5, 30) if t]

    class Few(phrases.Runs):
        def fingerprints(self, places, n):
            return super().fingerprints(places, n) & np.uint64(31)

    runs = runs_of(texts, Few)
    got, name = collections.Counter(), {}
    for n in range(1, 6):
        at = runs.places(n)
        fingerprint, check = runs.fingerprints(at, n), runs.checks(at, n)
        for p, c in zip(at.tolist(), check.tolist()):
            assert name.setdefault(c, runs.phrase(p, n)) == runs.phrase(p, n)
        rows = phrases.summed(fingerprint, check, np.arange(len(at), dtype=np.int32))
        for c, first, k in zip(rows[1].tolist(), rows[2].tolist(), rows[3].tolist()):
            got[tuple(name[c].split(" "))] += k
            assert runs.phrase(int(at[first]), n) == name[c]
    assert got == collections.Counter({k[1]: a for k, a in counted([(t, "en") for t in texts])[0].items()})


def test_a_pointer_needs_fingerprint_and_check():
    """At the pointer only the run that both name is made; other texts of that hash give none."""
    texts = ["new york city", "of tea and tea", ""]
    runs = runs_of(texts)
    at = runs.places(2)
    f, c = runs.fingerprints(at, 2).view(np.int64).tolist(), runs.checks(at, 2).tolist()
    wanted = [{"fingerprint": f[0], "check": c[0]}, {"fingerprint": f[0], "check": c[0] ^ 1}, {"fingerprint": f[3], "check": c[3]}]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t, "salt": 0, "lang": "en", "wanted": wanted} for i, t in enumerate(texts)])
    out = [r for b in phrases._maker([batch]) for r in b.to_pylist()]
    assert [(r["phrase"], r["doc_id"], r["word"], r["size"]) for r in out] == [("new york", 0, 0, 2), ("tea and", 1, 1, 2)]


def test_empty_tables(spark):
    for texts in ([], [(None, None)], [("..", "en")]):
        assert phrases.report(frame(spark, texts)).collect() == []
