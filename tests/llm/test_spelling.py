"""Spelling variants against direct comparison."""

import collections
import random
import re
import zlib

import pytest

from rankfold.llm import spelling


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def near(words):
    """All ordered near pairs by the deletions that they share."""
    out = set()
    for u in words:
        letters = set("".join(words))
        for i in range(len(u) + 1):
            some = [u[:i] + u[i + 1:]] if i < len(u) else []
            some += [u[:i] + c + u[i + 1:] for c in letters] if i < len(u) else []
            some += [u[:i] + c + u[i:] for c in letters]
            out |= {(u, v) for v in some if v in words and v != u}
    return out


def brute(texts):
    counts = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by = collections.defaultdict(list)
    for u, v in near(words):
        by[u].append(v)
    form = {}
    for w, n in words.items():
        best = min(by[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(by[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def got(df):
    rows = df.collect()
    out = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", range(80))
def test_composition_accepts_just_the_pairs_one_edit_apart(seed):
    rng = random.Random(seed)
    size = rng.randint(1, 7)
    lo = rng.randint(0, size - 1)
    hi = rng.randint(lo + 1, size)
    left, right = "".join(rng.choices("ab", k=lo)), "".join(rng.choices("ab", k=size - hi))
    words = {(left + "".join(rng.choices("abc", k=hi - lo + x)) + right, x) for x in (0, 1) for _ in range(rng.randint(0, 25))}
    found = list(spelling.part_pairs(sorted(words), lo, hi, size))
    first = lambda u, v: next((i for i, (a, b) in enumerate(zip(u, v)) if a != b), min(len(u), len(v)))
    want = {frozenset((u, v)) for u, x in words for v, y in words
            if u < v and one_edit(u, v) and not (x and y) and (lo <= first(u, v) < hi or first(u, v) == hi == size)}
    assert len(found) == len({frozenset(p) for p in found}) and {frozenset(p) for p in found} == want


@pytest.mark.parametrize("seed", range(20))
def test_acceptor_is_minimal_and_exact(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 40))})
    m = spelling.Acceptor(words)
    assert sorted(spelling.endings(m, 0, m, 0)) == words
    alike = collections.defaultdict(set)
    seen, todo = {0}, [0]
    while todo:
        s = todo.pop()
        alike[frozenset(spelling.endings(m, s, m, s))].add(s)
        new = set(m.arcs[s].values()) - seen
        seen |= new
        todo += new
    assert all(len(s) == 1 for s in alike.values())
    assert all(m.many[s] == (len(list(spelling.endings(m, s, m, s))) > 1) for s in seen)


def test_given_documents(spark, docs_of, small_texts):
    assert got(spelling.report(docs_of(small_texts, extra=True))) == brute(small_texts)


def test_odd_texts(spark, docs_of):
    rng = random.Random(1)
    some = [" ".join("".join(rng.choices("abé", k=rng.randint(4, 7))) for _ in range(400)) for _ in range(30)]
    chain = ["chains " * 50 + "chain " * 24 + "chaix " * 12 + "chaixy " * 5 + "chbixy " * 3]
    long = ["x" * 60_000 + " " + "x" * 30_000 + "y" + "x" * 29_999] * 3
    texts = list(enumerate(some + chain + long + [None, "", "Ærø×÷ÿ ÆRØ×÷ÿ Ærø×÷ÿx Ærø×÷ÿx Ærø×÷ÿx"] + ["repeated rows", "repeated rows"]))
    texts += texts[-2:] + [(None, "nullid nullid nullid")] * 2
    docs = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in texts], "doc_id bigint, text string, n int, part string, longer int")
    want = brute([(i, t) for i, t in texts if not (t and len(t) > 50_000)])
    have = got(spelling.report(docs))
    assert {x for x in have if len(x[0]) < 100} == want
    a, b = "x" * 60_000, "x" * 30_000 + "y" + "x" * 29_999
    assert {(x[0], x[4]) for x in have if len(x[0]) > 100} == {(a, 1), (b, 1)}
    assert got(spelling.report(docs_of([]))) == set() == got(spelling.report(docs_of([None, "", "a b"])))


def test_large_parts_are_split(spark):
    rng = random.Random(2)
    words = {"pre" + "".join(rng.choices("abcd", k=rng.randint(3, 6))) + "fix": rng.randint(3, 99) for _ in range(1500)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    want = sorted(near(words))
    for limit in (5, 100, 10**6):
        rows = spelling.near_pairs(df, limit).collect()
        assert sorted((r.word, r.near) for r in rows) == want
        assert all(words[r.near] == r.near_n for r in rows)
