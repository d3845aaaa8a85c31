"""Operators whose rows do not depend on each other: language, decontamination,
pieces, page text, and the shared text helpers."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rankfold.llm import decontaminate, html_text, language, pieces, text

SMALL = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


# ------------------------------------------------------------ text helpers

def test_words_and_shingles_match_python():
    texts = ["One two THREE four five six", None, "", "é à-b  c\nd", "x", "one two three four five six", "..."]
    powers = text.Powers()
    data, off = text.text_buffer(pa.array(texts))
    start, end, row, h = text.words(data, off, text.WORD, powers)
    got = [[] for _ in texts]
    for s, e, r in zip(start, end, row):
        got[r].append(data[s:e].tobytes().decode())
    assert got == [re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "") for t in texts]
    s, r = text.shingles(h, row, len(texts), 5)
    assert list(np.bincount(r, minlength=7)) == [2, 0, 0, 1, 1, 2, 0]
    assert s[r == 0].tolist() == s[r == 5].tolist()


def test_chunks_cover_rows_once():
    off = np.array([0, 5, 5, 400, 401, 1000])
    parts = list(text.chunks(off, 100))
    assert parts[0][0] == 0 and parts[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


# ------------------------------------------------------------ decontamination

def brute_hits(words, items, window=10):
    hit, found = set(), set()
    for item, w in items:
        n = min(window, len(w))
        grams = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return hit, found


@pytest.mark.parametrize("seed", range(30))
def test_automaton_matches_brute_force(seed):
    rng = random.Random(seed)
    vocab = [b"a", b"b", b"c"][: rng.randint(1, 3)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, words(rng.choice([0, 1, 2, 3, 6, 9]))) for i in range(rng.randint(1, 5))]
    stream = words(40)
    if items[0][1]:
        stream[10:10] = items[0][1]
    window = rng.choice([2, 4, 10])
    spans, found, longest = decontaminate.SuffixAutomaton(items, window).scan(stream)
    hit, expected = brute_hits(stream, items, window)
    assert {p for a, b in spans for p in range(a, b)} == hit and found == expected
    have = lambda n: any(stream[i:i + n] == w[j:j + n] for _, w in items for i in range(len(stream) - n + 1) for j in range(len(w) - n + 1))
    assert longest == max([0, *(n for n in range(1, 10) if have(n))])


def test_overlap_report_cases(spark, docs_of):
    passage = "The quick brown fox jumps over the lazy dog again and again"
    bench = spark.createDataFrame([(7, passage), (8, "tiny item"), (9, None), (10, "..."), (11, passage)], "item_id bigint, text string")
    docs = docs_of([None, "", f"Intro. {passage.upper()}! outro", "a tiny ITEM here", "clean words only", (4, "clean words only")], extra=True)
    rows = sorted(map(tuple, decontaminate.overlap_report(docs, bench).drop("longest").collect()))
    ids = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows[0][1:] == (0, 0, 0, ids(""), False) and rows[1][1:] == (0, 0, 0, ids(""), False)
    assert rows[2][1:] == (14, 12, 2, ids("11,7"), True) and rows[3][1:] == (4, 2, 1, ids("8"), True)
    assert len(rows) == 6 and rows[4] == rows[5]
    # several automata in turn give the same rows
    split = sorted(map(tuple, decontaminate.overlap_report(docs, bench, max_words=5).drop("longest").collect()))
    assert split == rows
    assert decontaminate.overlap_report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.overlap_report(docs.limit(0), bench).count() == 0


def test_decontaminate_cuts_and_drops(spark, docs_of):
    passage = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    clean = " ".join(f"w{i}" for i in range(40))
    docs = docs_of([f"{clean}. {passage}, end", passage, None, clean], extra=True)
    rows = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert rows[0]["text"] == f"{clean}. , end" and rows[0]["n_chars"] == len(rows[0]["text"])
    assert 1 not in rows and rows[2]["text"] is None and rows[3]["text"] == clean


# ------------------------------------------------------------ language

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98


def test_language_grams_match_python():
    texts = ["Ab, c!!d", "", "...", "é", "Hello  world"]
    data, off = text.text_buffer(pa.array(texts))
    code, row = language.grams(data, off)
    for r, t in enumerate(texts):
        raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", lower(t).encode())
        norm = b"  " + raw + b"  " if raw.strip() else b""
        norm = re.sub(rb"^ {3}", b"   ", norm)
        got = [int(c).to_bytes(4, "big") for c in code[row == r]]
        if raw.strip() and not raw.startswith(b" ") and not raw.endswith(b" "):
            assert got == [norm[i:i + 4] for i in range(len(norm) - 3)]
        elif not raw.strip():
            assert got == [] or not t.strip(".")


def test_language_cases(spark, docs_of):
    model = language.fit(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("x", None)], "text string, lang string"), min_share=1e-3)
    assert model.langs == ["de", "en"]
    docs = docs_of([None, "", "123 !!", "the dog", "und die", "日本", "x" * 50_000], extra=True)
    rows = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert [rows[i]["lang_pred"] for i in range(5)] == ["und", "und", "und", "en", "de"]
    assert rows[5]["lang_pred"] == model.langs[model.likeliest] and rows[5]["score"] == 0.5
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    empty = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in language.predict(docs, empty).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_language_holds_rare_grams(spark, docs_of):
    # "qyxq" is a few of a million n-grams of one language, and in no other
    rows = [("the cat and the dog " * 10000 + "qyxq", "en")] + [("der hund und die katze " * 20000, "de")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    r = language.predict(docs_of(["qyxq"]), model).first()
    assert r["lang_pred"] == "en"


def test_filter_holds_many_languages():
    rng = np.random.default_rng(1)
    langs = [f"l{i:03d}" for i in range(70)]
    grams = {x: rng.choice(1 << 32, 200, replace=False).astype(np.uint32) for x in langs}
    f = language.Filter(langs, grams, dict.fromkeys(langs, 200))
    for i in (0, 63, 64, 69):
        total, hits = f.counts(grams[langs[i]], np.zeros(200, np.int64), 1)
        assert hits[0, i] == 200 and f.decide(total, hits)[0][0] == i


# ------------------------------------------------------------ pieces

@pytest.fixture(scope="module")
def automaton():
    return pieces.Automaton(pieces.Vocabulary.load())


def unigram_ids(v, text_):
    """Plain quadratic Viterbi over all piece spans, as a check of the automaton."""
    at = {v.pieces[i]: i for i in reversed(v.normal)}
    low = min(v.scores[i] for i in v.normal) - 10
    best, back = [0.0], [None]
    for e in range(1, len(text_) + 1):
        options = [(best[s] + v.scores[at[text_[s:e]]], -s, [at[text_[s:e]]]) for s in range(max(0, e - 16), e) if text_[s:e] in at]
        if text_[e - 1] not in at:
            options.append((best[e - 1] + low, -(e - 1), [v.byte_ids[b] for b in text_[e - 1].encode()]))
        score, s, ids = max(options, key=lambda o: (o[0], o[1]))
        best.append(score)
        back.append((-s, ids))
    out, e = [], len(text_)
    while e:
        s, ids = back[e]
        out = ids + out
        e = s
    return out


@pytest.mark.parametrize("t", ["hello world", "a  b", "naïve café 日本語 \n\t x", "ünïcödé", "aaaaaaa", " lead", "trail ", "12.5%"])
def test_pieces_match_brute_force(automaton, t):
    v = pieces.Vocabulary.load()
    whole = pieces.SPACE + t.replace(" ", pieces.SPACE)
    got = pieces.Encoder(automaton).encode(t).tolist()
    score = lambda ids: sum(v.scores[i] if i not in v.special else 0 for i in ids)
    assert got == automaton.segment(whole)
    assert score(got) == score(unigram_ids(v, whole))


def test_no_library_segmentation_scores_higher(automaton):
    """The library with the same pieces and scores, run as a unigram model: its
    segmentations of these texts never beat the automaton's."""
    import sentencepiece

    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2", exc_type=ImportError)
    with open(pieces.MODEL, "rb") as f:
        m = pb.ModelProto.FromString(f.read())
    v = pieces.Vocabulary.load()
    for kind in (1, 2):  # unigram, merges
        m.trainer_spec.model_type = kind
        sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
        for t in ["hello world", "the quick brown fox", "zwölf Boxkämpfer", "a b"]:
            ours, theirs = pieces.Encoder(automaton).encode(t).tolist(), sp.encode(t)
            assert automaton.decode(ours) == automaton.decode(theirs) == t
            assert sum(v.scores[i] for i in ours) >= sum(v.scores[i] for i in theirs)


def test_pieces_round_trip(spark, docs_of, small_texts):
    odd = [None, "", " ", "  two  ", f"literal {pieces.SPACE} mark{pieces.SPACE}", "tab\tnew\nline\r\n", "\u0000￿😀", "word " * 20_000, "x" * 30_000]
    docs = docs_of(odd + [t for _, t in small_texts[:60]], extra=True)
    rows = pieces.encode(docs, check=True)
    assert rows.where("not exact").count() == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decode(rows).collect()}
    for i, t in enumerate(odd):
        assert back[i] == (t or "")
    assert pieces.encode(docs.limit(0)).count() == 0


def test_memo_is_bounded(automaton, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_PARTS", 3)
    e = pieces.Encoder(automaton)
    t = "one two three four five six seven"
    assert automaton.decode(e.encode(t).tolist()) == t and len(e.memo) <= 3


# ------------------------------------------------------------ page text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<div class="cookie-notice">We use cookies, accept them.</div><header><h2>Site name</h2></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- <p>hidden, comment.</p> -->
<div class="ad">Buy now, cheap, today.</div>
<article><h1>A &amp; B</h1><p>First paragraph,   with <b>bold</b> text &eacute; and a <a href="x">link</a>.<p>Second &lt;one&gt;, unclosed.
<div class="sidebar"><p>Related things, many of them.</p></div><ul><li>Point one.</li><li>Point two.</li></ul><p>Short.</p>
<form><input name=q>Search the site, please.</form></article>
<section id="comments"><p>Nice article, I liked it a lot, thanks for it.</p></section><aside>More, and more.</aside>
<footer>&copy; Someone, some year.</footer></body></html>"""


def test_page_main_text():
    assert html_text.main_text(PAGE).split("\n\n") == ["A & B", "First paragraph, with bold text é and a link.", "Second <one>, unclosed.", "Point one.", "Point two.", "Short."]


def test_page_without_container():
    long = "This is a sentence of the article, and it goes on for a while. " * 4
    page = f"<body><div class=top><span>Menu</span></div><div><a href=1>One</a> <a href=2>Two</a></div><div class=text><p>{long}</p><p>{long}</p><p>End.</p></div></body>"
    assert html_text.main_text(page).split("\n\n") == [long.strip(), long.strip(), "End."]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<<<>>>", "<p", "</p></p>", "<!--", "<script>x", "<a href='", "plain text only", "<p>" * 3000, "<div class='" * 300, "&#0;&#xD800;&bogus;", "<nav>all menu</nav>"])
def test_broken_pages_never_fail(page):
    assert isinstance(html_text.main_text(page), str)


SENTENCE = "A long sentence, with commas, and words enough for a paragraph of an article. "


def test_lists_and_quotes_beside_the_content_stay():
    page = f"""<body><div class=nav>Home, and more</div><div><h2>Title</h2><p>{SENTENCE * 3}</p><ul><li>Point one.<li>Point two.</ul>
<blockquote>Quoted, word for word.</blockquote><p>{SENTENCE * 2}</p></div><ul><li>Imprint</ul><div class="comments"><p>{SENTENCE * 9}</p></div></body>"""
    long = SENTENCE.strip()
    assert html_text.main_text(page).split("\n\n") == ["Title", f"{SENTENCE * 2}{long}", "Point one.", "Point two.", "Quoted, word for word.", f"{SENTENCE}{long}"]


@pytest.mark.parametrize("wrap", ["<form action=/x>", "<div class='share-holders-report'>", "<section id=public-notice-body>", "<form><div class=ad><div class=menu>", "<div class=ad>" * 3000])
def test_clutter_that_wraps_the_page_is_not_clutter(wrap):
    page = f"<body><nav>Home</nav>{wrap}<p>{SENTENCE * 3}</p><div class=sidebar><p>{SENTENCE}</p></div><p>{SENTENCE * 2}</p>"
    assert html_text.main_text(page).split("\n\n") == [(SENTENCE * 3).strip(), (SENTENCE * 2).strip()]


@pytest.mark.parametrize("bit", ["<a", "<a '", '<a "', "<script", "<script>x</script", "<!--", "<!", "<p ", "<div>x", "<b><hr></p>", "<li><b>", "<a href='x>", "</div>", "&", "<form><p>x"])
def test_long_broken_pages_are_read_in_time(bit):
    import time

    began = time.process_time()
    html_text.main_text(bit * 50_000)
    assert time.process_time() - began < 5  # a second at most; seconds more on a busy machine


@pytest.mark.parametrize("seed", range(40))
def test_path_ratios_by_the_formula(seed):
    """Pages of plain blocks in several paths, against the ratios written out."""
    import math
    import random

    rng = random.Random(seed)
    kinds = ["div/p", "div/div/p", "section/p", "table/tr/td", "div/span"]
    found = [(k, "".join(rng.choice(["word ", "more, ", "end. "]) for _ in range(rng.randint(1, 60 if k == kinds[0] else 8))).strip()) for k in rng.choices(kinds, [5, 1, 1, 1, 1], k=rng.randint(1, 25))]
    page = "".join("".join(f"<{t}>" for t in k.split("/")) + x + "".join(f"</{t}>" for t in reversed(k.split("/"))) for k, x in found)
    mean = lambda f, k: sum(f(x) for j, x in found if j == k) / sum(j == k for j, _ in found)
    length = [mean(len, k) for k, _ in found]
    marks = [mean(lambda x: x.count(",") + x.count("."), k) for k, _ in found]
    smooth = lambda v: [0.25 * v[max(0, i - 1)] + 0.5 * v[i] + 0.25 * v[min(len(v) - 1, i + 1)] for i in range(len(v))]
    fuse = lambda a, b: math.sqrt(a * (a + 10 * b))
    fused = [min(fuse(a, b), 2 * fuse(c, d)) for a, b, c, d in zip(smooth(length), smooth(marks), length, marks)]
    limit = 0.8 * math.sqrt(sum((f - sum(fused) / len(fused)) ** 2 for f in fused) / len(fused))
    best = {k: max(f for f, (j, _) in zip(fused, found) if j == k) for k, _ in found}
    content = {k for k, f in best.items() if f >= limit or f == max(best.values())}
    assert html_text.main_text(page) == "\n\n".join(x for k, x in found if k in content)


def test_page_query_on_test_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect()
    import html as h

    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        parts = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])
    assert html_text.extract(pages.limit(0)).count() == 0


def test_crc_matches_zlib(spark, docs_of):
    from rankfold.llm.common import id_bucket

    rows = docs_of([(i, "x") for i in (0, 7, 123456789, None)]).select("doc_id", id_bucket("doc_id", 5).alias("b")).collect()
    assert [r["b"] for r in rows] == [zlib.crc32(str(i).encode() if i is not None else b"") % 5 for i in (0, 7, 123456789, None)]
