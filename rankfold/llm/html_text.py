"""Main text of web pages by tag-path ratios.

A page is read once into blocks: the text between borders of block elements,
each with its tag path from the root.  Per path, text length and punctuation
are added up over its blocks and divided by their number, so short paragraphs
share the weight of the long ones beside them.  Both ratios are put on the
page's blocks in order, smoothed with a Gaussian, fused into one value, and
paths whose fused value reaches the threshold are content.  Where most
content lies below ``article`` or ``main`` elements, only blocks in there are
kept, with the headings there, and its paths need just a part of the threshold.

Elsewhere the lists and quotes in the element that holds the content count as
content from the same part of the threshold.

Left out beforehand are elements that never hold article text (scripts,
styles, menus, asides, page headers and footers, hidden parts).  Forms and
elements whose class, id or role names such a part (``CLUTTER``) go too, unless
next to nothing would be left: then the one with most text wraps the page and
does not count as such.

Defined results: a null, empty or textless page gives the empty text.  Broken
markup never fails: unclosed elements end with their parents, unmatched end
tags are skipped, an unclosed comment or script runs to the end.  Rows are
never merged; only the named columns are read.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody
td tfoot th thead title tr ul""".split())
SKIPPED = frozenset("""aside audio button canvas datalist dialog embed fieldset footer head iframe input label legend map math menu nav
noframes noscript object optgroup option select svg template textarea title video""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main".split())
# Words of class, id and role values that mark other parts of a page.
CLUTTER = frozenset("""ad ads adv advert advertisement advertising adverts adsense banner breadcrumb breadcrumbs byline comment comments commentlist
complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus feedback footer form gdpr header login masthead
menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promos
promoted promotion reactions recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored
sponsors subscribe subscription tagcloud taboola teaser toc toolbar tooltip topbar widget widgets""".split())
#: elements whose start closes an open paragraph
CLOSES_P = BLOCK - frozenset("body caption html head title tbody td tfoot th thead tr option optgroup legend summary".split())
#: element -> what it closes when opened directly inside
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: elements that such implied ends do not cross
BARRIERS = frozenset("ul ol dl table div section article body main aside nav".split())

#: share of the standard deviation that a content path's fused value reaches
THRESHOLD = 0.8
#: Gaussian weights over neighbouring blocks
SMOOTH = (0.25, 0.5, 0.25)
#: most that smoothing multiplies a block's own value by
LIFT = 2
#: share of the content that makes an article or main element the container
CONTAINER_SHARE = 0.5
#: a block with more of its text in links is a menu
LINK_SHARE = 0.75
#: share of the limit that paths inside the container, or beside the content, reach
INNER = 0.1
#: share of the content in the element that its lists and quotes are taken from
HOME_SHARE = 0.8
BESIDE = frozenset("blockquote dl figcaption ol pre ul".split())
#: share of the text outside of clutter below which the clutter wraps the page
LEFT = 0.1

# A tag ends at its ">".  Quoted values may hold "<" or ">", not both; an unclosed tag
# reaches no further than the next "<", so reading stays linear in the page.
_ATTR = r"""(?:(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>|(?:[^<>"']++|"[^">]*+"|'[^'>]*+')*+>|[^<>]*+>)"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|xmp)\b{_ATTR}.*?(?:</\1\b[^<>]*+>?|\Z)|<[!?][^<>]*+>?|<(/?)([a-z][^\s/<>]*+)({_ATTR})",
    re.DOTALL | re.IGNORECASE)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?。、，；：！？…¿¡]")
_BLANK = re.compile(r"\s+")


def names_clutter(attributes: str) -> str:
    """First word of class, id or role that names a non-article part, or ''."""
    for m in _NAMED.finditer(attributes):
        for w in _WORDS.findall(m[2] or m[3] or m[4] or ""):
            if w.lower() in CLUTTER:
                return w.lower()
    return ""


class Block:
    __slots__ = ("path", "element", "container", "heading", "parts", "linked", "text")

    def __init__(self, path, element, container, heading):
        self.path, self.element, self.container, self.heading = path, element, container, heading
        self.parts, self.linked, self.text = [], 0, ""


class Tree:
    """Elements of a page (0: the page) with their parents, and their tag paths: each
    path is a number, known by its parent's and the last name."""

    def __init__(self):
        self.parent, self.name, self.path, self.doubtful = [0], [""], [0], [False]
        self._paths: dict[tuple[int, str], int] = {}

    def open(self, parent: int, name: str, label: str, doubtful: bool) -> int:
        self.parent.append(parent)
        self.name.append(name)
        self.path.append(self._paths.setdefault((self.path[parent], label), len(self._paths) + 1))
        self.doubtful.append(doubtful)
        return len(self.parent) - 1


def blocks(page: str) -> tuple[list[Block], Tree]:
    """Text blocks outside the skipped parts, in page order, with their tag paths, and
    the elements that they lie in."""
    tree = Tree()
    stack: list[tuple[str, bool, int, int]] = []  # name, skipped, container, element
    opened: dict[str, int] = {}
    out: list[Block] = []
    current: Block | None = None
    containers, last, fresh, headings = 0, 0, True, 0

    def add(text: str):
        nonlocal current, fresh
        if not text or stack and stack[-1][1]:
            return
        text = html.unescape(text) if "&" in text else text
        if current is None or fresh:
            if text.isspace():
                return
            element = stack[-1][3] if stack else 0
            current = Block(tree.path[element], element, stack[-1][2] if stack else 0, headings > 0)
            out.append(current)
            fresh = False
        current.parts.append(text)
        if opened.get("a"):
            current.linked += len(text.strip())

    def close(k: int):
        nonlocal fresh, headings
        for name, *_ in stack[k:]:
            opened[name] -= 1
            headings -= name in HEADINGS
            fresh = fresh or name in BLOCK
        del stack[k:]

    for m in _TOKEN.finditer(page):
        add(page[last:m.start()])
        last = m.end()
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            if opened.get(name):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            elif name in BLOCK:
                fresh = True
            continue
        if name == "br":
            if current is not None and not fresh:
                current.parts.append(" ")
            continue
        ends = (*SIBLINGS.get(name, ()), *(("p",) if name in CLOSES_P else ()))
        if any(opened.get(e) for e in ends):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in BARRIERS:
                    break
        if name in BLOCK:
            fresh = True
        if name in VOID:
            continue
        attributes = m[4]
        above = stack[-1] if stack else ("", False, 0, 0)
        clutter = names_clutter(attributes) if "=" in attributes else ""
        skipped = above[1] or name in SKIPPED or bool(attributes and _HIDDEN.search(attributes))
        if name == "header" and not above[2]:
            skipped = True
        doubtful = name == "form" or bool(clutter) and name not in ("html", "body", "article", "main")
        inside = above[2]
        if name in CONTAINERS and not inside:
            containers += 1
            inside = containers
        stack.append((name, skipped, inside, tree.open(above[3], name, f"{name}.{clutter}" if clutter else name, doubtful)))
        opened[name] = opened.get(name, 0) + 1
        headings += name in HEADINGS
    add(page[last:])
    kept = []
    for b in out:
        b.text = _BLANK.sub(" ", "".join(b.parts)).strip()
        if b.text:
            kept.append(b)
    return kept, tree


def outside_clutter(found: list[Block], tree: Tree) -> list[Block]:
    """Blocks that no doubtful element holds.  Where that leaves less than ``LEFT`` of
    the text, the outermost doubtful element with most of it wraps the page instead:
    what it holds counts as if it were not there, and so on inside of it."""
    wraps: set[int] = set()
    mass = [0] * len(tree.parent)
    for b in found:
        mass[b.element] += len(b.text)
    for e in range(len(mass) - 1, 0, -1):  # children come after their parents
        mass[tree.parent[e]] += mass[e]
    total = mass[0]
    while True:
        # the outermost doubtful element above each element; parents come first
        outer = [0] * len(tree.parent)
        for e in range(1, len(outer)):
            outer[e] = outer[tree.parent[e]] or (e if tree.doubtful[e] and e not in wraps else 0)
        held: dict[int, int] = {}
        for b in found:
            held[outer[b.element]] = held.get(outer[b.element], 0) + len(b.text)
        if held.get(0, 0) >= LEFT * total:
            return [b for b in found if not outer[b.element]]
        held.pop(0, None)
        most = max(held, key=lambda e: (held[e], -e))
        # with all below that hold nearly as much: they would be next
        wraps |= {e for e in range(most, len(mass)) if e == most or outer[e] == most and tree.doubtful[e] and mass[e] > (1 - LEFT) * mass[most]}


def home_of(found: list[Block], content: set[int], tree: Tree) -> int:
    """The deepest element that holds ``HOME_SHARE`` of the content's text in elements of
    its own, or 0."""
    mass = [0] * len(tree.parent)
    for b in found:
        if b.path in content:
            mass[tree.parent[b.element]] += len(b.text)
    for e in range(len(mass) - 1, 0, -1):  # children come after their parents
        mass[tree.parent[e]] += mass[e]
    return max((e for e in range(len(mass)) if mass[e] >= HOME_SHARE * mass[0]), default=0)


def smoothed(values: list[float]) -> list[float]:
    """Gaussian smoothing with the border values repeated."""
    padded = [values[0], *values, values[-1]]
    return [sum(w * padded[i + k] for k, w in enumerate(SMOOTH)) for i in range(len(values))]


def main_text(page: str | None) -> str:
    """The article's blocks joined by empty lines."""
    found, tree = blocks(page or "")
    found = outside_clutter([b for b in found if b.linked < LINK_SHARE * len(b.text)], tree)
    if not found:
        return ""
    totals: dict[int, list[float]] = {}
    for b in found:
        t = totals.setdefault(b.path, [0, 0, 0])
        t[0] += len(b.text)
        t[1] += len(_PUNCTUATION.findall(b.text))
        t[2] += 1
    length = [totals[b.path][0] / totals[b.path][2] for b in found]
    marks = [totals[b.path][1] / totals[b.path][2] for b in found]
    fuse = lambda xs, ys: [math.sqrt(x * (x + 10 * y)) for x, y in zip(xs, ys)]
    # smoothing lifts a block by its neighbours, but no further than LIFT times its own
    fused = [min(f, LIFT * own) for f, own in zip(fuse(smoothed(length), smoothed(marks)), fuse(length, marks))]
    mean = sum(fused) / len(fused)
    limit = THRESHOLD * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    value: dict[int, float] = {}
    for b, f in zip(found, fused):
        value[b.path] = max(value.get(b.path, 0.0), f)
    top = max(value.values())
    content = {p for p, v in value.items() if v >= limit or v == top}
    mass: dict[int, int] = {}
    for b in found:
        if b.path in content:
            mass[b.container] = mass.get(b.container, 0) + len(b.text)
    inside = {c: n for c, n in mass.items() if c}
    if sum(inside.values()) >= CONTAINER_SHARE * sum(mass.values()):
        # several articles on a page: those that carry a share of the text
        most = max(inside.values())
        homes = {c for c, n in inside.items() if n >= 0.5 * most}
        found = [b for b in found if b.container in homes]
        content |= {b.path for b in found if value[b.path] >= INNER * limit}
        return "\n\n".join(b.text for b in found if b.path in content or b.heading)
    # lists and quotes beside the content, in the element that holds it
    inside, beside = [False] * len(tree.parent), [False] * len(tree.parent)
    home = home_of(found, content, tree)
    for e in range(1, len(inside)):
        above = tree.parent[e]
        inside[e] = inside[above] or above == home
        beside[e] = inside[e] and (beside[above] or tree.name[e] in BESIDE)
    content |= {b.path for b in found if beside[b.element] and value[b.path] >= INNER * limit}
    return "\n\n".join(b.text for b in found if b.path in content or b.heading)


def _extractor(keep: list[str]):
    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return run


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns with the main ``text`` of ``html`` and its ``n_chars``."""
    fields = ", ".join(f"`{c}` {t}" for c, t in pages.select(*keep).dtypes) + ", text string, n_chars bigint"
    return pages.select(*keep, "html").mapInArrow(_extractor(list(keep)), fields)
