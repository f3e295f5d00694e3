"""Main text of web pages by wrapper induction.

The pages of one host and layout are aligned, each with the group's reference page (the one whose id has the smallest hash), by simple
tree matching: equal root labels match, and the children are aligned in order so that the number of matched nodes is largest. The
layout of a page is the set of its block elements with their classes, so an error page or another kind of page has a wrapper of its own; names
with a digit in them, as of a page's own number, count neither there nor as labels.
Siblings are aligned one by one; equal subtrees at both ends and those that stand once on each side are paired first, so a notice among
paragraphs meets its like. Matched nodes depend on the labels below two nodes alone, so a long list costs one comparison.

Per reference node the pages that match it, those that repeat its text, how many different texts they have there, and the length of
varying text are summed over all pages of the group. Nodes whose text half of the pages repeat are template, unless the other half
differ from one another, as copies of one article beside other articles do. The content region is the lowest node that holds most of the
varying text. Extraction aligns a page again and takes what lies in the region without template nodes; only a page without a wrapper, or
one that has no such region, is read by its article elements instead, or whole.

Constant text is template, but not all varying text is content: elements that by tag, role or class are menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or reader comments never count, as on many sites they vary as the article does. A class
or id counts by whole names (``sidebar``, ``site-footer``, not ``no-sidebar``), and not if all articles of the page lie inside the element.
Inside an article element a node counts as template only if nine tenths of at least ten pages repeat it, and a page of which nothing else
is left keeps it.

Skew: every page is aligned by itself; sums per group are combined before the shuffle. Pages join with one reference and one wrapper for
each group, which Spark broadcasts if their files are small and else splits by its skew handling; html isn't shuffled by host otherwise.
Defined cases: null or empty html and pages without text give the empty text; a null url has no host and the page is read by its elements
alone; elements of any depth and number count; repeated rows give repeated results; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .staging import staged

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)([^>]*+)(?:>|\Z)|</?\Z",
    re.S,
)
ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACES = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+|[^a-z\s]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template noframes xmp object audio video canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Elements, roles and words of class or id that mark what is not the article, and words that may stand beside these.
BAD_TAGS = frozenset("nav footer aside form button select head menu dialog input fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices menu nav navbar navigation sidebar comment comments respond reply replies disqus "
    "related share sharing social footer header masthead breadcrumb breadcrumbs newsletter subscribe signup login popup modal overlay pagination pager widget toolbar skip".split()
)
BESIDE_WORDS = frozenset("site top bottom left right box bar list area wrapper container block links inner item items global secondary".split())
ARTICLE = frozenset(("article", "main"))
#: Java regex of the elements that make a page's layout.
LAYOUT = r"(?i)<(?:body|div|section|nav|header|footer|aside|main|article|form|table)\b(?:[^>]*?\s(?:class|id)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?"
#: A name of class or id with a digit, such as a page's own number, which says nothing of its layout; in Java's and Python's form.
NUMBERED, DIGIT = r"[^\s\"'=<>]*[0-9][^\s\"'=<>]*|\s+", re.compile("[0-9]")
#: Bits in which different texts of a node are counted.
BITS = 256
#: Cells of a matching table kept at once.
CELLS = 1_000_000


class Node:
    """An element. bad: 2 by its tag or role, 1 by its class or id; parse() hands it down to what lies inside."""

    __slots__ = ("tag", "label", "kids", "bad", "inside", "mark", "up")

    def __init__(self, tag: str, label: str, bad: int, up: Node | None):
        self.tag, self.label, self.bad, self.up = tag, label, bad, up
        self.kids: list = []
        self.inside = False
        self.mark = -1


def marks(name: str) -> bool:
    """Whether one class or id marks what is not the article: words that do, and none but words that may stand beside them."""
    words = [w for w in WORDS.findall(name) if w.strip("-_:./")]
    return not BAD_WORDS.isdisjoint(words) and all(w in BAD_WORDS or w in BESIDE_WORDS for w in words)


_MARKS: dict[str, bool] = {}


def _node(tag: str, attrs: str, parent: Node) -> Node:
    css = ""
    bad = 2 * (tag in BAD_TAGS)
    if attrs:
        for name, a, b, c in ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id"):
                css = " ".join(k for k in value.split() if not DIGIT.search(k)) if name == "class" else css
                if not bad and tag not in ("html", "body"):
                    for k in value.split():
                        if k not in _MARKS:
                            if len(_MARKS) > 100_000:
                                _MARKS.clear()
                            _MARKS[k] = marks(k)
                        bad = bad or int(_MARKS[k])
            elif name == "role" and value in BAD_ROLES:
                bad = 2
    return Node(tag, f"{tag}.{SPACES.sub(' ', css).strip()}" if css else tag, bad, parent)


def settle(nodes: list[Node]) -> None:
    """Sets inside (an article element) and bad for elements in document order. A mark by class is void on an element that holds all
    articles of the page, or, where there is none, its first main heading."""
    hard = {id(n) for n in nodes if n.bad == 2}
    for n in nodes:
        if n.up is not None and id(n.up) in hard:
            hard.add(id(n))
    anchors = [n for n in nodes if n.tag in ARTICLE and n.bad == 0 and id(n) not in hard]
    anchors = anchors or [n for n in nodes if n.tag == "h1" and id(n) not in hard][:1]
    above: Counter[int] = Counter()
    for n in anchors:
        while n is not None:
            above[id(n)] += 1
            n = n.up
    for n in nodes:
        up = n.up
        bad = n.bad == 2 or (n.bad == 1 and not (anchors and above[id(n)] == len(anchors))) or (n.tag == "header" and not (up is not None and up.inside))
        n.bad = int(bad or (up is not None and up.bad > 0))
        n.inside = not n.bad and (n.tag in ARTICLE or (up is not None and up.inside))


def parse(text: str) -> Node:
    """The DOM of a page; text of raw elements is left out, open elements end where HTML implies it."""
    root = Node("#root", "#root", 0, None)
    nodes, stack, at, size = [root], [root], 0, len(text)
    still: Counter[str] = Counter()  # open elements by tag

    def close(k: int) -> None:
        still.subtract([n.tag for n in stack[k:]])
        del stack[k:]

    while at < size:
        m = TOKEN.search(text, at)
        start = m.start() if m else size
        if start > at:
            stack[-1].kids.append(text[at:start])
        if not m:
            break
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1) if still[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(text, at)
            at = end.end() if end else size
            continue
        if tag in CLOSES_P and still["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in SAME and any([still[t] for t in SAME[tag]]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SAME[tag]:
                    close(k)
                    break
                if stack[k].tag in SCOPE[tag]:
                    break
        if tag in VOID:
            if tag not in INLINE:
                stack[-1].kids.append(" ")
            continue
        node = _node(tag, attrs, stack[-1])
        stack[-1].kids.append(node)
        nodes.append(node)
        if not attrs.endswith("/"):
            stack.append(node)
            still[tag] += 1
    settle(nodes)
    return root


class Shape:
    """An element for matching. form: hash of the labels of its subtree; whole: of labels and texts."""

    __slots__ = ("label", "kids", "text", "size", "bad", "inside", "index", "up", "count", "form", "whole")

    def __init__(self, label: str, bad: bool, inside: bool, index: int, up: int = -1):
        self.label, self.bad, self.inside, self.index, self.up = label, bad, inside, index, up
        self.kids: list[Shape] = []
        self.text, self.size, self.count, self.form, self.whole = 0, 0, 1, 0, 0


def sign(shapes: list[Shape]) -> list[Shape]:
    """Sets count, form and whole; hashes of whole numbers are the same in every process."""
    for s in reversed(shapes):
        own = zlib.crc32(s.label.encode("utf-8", "surrogatepass"))
        s.count = 1 + sum([k.count for k in s.kids])
        s.form = hash((own, *[k.form for k in s.kids]))
        s.whole = hash((own, s.text, *[k.whole for k in s.kids]))
    return shapes


def flatten(root: Node) -> list[Shape]:
    """Shapes in document order, the root first; marks each node with its shape."""
    shapes: list[Shape] = []
    stack: list[tuple[Node, int]] = [(root, -1)]
    while stack:
        n, up = stack.pop()
        own = Shape(n.label, n.bad, n.inside, len(shapes), up)
        n.mark = own.index
        if up >= 0:
            shapes[up].kids.append(own)
        shapes.append(own)
        kids = []
        for k in n.kids:
            if isinstance(k, str):
                t = k.strip()
                if t:
                    own.text = zlib.crc32(t.encode("utf-8", "surrogatepass"), own.text)
                    own.size += len(t)
            else:
                kids.append((k, own.index))
        stack.extend(reversed(kids))
    return sign(shapes)


def _ends(a: list[Shape], b: list[Shape], key) -> tuple[int, int]:
    """How many siblings agree in ``key`` at the start, and behind these at the end."""
    least, i, j = min(len(a), len(b)), 0, 0
    while i < least and key(a[i]) == key(b[i]):
        i += 1
    while j < least - i and key(a[-1 - j]) == key(b[-1 - j]):
        j += 1
    return i, j


FORM, WHOLE = attrgetter("form"), attrgetter("whole")
#: Weights of pairs of forms, for one worker process.
_WEIGHTS: dict[tuple[int, int], int] = {}


def _known(x: Shape, y: Shape) -> int | None:
    """Matched nodes of two subtrees as far as no table is needed."""
    if x.label != y.label:
        return 0
    if x.form == y.form:
        return x.count
    if not x.kids or not y.kids:
        return 1
    return _WEIGHTS.get((x.form, y.form))


def _weigh(x: Shape, y: Shape) -> int:
    """Simple tree matching: the largest number of matched nodes. It depends on the forms alone."""
    if len(_WEIGHTS) > 300_000:
        _WEIGHTS.clear()
    stack = [(x, y)]
    while stack:
        a, b = stack[-1]
        if _known(a, b) is not None:
            stack.pop()
            continue
        i, j = _ends(a.kids, b.kids, FORM)
        p, q = a.kids[i : len(a.kids) - j], b.kids[i : len(b.kids) - j]
        kinds = [(m, n) for m in {k.form: k for k in p}.values() for n in {k.form: k for k in q}.values()]
        if need := [(m, n) for m, n in kinds if _known(m, n) is None]:
            stack.extend(need)
            continue
        kept = sum([k.count for k in a.kids[:i]]) + sum([k.count for k in a.kids[len(a.kids) - j :]])
        _WEIGHTS[a.form, b.form] = 1 + kept + (int(_scores(p, q)[-1]) if p and q else 0)
        stack.pop()
    return _known(x, y)


def _lines(a: list[Shape], b: list[Shape]) -> Iterator[np.ndarray]:
    """For each of ``a`` its weights with all of ``b``."""
    own: dict[int, np.ndarray] = {}
    kinds = {k.form: k for k in b}
    at = {f: i for i, f in enumerate(kinds)}
    place = np.array([at[k.form] for k in b])
    for x in a:
        if x.form not in own:
            got = [_known(x, y) for y in kinds.values()]
            own[x.form] = np.array([_weigh(x, y) if w is None else w for w, y in zip(got, kinds.values(), strict=True)], dtype=np.int64)[place]
        yield own[x.form]


def _next(row: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros_like(row)
    np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w), out=out[1:])
    return out


def _scores(a: list[Shape], b: list[Shape]) -> np.ndarray:
    """Best sums of ``a`` with each start of ``b``."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for w in _lines(a, b):
        row = _next(row, w)
    return row


def _table(a: list[Shape], b: list[Shape]) -> list[tuple[Shape, Shape]]:
    """The pairs of siblings whose matched nodes are most; a large table is halved until its parts are small, which stays exact."""
    out, todo = [], [(a, b)]
    while todo:
        a, b = todo.pop()
        if not a or not b:
            continue
        if len(a) == len(b) == 1:
            if a[0].label == b[0].label:
                out.append((a[0], b[0]))
        elif len(a) > 1 and len(a) * len(b) > CELLS:
            mid = len(a) // 2
            cut = int(np.argmax(_scores(a[:mid], b) + _backward(a[mid:], b)))
            todo += [(a[:mid], b[:cut]), (a[mid:], b[cut:])]
        else:
            lines = list(_lines(a, b))
            rows = [np.zeros(len(b) + 1, dtype=np.int64)]
            for w in lines:
                rows.append(_next(rows[-1], w))
            i, j = len(a), len(b)
            while i and j:
                w = lines[i - 1][j - 1]
                if w and rows[i][j] == rows[i - 1][j - 1] + w:
                    i, j = i - 1, j - 1
                    out.append((a[i], b[j]))
                elif rows[i][j] == rows[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
    return out


def _backward(a: list[Shape], b: list[Shape]) -> np.ndarray:
    """Best sums of ``a`` with each end of ``b``."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for w in reversed(list(_lines(a, b))):
        row = _next(row, w[::-1])
    return row[::-1]


def _anchors(a: list[Shape], b: list[Shape]) -> list[tuple[int, int]]:
    """Places of subtrees that each side has once and both have, the longest row of them in one order."""
    one, two = Counter(map(WHOLE, a)), Counter(map(WHOLE, b))
    at = {k.whole: j for j, k in enumerate(b) if two[k.whole] == 1}
    found = [(i, at[k.whole]) for i, k in enumerate(a) if one[k.whole] == 1 and k.whole in at]
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(found):
        k = bisect_left(tails, j)
        back.append(ends[k - 1] if k else -1)
        tails[k : k + 1], ends[k : k + 1] = [j], [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(found[n])
        n = back[n]
    return out[::-1]


def match(a: Shape, b: Shape) -> list[tuple[int, int]]:
    """Indexes of the matched nodes. Siblings are aligned one by one: equal subtrees at both ends and those found once on each side
    first, then equal forms at the ends of each gap, and by simple tree matching what is left."""
    pairs: list[tuple[int, int]] = []
    todo = [(a, b)] if a.label == b.label else []
    while todo:
        x, y = todo.pop()
        pairs.append((x.index, y.index))
        if x.form == y.form and (x.whole == y.whole or x.count == 1):
            pairs.extend(zip(range(x.index + 1, x.index + x.count), range(y.index + 1, y.index + y.count), strict=True))
            continue
        p, q = x.kids, y.kids
        i, j = _ends(p, q, WHOLE)
        todo.extend(zip(p[:i], q[:i], strict=True))
        todo.extend(zip(p[len(p) - j :], q[len(q) - j :], strict=True))
        p, q = p[i : len(p) - j], q[i : len(q) - j]
        if not p or not q:
            continue
        m = n = 0
        for k, o in [*_anchors(p, q), (len(p), len(q))]:
            u, v = p[m:k], q[n:o]
            i, j = _ends(u, v, FORM)
            todo.extend(zip(u[:i], v[:i], strict=True))
            todo.extend(zip(u[len(u) - j :], v[len(v) - j :], strict=True))
            todo.extend(_table(u[i : len(u) - j], v[i : len(v) - j]))
            if k < len(p):
                todo.append((p[k], q[o]))
            m, n = k + 1, o + 1
    return pairs


def dump(shapes: list[Shape]) -> str:
    return json.dumps([[s.label, [k.index for k in s.kids], s.text, s.bad, s.inside] for s in shapes], separators=(",", ":"))


def load(text: str) -> list[Shape]:
    raw = json.loads(text)
    shapes = [Shape(label, bad, inside, i) for i, (label, _, _, bad, inside) in enumerate(raw)]
    for s, (_, kids, crc, _, _) in zip(shapes, raw, strict=True):
        s.kids, s.text = [shapes[k] for k in kids], crc
    return sign(shapes)


def different(bits: int) -> float:
    """How many different texts set these bits, estimated by linear counting."""
    free = BITS - bits.bit_count()
    return BITS * math.log(BITS / free) if free else math.inf


def induce(shapes: list[Shape], pages: int, sums: dict[int, tuple[int, int, int, int]]) -> tuple[int, list[int]]:
    """The content region (an index, -1: none) and the template nodes of a group; sums: matched, repeated, varying characters, bits of
    the texts."""
    template = []
    for s in shapes:
        matched, same, _, bits = sums.get(s.index, (0, 0, 0, 0))
        if s.text and matched >= 0.5 * pages and pages >= 3 and same >= (0.9 if s.inside else 0.5) * matched and (pages >= 10 or not s.inside):
            if different(bits) <= max(1.5, 0.25 * min(matched, BITS)):
                template.append(s.index)
    mass, known = [0] * len(shapes), set(template)
    for s in reversed(shapes):
        own = 0 if s.bad or s.index in known else sums.get(s.index, (0, 0, 0, 0))[2]
        mass[s.index] = own + sum(mass[k.index] for k in s.kids)
    at = shapes[0]
    if not mass[0]:
        return -1, template
    while at.label.split(".")[0] not in ARTICLE:
        best = max(at.kids, key=lambda k: mass[k.index], default=None)
        if best is None or mass[best.index] < 0.75 * mass[0] or best.label.split(".")[0] in ("p", "h1", "h2", "li", "td", "blockquote", *INLINE):
            break
        at = best
    return at.index, template


def extract(text: str | None, wrapper: tuple[list[Shape], int, frozenset[int]] | None = None) -> str:
    """The main text of one page."""
    return read_page(text, wrapper)[0]


def read_page(text: str | None, wrapper: tuple[list[Shape], int, frozenset[int]] | None = None) -> tuple[str, bool]:
    """The main text of one page, and whether a region of the wrapper gave it."""
    if not text:
        return "", False
    root = parse(text)
    shapes = flatten(root)
    region, dropped = -1, set()
    if wrapper:
        ref, at, template = wrapper
        for r, p in match(ref[0], shapes[0]):
            if r == at:
                region = p
            if r in template and ref[r].text == shapes[p].text:
                dropped.add(p)
    has_article = any(s.label.split(".")[0] in ARTICLE and not s.bad for s in shapes)

    def read(keep_template: bool) -> str:
        out: list[str] = []
        stack: list = [(root, False)]
        while stack:
            top = stack.pop()
            if isinstance(top, str):
                out.append(top)
                continue
            n, inside = top
            if n.bad:
                continue
            inside = inside or (n.mark == region if region >= 0 else n.tag in ARTICLE or not has_article)
            if n.tag not in INLINE:
                out.append("\n")
                stack.append("\n")
            shown = inside and (keep_template or n.mark not in dropped)
            stack.extend([k if isinstance(k, str) else (k, inside) for k in reversed(n.kids) if shown or not isinstance(k, str)])
        joined = "".join(out)
        return SPACES.sub(" ", entities.unescape(joined) if "&" in joined else joined).strip()

    return read(False) or read(True), region >= 0


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def grouped(pages: DataFrame) -> DataFrame:
    """``pages`` with host and layout."""
    named = F.transform(F.regexp_extract_all("html", F.lit(LAYOUT), 0), lambda x: F.regexp_replace(x, NUMBERED, ""))
    blocks = F.array_sort(F.array_distinct(named))
    return pages.withColumns({"host": host_of(F.col("url")), "layout": F.xxhash64(blocks)})


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, tree, region, template): one wrapper for each host and layout."""
    ship(pages.sparkSession)
    keyed = grouped(pages.select("page_id", "url", "html")).filter("host IS NOT NULL AND html IS NOT NULL").select("host", "layout", "page_id", "html")
    chosen = staged(keyed.groupBy("host", "layout").agg(F.min_by("page_id", F.xxhash64("page_id")).alias("page_id")), "html-references")
    first = keyed.join(chosen, ["host", "layout", "page_id"], "left_semi").groupBy("host", "layout").agg(F.min("html").alias("html"))

    def shapes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"host": pdf["host"], "layout": pdf["layout"], "tree": [dump(flatten(parse(h))) for h in pdf["html"]]})

    trees = staged(first.mapInPandas(shapes_of, "host string, layout long, tree string"), "html-trees")
    bits = [f"b{k}" for k in range(BITS // 64)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict[tuple[str, int, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
            known: dict[tuple[str, int], list[Shape]] = {}
            for host, layout, tree, text in zip(pdf["host"], pdf["layout"], pdf["tree"], pdf["html"], strict=True):
                ref = known.get((host, layout)) or known.setdefault((host, layout), load(tree))
                shapes = flatten(parse(text))
                sums[host, layout, -1][0] += 1
                owner = [-1] * len(shapes)
                for r, p in match(ref[0], shapes[0]):
                    got, same = sums[host, layout, r], ref[r].text == shapes[p].text
                    got[0] += 1
                    got[1] += same
                    got[2] += 0 if same else shapes[p].size
                    got[3] |= 1 << ((shapes[p].text * 0x9E3779B1 >> 16) % BITS)
                    owner[p] = r
                for s in shapes:  # text without a partner varies in the next element above that has one
                    if owner[s.index] < 0:
                        owner[s.index] = owner[s.up]
                        if s.size and not s.bad:
                            sums[host, layout, owner[s.index]][2] += s.size
            rows = [(*key, *v[:3], *np.frombuffer(v[3].to_bytes(BITS // 8, "little"), dtype="<i8").tolist()) for key, v in sums.items()]
            yield pd.DataFrame(rows, columns=["host", "layout", "node", "matched", "same", "varying", *bits])

    schema = "host string, layout long, node int, matched long, same long, varying long, " + ", ".join(f"{b} long" for b in bits)
    seen = keyed.select("host", "layout", "html").join(trees, ["host", "layout"]).mapInPandas(count, schema)
    sums = seen.groupBy("host", "layout", "node").agg(*[F.sum(c).alias(c) for c in ("matched", "same", "varying")], *[F.bit_or(b).alias(b) for b in bits])
    each = sums.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "matched", "same", "varying", *bits)).alias("sums")).join(trees, ["host", "layout"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for host, layout, tree, own in zip(pdf["host"], pdf["layout"], pdf["tree"], pdf["sums"], strict=True):
                texts = {int(x["node"]): int.from_bytes(np.array([x[b] for b in bits], dtype="<i8").tobytes(), "little") for x in own}
                by = {int(x["node"]): (int(x["matched"]), int(x["same"]), int(x["varying"]), texts[int(x["node"])]) for x in own}
                region, template = induce(load(tree), by.get(-1, (0, 0, 0, 0))[0], by)
                rows.append((host, layout, tree, region, template))
            yield pd.DataFrame(rows, columns=["host", "layout", "tree", "region", "template"])

    return staged(each.mapInPandas(decide, "host string, layout long, tree string, region int, template array<int>"), "html-wrappers")


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, and whether the text is that of a region of its group's wrapper."""
    ship(pages.sparkSession)
    wrappers = induce_wrappers(pages)
    keyed = grouped(pages.select("page_id", "url", "html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, int], tuple] = {}
        for pdf in batches:
            texts, used = [], []
            for host, layout, tree, region, template, text in zip(pdf["host"], pdf["layout"], pdf["tree"], pdf["region"], pdf["template"], pdf["html"], strict=True):
                wrapper = None
                if isinstance(tree, str):
                    if (host, layout) not in known:
                        if len(known) > 500:
                            known.clear()
                        known[host, layout] = (load(tree), int(region), frozenset(int(x) for x in template))
                    wrapper = known[host, layout]
                got, by = read_page(text, wrapper)
                texts.append(got)
                used.append(by)
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts], "by_wrapper": used})

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, by_wrapper boolean"
    return keyed.join(wrappers, ["host", "layout"], "left").mapInPandas(run, schema)
