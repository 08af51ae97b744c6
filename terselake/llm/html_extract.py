"""HTML extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

A page is parsed into block elements and text leaves (runs of inline content). Every node gets
features: tag, depth, attribute tokens of its own and of its ancestors, text, link and tag counts
of its subtree, their densities, and statistics of its siblings. The trees give each node the
probability of holding main text; the decoding picks the most likely labelling in which a
dropped node drops its whole subtree and a kept leaf has kept ancestors only, so ancestor and
descendant never contradict each other. The text of the kept leaves, in page order, is the result.

No table marks pages, so the trees are fitted on generated pages whose parts are known
(``GbtParams.pages`` of them, seeded): layouts with and without semantic tags, menus, headers,
footers, sidebars, notices, adverts, forms, comments.

Text rules: character references are decoded, white space within a block becomes one space, ``br``
is white space, blocks join by a line feed. Scripts, styles, titles, form controls and comments of
the markup never are text; what svg and math show is text of the block around them.

Edge cases: null, empty or text-free html gives an empty text; broken markup is closed where a
browser would close it, or read as text; a skipped element whose end tag is missing ends with
an element around it or at the next block, whichever comes first; an unfinished tag at the end is left out; repeated rows get
equal results; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_module
import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terselake.llm import common

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>)""", re.S)
_ATTRIBUTES = re.compile(r"""\b(class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_UNFINISHED = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
#: Elements whose content is no text of the page. Head needs no place here: what may stand in it is void or skipped, and all else ends it.
_SKIPPED = frozenset("script style title noscript noframes template iframe object canvas select button textarea option datalist audio video map".split())
#: Elements of svg and math that are not shown; the text of the others belongs to the block around them.
_UNSEEN = {"svg": frozenset("title desc metadata defs style script".split()), "math": frozenset(("annotation", "annotation-xml"))}
#: Start tags that end svg and math.
_BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
_SPACED = frozenset("text mtr mtd".split())
#: Raw text: no tags inside, the first end tag of the name ends it.
_RAW_END = {n: re.compile(rf"""</{n}(?=[\s/>])(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.I) for n in ("script", "style", "title", "textarea", "noframes")}
_VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Tags with a feature of their own; others share the last one.
TAGS = ("#leaf", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "dl", "dialog", "#other")
_TAG_CODE = {t: k for k, t in enumerate(TAGS)} | {"h4": TAGS.index("h3"), "h5": TAGS.index("h3"), "h6": TAGS.index("h3"), "th": TAGS.index("td")}
#: A start tag on the left ends an open element on the right.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_CELLS = frozenset("tr td th thead tbody tfoot caption".split())
_NESTING = frozenset("template object canvas datalist audio video map".split())
#: Parts of skipped elements that have no end tag to wait for.
_INSIDE = frozenset("option optgroup".split())
_BARRIER = frozenset("ul ol dl table div section article aside nav main body form footer header blockquote".split())
#: Attribute tokens by what they speak for.
GROUPS = (
    frozenset("article content post entry story main body text maincontent postbody articlebody prose blog".split()),
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs topbar toc pagination pager tabs skip".split()),
    frozenset("header masthead head branding logo hero tagline".split()),
    frozenset("footer foot copyright legal colophon bottom".split()),
    frozenset("sidebar side aside widget rail related recommended more trending popular tags archive".split()),
    frozenset("ad ads advert adverts advertisement adsbygoogle banner promo promoted sponsor sponsored dfp commercial".split()),
    frozenset("cookie cookies notice consent alert gdpr popup modal overlay privacy message warning subscribe newsletter paywall".split()),
    frozenset("form login signup search register contact feedback survey".split()),
    frozenset("comment comments commentlist reply replies disqus discussion respond thread reader responses".split()),
    frozenset("share social sharing follow author byline meta date".split()),
)
_SEMANTIC = ("nav", "header", "footer", "aside", "form", "article", "main", "dialog")


@dataclass
class Nodes:
    """The nodes of some pages in page order (parents first); numbers are of the node itself."""

    page: list[int]
    parent: list[int]
    tag: list[int]
    groups: list[int]  # bit set of GROUPS
    semantic: list[int]  # bit set of _SEMANTIC
    chars: list[int]
    links: list[int]
    words: list[int]
    marks: list[int]
    label: list[int]
    text: list[str]


def _no_nodes() -> Nodes:
    return Nodes([], [], [], [], [], [], [], [], [], [], [])


@cache
def _bits_of(attributes: str, marked: bool) -> tuple[int, int]:
    """(bit set of token groups, training label or -1) of a tag's attributes; only generated pages are marked."""
    bits, label = 0, -1
    for m in _ATTRIBUTES.finditer(attributes):
        value = m[2].strip("\"'")
        if m[1].lower() == "data-y":
            if marked:
                label = int(value)
            continue
        tokens = {t.lower() for t in _TOKENS.findall(value)} | set(re.split(r"[^a-z0-9]+", value.lower()))
        for k, group in enumerate(GROUPS):
            if tokens & group:
                bits |= 1 << k
    return bits, label


def _attribute_bits(attributes: str, marked: bool) -> tuple[int, int]:
    if "=" not in attributes:
        return 0, -1
    if _bits_of.cache_info().currsize > 50_000:
        _bits_of.cache_clear()
    lowered = attributes.lower()
    return _bits_of(attributes, marked) if "class" in lowered or "id" in lowered or "role" in lowered or "data-y" in lowered else (0, -1)


_PAIRS = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea)(?=[\s/>]).*?(?:</(?P=raw)(?=[\s/>])|\Z)|<(?P<end>/?)(?P<name>{"|".join(sorted(_SKIPPED - _RAW_END.keys()))})(?=[\s/>])""", re.S | re.I)


def _paired(source: str) -> set[int]:
    """Places of the start tags of skipped elements that have an end tag of their own."""
    out: set[int] = set()
    waiting: dict[str, list[int]] = {}
    for m in _PAIRS.finditer(source):
        if m["name"]:
            places = waiting.setdefault(m["name"].lower(), [])
            if not m["end"]:
                places.append(m.start())
            elif places:
                out.add(places.pop())
    return out


def parse(page: int, source: str, nodes: Nodes, marked: bool = True) -> None:
    """Append the page's nodes; marked: data-y attributes are training labels."""
    def add(parent: int, tag: int, groups: int, semantic: int, label: int) -> int:
        nodes.page.append(page)
        nodes.parent.append(parent)
        nodes.tag.append(tag)
        nodes.groups.append(groups)
        nodes.semantic.append(semantic)
        nodes.chars.append(0)
        nodes.links.append(0)
        nodes.words.append(0)
        nodes.marks.append(0)
        nodes.label.append(label)
        nodes.text.append("")
        return len(nodes.page) - 1

    stack: list[tuple[str, int]] = [("body", add(-1, _TAG_CODE["body"], 0, 0, 0))]
    open_names: dict[str, int] = {}  # how many elements of a name are on the stack
    run: list[str] = []  # of the leaf that is open
    linked = in_link = 0

    def piece(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = html_module.unescape(text)
        run.append(text)
        if in_link:
            linked += len(text)

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                k = add(stack[-1][1], 0, 0, 0, nodes.label[stack[-1][1]])
                nodes.chars[k], nodes.links[k], nodes.words[k] = len(text), min(linked, len(text)), text.count(" ") + 1
                nodes.marks[k] = text.count(".") + text.count(",")
                nodes.text[k] = text
        linked = 0

    def pop_to(names: tuple[str, ...], barred: bool) -> None:
        """Close the innermost open element of the names, with what is open in it."""
        if not any(map(open_names.get, names)):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                for name, _ in stack[k:]:
                    open_names[name] -= 1
                del stack[k:]
                return
            if barred and stack[k][0] in _BARRIER:
                return

    at, skip, own_end = 0, "", False
    paired: set[int] | None = None
    inner: list[str] = []  # open elements within the skipped one
    foreign, level = "", 0  # svg or math, and how many of it are open
    around: list[int] = []  # levels of svg around html in foreignobject

    def is_open(name: str) -> bool:
        return name == "body" or open_names.get(name, 0) > 0

    def ends_skipped(name: str, closing: bool) -> bool:
        """Whether a tag that is not the skipped element's own end tag ends it; else note what it opens or closes inside."""
        if closing:
            if name in inner:
                del inner[len(inner) - 1 - inner[::-1].index(name):]
                return False
            return name == foreign or not (own_end and skip in ("template", "object")) and is_open(name)
        if foreign:
            if name == foreign:
                inner.append(name)
            return name in _BREAKS_OUT and skip not in ("title", "desc", "annotation-xml")  # those may hold html
        if skip == "select" and name in ("select", "input", "textarea"):
            return True
        if name in _CELLS and skip != "template" and "table" not in inner and is_open("table"):
            return True
        if name in _VOID or name in _INLINE or name in _INSIDE:
            return False
        if not own_end and name in _TAG_CODE:
            return True
        if name != skip or name in _NESTING:
            inner.append(name)
        return False

    while m := _TAG.search(source, at):
        start = m.start()
        if start > at and not skip:
            piece(source[at:start])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if skip:
            if m[1] and name == skip and name not in inner:
                skip = ""
                continue
            if name in _RAW_END and not m[1] and not foreign and "svg" not in inner and not (skip == "select" and name == "textarea"):
                end = _RAW_END[name].search(source, at)
                at = end.end() if end else len(source)
                continue
            if not ends_skipped(name, bool(m[1])):
                continue
            skip = ""
        closed = not m[1] and m[3].endswith("/")
        if foreign:
            if m[1] and name == foreign:
                level -= 1
                foreign = foreign if level else ""
                continue
            if is_open(name) if m[1] else name in _BREAKS_OUT:
                foreign = ""
            else:
                if m[1] and name in _SPACED:
                    run.append(" ")
                elif not m[1] and not closed:
                    if name == foreign:
                        level += 1
                    elif name in _UNSEEN[foreign]:
                        skip, own_end = name, False
                        inner.clear()
                    elif name == "foreignobject":
                        foreign = ""
                        around.append(level)
                continue
        if name in ("svg", "math"):
            if m[1]:
                around.clear()
            elif not closed:
                foreign, level = name, 1
            continue
        if name == "foreignobject" and m[1] and around:
            flush()
            foreign, level = "svg", around.pop()
            continue
        if name in _RAW_END and not m[1]:
            end = _RAW_END[name].search(source, at)
            at = end.end() if end else len(source)
            continue
        if name in _INLINE:
            if name == "a":
                in_link = 0 if m[1] else 1
            continue
        if name == "br":
            run.append("\n")
            continue
        if m[1]:
            if name in _SKIPPED or name in _VOID:
                continue
            pop_to((name,), False)
            in_link = 0
            continue
        if name in _SKIPPED:
            if paired is None:
                paired = _paired(source)
            skip, own_end = name, start in paired
            inner.clear()
            continue
        if name in ("html", "head", "body"):
            if name == "body":
                groups, label = _attribute_bits(m[3], marked)
                nodes.groups[stack[0][1]] |= groups
                nodes.label[stack[0][1]] = max(label, nodes.label[stack[0][1]])
            continue
        flush()
        if name in _VOID:
            continue
        pop_to(("p",), True)
        if name in _ENDS:
            pop_to(_ENDS[name], True)
        groups, label = _attribute_bits(m[3], marked)
        parent = stack[-1][1]
        semantic = 1 << _SEMANTIC.index(name) if name in _SEMANTIC else 0
        k = add(parent, _TAG_CODE.get(name, len(TAGS) - 1), groups, semantic, nodes.label[parent] if label < 0 else label)
        stack.append((name, k))
        open_names[name] = open_names.get(name, 0) + 1
    if not skip and at < len(source):
        piece(_UNFINISHED.sub("", source[at:]))
    flush()


def _features(n: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, parent, depth, end of each node's subtree); subtree sums are differences of running sums in page order."""
    size = len(n.page)
    parent, page, tag = np.array(n.parent), np.array(n.page), np.array(n.tag)
    depth = np.zeros(size, int)
    above_groups, above_semantic = np.zeros(size, int), np.zeros(size, int)
    groups, semantic = np.array(n.groups), np.array(n.semantic)
    level, children = np.flatnonzero(parent < 0), np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[children], np.arange(size + 1))
    while len(level):
        counts = first[level + 1] - first[level]
        below = children[np.repeat(first[level], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
        up = parent[below]
        depth[below] = depth[up] + 1
        above_groups[below] = above_groups[up] | groups[up]
        above_semantic[below] = above_semantic[up] | semantic[up]
        level = below
    # the end of a subtree: the next node in page order that is not deeper
    end = np.full(size, size)
    page_end = np.searchsorted(page, page, side="right")
    open_nodes: list[int] = []
    for k, d in enumerate(depth.tolist()):
        while open_nodes and depth[open_nodes[-1]] >= d:
            end[open_nodes.pop()] = k
        open_nodes.append(k)
    end = np.minimum(end, page_end)
    start = np.arange(size)

    def subtree(values) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return (total[end] - total[start]).astype(float)

    chars, links, words, marks = (subtree(np.array(x)) for x in (n.chars, n.links, n.words, n.marks))
    leaf = tag == 0
    tags, leaves, p_count, li_count = subtree(~leaf), subtree(leaf), subtree(tag == _TAG_CODE["p"]), subtree(tag == _TAG_CODE["li"])
    root = np.searchsorted(page, page)
    up = np.where(parent < 0, start, parent)
    by_parent = np.bincount(up, weights=chars, minlength=size)
    n_children = np.bincount(parent[parent >= 0], minlength=size)
    index = np.zeros(size)
    index[children] = np.where(parent[children] < 0, 0, np.arange(size) - first[np.maximum(parent[children], 0)])
    siblings = np.where(parent < 0, 1, n_children[up])
    order = children  # siblings stand together here
    before, after = np.zeros(size), np.zeros(size)
    same = (parent[order[1:]] == parent[order[:-1]]) & (parent[order[1:]] >= 0)  # the roots of other pages are no siblings
    before[order[1:]] = np.where(same, chars[order[:-1]], 0)
    after[order[:-1]] = np.where(same, chars[order[1:]], 0)
    columns = [
        *(tag == k for k in range(len(TAGS))),
        *(groups >> k & 1 for k in range(len(GROUPS))), *(above_groups >> k & 1 for k in range(len(GROUPS))),
        *((semantic | above_semantic) >> k & 1 for k in range(len(_SEMANTIC))),
        depth, np.log1p(chars), np.log1p(words), links / np.maximum(chars, 1), marks / np.maximum(words, 1), chars / (tags + 1), words / np.maximum(leaves, 1),
        np.log1p(tags), np.log1p(leaves), p_count / np.maximum(tags, 1), li_count / np.maximum(tags, 1), chars / np.maximum(chars[root], 1), chars / np.maximum(by_parent[up], 1),
        index, siblings, index / np.maximum(siblings - 1, 1), np.log1p(before), np.log1p(after), np.log1p(chars[up]), links[up] / np.maximum(chars[up], 1), tag[up] == _TAG_CODE["li"], tag[up] == _TAG_CODE["p"], tag[up],
    ]
    return np.column_stack([np.asarray(c, np.float32) for c in columns]), parent, depth, end


# ---------------------------------------------------------------- boosted trees


@dataclass(frozen=True)
class GbtParams:
    pages: int = 800
    trees: int = 40
    depth: int = 4
    rate: float = 0.3
    least_weight: float = 6.0
    ridge: float = 1.0
    bins: int = 32
    seed: int = 3


@dataclass(frozen=True)
class Gbt:
    """Complete trees of one depth: nodes in heap order."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), int)
            while True:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
                if not len(at) or at[0] >= inner:
                    break
            out += value[at - inner] if len(at) else 0
        return out


def fit(x: np.ndarray, y: np.ndarray, p: GbtParams = GbtParams()) -> Gbt:
    """Second-order boosting of the logistic loss with histograms of quantile bins."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    margin, inner = np.full(len(y), base), 2**p.depth - 1
    features, thresholds, values = [], [], []
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        at = np.zeros(len(y), int)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf)
            if len(mine):
                gn, hn = g[mine], h[mine]
                gt, ht = gn.sum(), hn.sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[mine, f]
                    gl = np.cumsum(np.bincount(b, gn, len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, hn, len(c) + 1))[:-1]
                    gain = gl**2 / (hl + p.ridge) + (gt - gl) ** 2 / (ht - hl + p.ridge) - gt**2 / (ht + p.ridge)
                    gain[(hl < p.least_weight) | (ht - hl < p.least_weight)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, c[k])
            feature[node], threshold[node] = best[1], best[2]
            at[mine] = 2 * node + 1 + (x[mine, best[1]] > best[2])
        gs, hs = np.bincount(at - inner, g, 2**p.depth), np.bincount(at - inner, h, 2**p.depth)
        value = -p.rate * gs / (hs + p.ridge)
        margin += value[at - inner]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Gbt(np.array(features), np.array(thresholds, np.float32), np.array(values), base)


def decode(margin: np.ndarray, parent: np.ndarray, depth: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Kept nodes of the most likely labelling without contradictions; a page's root may also be dropped."""
    log_keep, log_drop = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    keep, drop = log_keep.copy(), log_drop.copy()  # drop: the whole subtree dropped; summed within a page, so that other pages leave its rounding alone
    by_depth = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[by_depth], np.arange(depth.max(initial=0) + 2))
    for d in range(len(bounds) - 2, 0, -1):
        level = by_depth[bounds[d]:bounds[d + 1]]
        np.add.at(keep, parent[level], np.maximum(keep[level], drop[level]))
        np.add.at(drop, parent[level], drop[level])
    kept = keep > drop
    for d in range(1, len(bounds) - 1):
        level = by_depth[bounds[d]:bounds[d + 1]]
        kept[level] &= kept[parent[level]]
    return kept


# ---------------------------------------------------------------- generated pages


def generated_page(r: random.Random) -> str:
    """A page whose main text is marked by data-y="1", and parts to drop inside it by data-y="0"."""
    syllables = ["ka", "lo", "mi", "ter", "on", "en", "sa", "ri", "du", "ves", "an", "el", "ion", "pre", "st", "qu", "be", "ching", "ou", "é", "ü", "ña"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def marks() -> str:
        """Mostly nothing, else a run of one mark after every word."""
        return "" if r.random() < 0.57 else r.choice(["!", "?", "%", "&amp;", "#", "*", "~", "+", "=", "$", "@", "^", "|", ";"]) * r.randint(1, 3)

    def sentence(low: int = 3, high: int = 18) -> str:
        words = [word() for _ in range(r.randint(low, high))]
        if r.random() < 0.1:
            k = r.randrange(len(words))
            words[k] = f'<a href="/{words[k]}">{words[k]}</a>'
        if r.random() < 0.08:
            words[0] = f"<b>{words[0]}</b>"
        noise = marks()
        return " ".join(w + noise for w in words).capitalize() + "."

    text = lambda low, high: " ".join(sentence() for _ in range(r.randint(low, high)))
    label = lambda: " ".join(word() for _ in range(r.choice([1, 1, 1, 2, 4]))) + r.choice(["", "", "", ",", ".", marks()])
    links = lambda n: "".join(f'<li><a href="/{(w := label())}">{w}</a></li>' for _ in range(n))

    def marked(tag: str, names: list[str], inside: str, label: str = "") -> str:
        attr = ""
        if r.random() < 0.85 and names:
            attr = f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'
        return f"<{tag}{attr}{label}>{inside}</{tag}>"

    def either(tag: str, names: list[str], inside: str, label: str = "") -> str:
        """The semantic tag, or a div or section that is named for its part."""
        if r.random() < 0.5:
            return marked(tag, names if r.random() < 0.3 else [], inside, label)
        other = r.choice(["div", "div", "section"])
        return f'<{other} {r.choice(["class", "id"])}="{r.choice(names)}"{label}>{inside}</{other}>'

    drop = ' data-y="0"'
    nav = lambda: either("nav", ["nav", "menu", "main-menu", "navbar", "breadcrumb"], f"<ul>{links(r.randint(2, 9))}</ul>", drop)
    advert = lambda: marked("div", ["ad", "ads", "ad-slot", "banner", "sponsor", "advert", "promo-box"], r.choice([sentence(), text(1, 3), f"<p>{sentence()}</p>", f'<a href="/x">{sentence()}</a>']), drop) if r.random() < 0.97 else marked("ins", [], "", drop)
    notice = lambda: f'<div {r.choice(["class", "id"])}="{r.choice(["cookie-notice", "notice", "consent", "alert", "gdpr-banner", "newsletter", "popup"])}"{drop}>{r.choice(["<p>" + text(1, 2) + "</p>", text(1, 2)])}</div>'
    form = lambda: f'<form{r.choice(["", " class=search", " id=login"])}{drop}><label>{word()}</label><input name="q"><p>{sentence(2, 8)}</p></form>'
    sidebar = lambda: either("aside", ["sidebar", "widget", "side-bar", "related", "right-rail"], f"<h3>{word()}</h3>" + r.choice([f"<ul>{links(r.randint(2, 8))}</ul>", f"<p>{text(1, 4)}</p>"]), drop)
    comment = lambda: f'<div class="comment"><p>{text(1, 4)}</p></div>'

    def comments() -> str:
        tag, attr = r.choice([("section", 'class="comments"'), ("div", 'id="comments"'), ("ol", 'class="commentlist"'), ("div", 'class="reader-comments"')])
        return f"<{tag} {attr}{drop}>" + "".join(comment() for _ in range(r.randint(1, 6))) + f"</{tag}>"

    bare_link = lambda: f'<a href="#{word()}">{label()}</a>' if r.random() < 0.5 else f'<p><a href="/{word()}">{label()}</a></p>'  # noqa: E731  as those that skip to the content or back to the top
    header = lambda: either("header", ["header", "masthead", "site-header", "branding"], f"<h1>{word()}</h1>" * r.randint(0, 1) + f"<p>{sentence(2, 7)}</p>", drop)
    footer = lambda: either("footer", ["footer", "site-footer", "copyright", "legal"], r.choice([f"&copy; {word()} &middot; {sentence()}", f"<p>{text(1, 3)}</p>", f"<ul>{links(4)}</ul>"]), drop)

    def blocks() -> str:
        title = f"<h1>{sentence(2, 9)}</h1>"
        out = [r.choice([title, title, title, title, f"<header>{title}</header>"])] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.74:
                out.append(f"<p>{r.choice(['', '', '<b>'])}{text(1, r.choice([1, 3, 6, 14]))}{r.choice(['</p>', '</p>', '</p>', '<br>'])}")
            elif kind < 0.81:
                out.append(f"<h2>{sentence(1, 6)}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote><p>{text(1, 2)}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{word()}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.96:
                out.append(f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>")
            else:
                out.append(f"<pre>{text(1, 2)}</pre>")
            if r.random() < 0.08:
                out.append(r.choice([advert, advert, notice, sidebar, form, nav])())
        return "".join(out)

    inside = blocks()
    if r.random() < 0.06:
        main = f'<div data-y="1">{inside}</div>'
    elif r.random() < 0.55:
        main = f'<article data-y="1">{inside}</article>'
    else:
        tag = r.choice(["div", "section", "main"])
        main = f'<{tag} {r.choice(["class", "id"])}="{r.choice(["content", "post", "entry-content", "article-body", "story", "main-content"])}" data-y="1">{inside}</{tag}>'
    if r.random() < 0.3:
        main = f'<main>{main}{comments() if r.random() < 0.4 else ""}</main>'
    elif r.random() < 0.3:
        main = f'<div class="{r.choice(["wrapper", "container", "page", "layout"])}">{main}{sidebar() if r.random() < 0.5 else ""}</div>'
    if r.random() < 0.05:  # a bare page
        return f'<html><body data-y="1">{r.choice([inside, text(1, 6)])}</body></html>'
    before = [f() for f in (header, nav, advert, notice, form) if r.random() < 0.45]
    after = [f() for f in (comments, advert, sidebar, form, notice, nav) if r.random() < 0.3]
    before += [bare_link()] if r.random() < 0.15 else []
    after += [bare_link()] if r.random() < 0.15 else []
    r.shuffle(before)
    r.shuffle(after)
    if r.random() < 0.3:
        main = f'<div {r.choice(["class", "id"])}="{r.choice(["site-content", "columns", "inner", "row", "c"])}">{main}</div>'
    page = "".join(before) + main + "".join(after) + (footer() if r.random() < 0.8 else "")
    if r.random() < 0.3:
        page = f'<div {r.choice(["class", "id"])}="{r.choice(["page", "site", "wrapper", "layout", "outer"])}">{page}</div>'
    names = f' class="{r.choice(["home blog", "single single-post", "page", "main", "article-page", "default", "dark"])}"' if r.random() < 0.4 else ""
    return f"<!DOCTYPE html><html><head><title>{word()}</title></head><body{names}>{page}</body></html>"


@cache
def trained(p: GbtParams = GbtParams()) -> Gbt:
    r, nodes = random.Random(p.seed), _no_nodes()
    for k in range(p.pages):
        parse(k, generated_page(r), nodes)
    x, parent, depth, end = _features(nodes)
    leaf_label = np.where(np.array(nodes.tag) == 0, np.array(nodes.label), 0)
    running = np.concatenate([[0], np.cumsum(leaf_label)])
    y = (running[end] - running[:-1] > 0).astype(float)  # an element is kept if any leaf in it is
    return fit(x, y, p)


# ---------------------------------------------------------------- the operator


def texts(model: Gbt, sources: list[str]) -> list[str]:
    """The main text of each page."""
    nodes = _no_nodes()
    for k, source in enumerate(sources):
        parse(k, source, nodes, marked=False)
    out: list[list[str]] = [[] for _ in sources]
    if nodes.page:
        x, parent, depth, end = _features(nodes)
        kept = decode(model.margin(x), parent, depth, end)
        for k in np.flatnonzero(kept & (np.array(nodes.tag) == 0)).tolist():
            out[nodes.page[k]].append(nodes.text[k])
    return ["\n".join(t) for t in out]


def extract(pages: DataFrame, params: GbtParams = GbtParams(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html", batch_chars: int = 2_000_000) -> DataFrame:
    """Per row: ``page_id, url, text, n_chars``."""
    sent = pages.sparkSession.sparkContext.broadcast(trained(params))  # some ten kilobytes, whatever the data

    def run(batch: pa.RecordBatch):
        done: list[str] = []
        held: list[str] = []
        size = 0
        for source in common.texts_of(batch, "html"):
            held.append(source)
            size += len(source)
            if size >= batch_chars:
                done += texts(sent.value, held)
                held, size = [], 0
        done += texts(sent.value, held)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.string()), pa.array([len(t) for t in done], pa.int64())], ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return common.map_batches(narrow, run, "page_id long, url string, text string, n_chars long")
