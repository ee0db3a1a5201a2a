"""Main text of web pages by a tree-structured graphical model.

The DOM's elements are binary variables, article or not. A node's potential comes from its tag, the words in its class,
id and role, and its text and link counts; a potential between parent and child says how far the child follows. The
DOM is a tree, so sum-product messages, once up and once down, give exact marginals; text under a marginal of one half
or more is the article. Weights are trained by gradient ascent on the likelihood of labelled pages (`fit`).

All pages of a batch form one forest, so messages are numpy operations level by level; only reading the markup is a
loop over a page's tags.

Defined results: null or empty html gives the empty text; scripts, styles, comments, the head and form controls are never
text; markup left open or cut off is closed at the end; equal pages get equal texts; an empty table gives an empty
result. A `<br>` is white space. Other columns are ignored. A head without an end tag ends at the first tag or text that
can't be in one; any other hidden element without one ends with its parent or at the next block (scripts, styles, titles
and textareas run on to the end, as in HTML).
"""

from __future__ import annotations

import functools
import html as codec
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import query, table
from sparktab.llm.html_samples import labelled_pages

TRAINING_PAGES = 300
BATCH_CHARS = 4_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?"
                    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<broken>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>?", re.S)
_CUE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names of HTML by their role in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title noscript template iframe svg canvas object textarea select button datalist audio video math".split())
RAW = frozenset("script style title textarea".split())  # read on to their end tag, or to the end of the page
FALLBACK = frozenset(("noscript", "iframe"))  # read on to their end tag if they have one
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
BARRIER = frozenset("ul ol dl table body html article section div main aside nav form".split())
STOPS = BARRIER | HIDDEN  # no end tag of an inline element reaches past these

# Tag groups and words in class, id and role that hint at a part of a page.
TAGS = {t: g for g, names in {
    "p": "p", "heading": "h1 h2 h3 h4 h5 h6", "item": "li dt dd", "list": "ul ol dl menu", "nav": "nav", "aside": "aside", "footer": "footer", "header": "header",
    "form": "form fieldset legend label input", "article": "article", "main": "main", "section": "section", "div": "div center", "table": "table tbody thead tfoot tr td th caption",
    "quote": "blockquote pre code", "figure": "figure figcaption img picture", "root": "html body #root", "inline": " ".join(sorted(INLINE - {"label", "code"})),
}.items() for t in names.split()}
HINTS = {w: g for g, words in {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner adslot adsbygoogle adbox teaser dfp",
    "notice": "notice cookie cookies consent gdpr popup modal overlay alert alerts dialog announcement warning paywall",
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular more archive tags tagcloud complementary outbrain taboola",
    "comment": "comment comments commentlist disqus reply replies respond response responses discussion reviews feedback guestbook",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toc tabs pagination pager links toolbar topbar skip",
    "foot": "footer foot copyright legal colophon contentinfo bottom disclaimer imprint",
    "head": "header masthead logo branding tagline site banner",
    "form": "form search newsletter subscribe subscription signup login register contact",
    "share": "share sharing social follow likes twitter facebook",
    "body": "article content main post entry story body text page blog news",
}.items() for w in words.split()}
BLOCK = frozenset(TAGS) - INLINE - VOID - {"#root", "picture", "legend"}  # what ends a hidden element that was left open
GROUPS = sorted(set(TAGS.values())) + ["other"]
KINDS = sorted(set(HINTS.values()))
BINS = ["own0", "own1", "own6", "own20", "all0", "all1", "all10", "all50", "all150", "links0", "links1", "links5", "links8", "ends", "stops3", "copy", "first"]
FEATURES = GROUPS + KINDS + BINS
EDGES = 4  # leaf-like child, plain container, child with a hint or a telling tag, child with the hint `body`
_AT = {f: i for i, f in enumerate(FEATURES)}
_TELLING = frozenset(("nav", "aside", "footer", "header", "form"))


@dataclass
class Page:
    parent: list[int]            # of each node; -1 for the root
    features: list[list[int]]    # indexes into FEATURES
    edge: list[int]
    flow: list[tuple[int, str]]  # (node, text), or (-1, "") where a block ends
    label: list[bool]


def _tags(source: str) -> tuple[list[tuple[str, str, str, str]], dict[int, int]]:
    """The text before each tag with the tag (text, end tag, start tag, attributes); where hidden elements with an end tag end."""
    out: list[tuple[str, str, str, str]] = []
    ends: dict[int, int] = {}
    opened: list[tuple[str, int]] = []  # without inline elements
    count: Counter[str] = Counter()
    lost: set[str] = set()              # names without a further end tag
    at, foreign, size, find = 0, False, len(source), _TOKEN.search
    while at < size:
        m = find(source, at)
        if m is None:
            out.append((source[at:], "", "", ""))
            break
        before, at = source[at:m.start()], m.end()
        end, name = (m["end"] or "").lower(), (m["tag"] or m["broken"] or "").lower()
        attrs = m["attrs"] or m["rest"] or ""
        here = len(out)
        out.append((before, end, name, attrs))
        if end:
            if end in ("svg", "math"):
                foreign = False
            if count[end]:
                while opened:
                    top, start = opened.pop()
                    count[top] -= 1
                    if top == end:
                        if top in HIDDEN:
                            ends[start] = here
                        break
        elif name in RAW and not (foreign and name in ("style", "title")):
            stop = re.compile("</" + name + r"(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = stop.end() if stop else size
        elif name in FALLBACK and not attrs.endswith("/") and name not in lost:
            stop = re.compile("<(/?)" + name + r"(?=[\s/>])[^>]*>?", re.I).search(source, at)
            if stop is None:
                lost.add(name)
            elif stop[1]:
                ends[here], at = here, stop.end()
        elif name and name not in INLINE and name not in VOID and name not in FALLBACK and not (name in HIDDEN and attrs.endswith("/")):
            foreign = name in ("svg", "math") or foreign and name not in BLOCK
            opened.append((name, here))
            count[name] += 1
    return out, ends


def parse(source: str) -> Page:
    """Nodes and text of a page. Plain inline elements belong to the node around them."""
    tag, hints, parent, own, links, label = ["#root"], [()], [-1], [0], [0], [False]
    tail: list[str] = [""]
    flow: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and their nodes
    at, hidden, linked = 0, 0, 0                    # hidden: place in the stack of the outermost hidden element, or 0

    def text(chunk: str) -> None:
        if stack[-1][0] == "head" and chunk.strip():
            close(hidden)
        if not chunk or hidden:
            return
        chunk = codec.unescape(chunk)
        node = stack[-1][1]
        flow.append((node, chunk))
        words = len(chunk.split())
        own[node] += words
        if words:
            tail[node] = chunk
        if linked:
            links[node] += words

    def close(upto: int) -> None:
        nonlocal linked, hidden
        for i in range(upto, len(stack)):
            name = stack[i][0]
            linked -= name == "a"
            if name not in INLINE and not (hidden and i >= hidden):
                flow.append((-1, ""))
        del stack[upto:]
        if upto <= hidden:
            hidden = 0

    tags, ends = _tags(source)
    while at < len(tags):
        before, end, name, attrs = tags[at]
        here, at = at, at + 1
        text(before)
        if end:
            if end == "p" and not hidden and not any(n == "p" for n, _ in stack):
                flow.append((-1, ""))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == end:
                    close(i)
                    break
                if stack[i][0] in STOPS and end in INLINE:
                    break
            continue
        if not name:
            continue
        if hidden and (name not in IN_HEAD if stack[hidden][0] == "head" else name in BLOCK or name == stack[hidden][0] and name in ("button", "select")):
            close(hidden)
        if name in HIDDEN:
            if here in ends and name != "head":
                at = ends[here] + 1
            elif name not in RAW and not attrs.endswith("/"):
                stack.append((name, stack[-1][1]))
                hidden = hidden or len(stack) - 1
            continue
        if name == "br":
            text(" ")
            continue
        if name in VOID:
            if name == "hr" and not hidden:
                flow.append((-1, ""))
            continue
        if hidden:
            stack.append((name, stack[-1][1]))
            linked += name == "a"
            continue
        if name in ("html", "body") and any(n == name for n, _ in stack):
            continue
        if name not in INLINE:
            for i in range(len(stack) - 1, 0, -1):  # what this element closes without an end tag
                open_ = stack[i][0]
                if open_ == "p" and name not in CLOSES or open_ in CLOSES.get(name, ()):
                    close(i)
                    if open_ == name or name not in CLOSES:
                        break
                elif open_ in BARRIER:
                    break
            flow.append((-1, ""))
        found = ()
        main = False
        if attrs:
            found = tuple(sorted({HINTS[w] for _, v in _CUE.findall(attrs) for w in map(str.lower, _NAME.findall(v)) if w in HINTS}))
            main = "data-main" in attrs
        if name in INLINE and not found:
            stack.append((name, stack[-1][1]))
        else:
            up = stack[-1][1]
            tag.append(name)
            hints.append(found)
            parent.append(up)
            own.append(0)
            links.append(0)
            tail.append("")
            above = "article" if tag[up] == "article" else ""
            label.append(main or (label[up] and not (set(found) - {"body"}) and TAGS.get(name) not in _TELLING and above is not None))
            stack.append((name, len(tag) - 1))
        linked += name == "a"
    every, all_links = list(own), list(links)
    for i in range(len(tag) - 1, 0, -1):
        every[parent[i]] += every[i]
        all_links[parent[i]] += all_links[i]
    features, edge = [], []
    for i, name in enumerate(tag):
        group, n, total = TAGS.get(name, "other"), own[i], every[i]
        f = [_AT[group], *(_AT[h] for h in hints[i])]
        f.append(_AT["own0" if n == 0 else "own1" if n < 6 else "own6" if n < 20 else "own20"])
        f.append(_AT["all0" if total == 0 else "all1" if total < 10 else "all10" if total < 50 else "all50" if total < 150 else "all150"])
        share = all_links[i] / total if total else 0
        f.append(_AT["links0" if share == 0 else "links1" if share < 0.3 else "links5" if share < 0.8 else "links8"])
        last = tail[i].rstrip()
        if last.endswith((".", "!", "?", '"', "…")):
            f.append(_AT["ends"])
        if "©" in tail[i] or "opyright" in tail[i]:
            f.append(_AT["copy"])
        if last.count(". ") >= 2:
            f.append(_AT["stops3"])
        features.append(f)
        edge.append(3 if "body" in hints[i] else 2 if hints[i] or group in _TELLING else 1 if group in ("div", "section", "article", "main", "list", "table") else 0)
    above = [False] * len(tag)  # what holds a labelled node is on the way to the article
    for i in range(len(tag) - 1, 0, -1):
        if label[i] or above[i]:
            above[parent[i]] = True
    return Page(parent, features, edge, flow, [a or b for a, b in zip(label, above)])


class Forest:
    """The nodes of many pages, dealt by depth."""

    def __init__(self, pages: list[Page]):
        start, self.starts = 0, []
        parent, depth, edge, node, feature = [], [], [], [], []
        for p in pages:
            self.starts.append(start)
            deep: list[int] = []
            for i, up in enumerate(p.parent):
                deep.append(0 if up < 0 else deep[up] + 1)
                parent.append(-1 if up < 0 else up + start)
                node += [start + i] * len(p.features[i])
                feature += p.features[i]
            depth += deep
            edge += p.edge
            start += len(p.parent)
        self.parent, self.edge, depth = np.array(parent, dtype=np.int64), np.array(edge, dtype=np.int64), np.array(depth, dtype=np.int64)
        self.node, self.feature, self.size = np.array(node, dtype=np.int64), np.array(feature, dtype=np.int64), start
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if start else []

    def marginals(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(node is article), and P(parent state, child state) of every node but the roots [nodes, 2, 2].

        pair: log potentials [EDGES, parent state, child state]."""
        score = np.zeros((self.size, 2))
        score[:, 1] = np.bincount(self.node, weights=weights[self.feature], minlength=self.size)
        up = np.zeros((self.size, 2))  # message to the parent, by its state
        belief = score.copy()
        for level in reversed(self.levels[1:]):
            terms = belief[level][:, None, :] + pair[self.edge[level]]
            up[level] = np.logaddexp(terms[:, :, 0], terms[:, :, 1])
            np.add.at(belief, self.parent[level], up[level])
        full = belief.copy()
        both = np.zeros((self.size, 2, 2))
        for level in self.levels[1:]:
            above = full[self.parent[level]] - up[level]  # what the parent knows without this child
            joint = above[:, :, None] + pair[self.edge[level]] + belief[level][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            p = np.exp(joint)
            both[level] = p / p.sum(axis=(1, 2), keepdims=True)
            terms = above[:, :, None] + pair[self.edge[level]]
            full[level] = belief[level] + np.logaddexp(terms[:, 0, :], terms[:, 1, :])
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500))), both


def train(pages: list[Page], rounds: int = 200, rate: float = 0.5, ridge: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and log potentials of the edges, by gradient ascent on the pages' labels."""
    forest = Forest(pages)
    truth = np.array([x for p in pages for x in p.label], dtype=float)
    weights, pair = np.zeros(len(FEATURES)), np.zeros((EDGES, 2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    state = truth.astype(int)
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (forest.edge[child], state[forest.parent[child]], state[child]), 1)
    ones = np.bincount(forest.feature, weights=truth[forest.node], minlength=len(FEATURES))
    often = np.maximum(np.bincount(forest.feature, minlength=len(FEATURES)), 20)
    often_edge = np.maximum(seen.sum(axis=(1, 2)), 20)[:, None, None]
    for _ in range(rounds):
        p, both = forest.marginals(weights, pair)
        got = np.bincount(forest.feature, weights=p[forest.node], minlength=len(FEATURES))
        held = np.zeros((EDGES, 2, 2))
        np.add.at(held, forest.edge[child], both[child])
        weights += rate * ((ones - got) / often * 4 - ridge * weights)
        pair += rate * ((seen - held) / often_edge * 4 - ridge * pair)
    return weights, pair


@functools.lru_cache(maxsize=2)
def fit(n: int = TRAINING_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Trained on `n` labelled pages, a documented bound."""
    return train([parse(p) for p in labelled_pages(n)])


def article_texts(sources: list[str], weights: np.ndarray, pair: np.ndarray) -> list[str]:
    pages = [parse(s) for s in sources]
    forest = Forest(pages)
    chance, _ = forest.marginals(weights, pair)
    out = []
    for page, start in zip(pages, forest.starts):
        inside = chance[start:start + len(page.parent)] >= 0.5
        blocks, now = [], []
        for node, chunk in page.flow:
            if node < 0:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif inside[node]:
                now.append(chunk)
        if now:
            blocks.append(" ".join("".join(now).split()))
        out.append("\n".join(b for b in blocks if b))
    return out


def extract(pages: DataFrame, weights: np.ndarray | None = None, pair: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    if weights is None:
        weights, pair = fit()
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, chars, begin = [], 0, 0
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or chars > BATCH_CHARS:
                    texts = article_texts(held, weights, pair)
                    part = batch.slice(begin, i - begin)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                                     names=["page_id", "url", "text", "n_chars"])
                    held, chars, begin = [], 0, i
                if i < batch.num_rows:
                    held.append(batch.column(2)[i].as_py() or "")
                    chars += len(held[-1])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")


@query("op2_html_extraction")
def op2_html_extraction(spark, folder):
    return extract(table(spark, folder, "pages"))
