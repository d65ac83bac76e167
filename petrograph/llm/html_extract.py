"""Main text of web pages by a tree-structured graphical model.

Every element of a page's tree is a binary variable, content or not.  Its own potential comes from
its tag, the words of its class, id and role, the kinds of its ancestors, the length of its text,
the share of it in links, its sentence ends and whether a heading came before; each parent and child share a potential for agreeing, one for each
kind of child.  Sum-product messages go up the tree and down again and give each element's exact
marginal; text whose element is more likely content than not is kept.

The weights are trained by gradient ascent on the conditional likelihood of labelled pages (the same
messages give the expected counts); the number of pages is fixed, see html_pages.

Blocks: text between the tags of block elements; white space runs become one space, blocks are
trimmed and joined by a line feed, empty ones dropped.  Head, scripts, styles, templates, form
controls, drawings and other unseen elements hold no text; formulas do, but not their annotations, which aren't shown.

Defined cases: null or empty html has an empty text; unclosed and stray tags are repaired as browsers
do for the common cases; depth, length and number of elements are not limited; repeated rows are
extracted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrograph.llm.common import batch, columns
from petrograph.llm.html_pages import labelled_pages

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template svg annotation annotation-xml iframe object canvas audio "
                   "video select option textarea button datalist".split())
#: What a head may hold; any other start tag closes an open head.
IN_HEAD = frozenset("title meta link style script base noscript noframes template".split())
#: Drawings and formulas, in which "/>" closes an element at once, and those of their elements that hold HTML again.
FOREIGN = frozenset("svg math".split())
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: An open p outside these isn't closed by a block inside.
HOLDS_P = HOLDS_HTML | {"table", "button", "object", "td", "th", "caption"}
#: HTML's own tags that close a drawing or formula.
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li "
                       "listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul "
                       "var".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre "
                   "search section summary table caption tbody thead tfoot tr td th ul".split())
#: A start tag closes these open elements, up to the ones that bound the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set())}

_TOKEN = re.compile(r"[a-z]+")
_ENDS = re.compile(r"[.!?…。！？](?=\s|$)")
_MARKED = ("class", "id", "role", "itemprop")
#: Words of class, id and role, by what they stand for.
HINTS = {w: kind for kind, ws in {
    "advert": "ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar tabs pagination pager topbar",
    "edge": "header footer masthead copyright contentinfo colophon banner",
    "side": "sidebar side aside widget widgets related recommended complementary rail",
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert privacy banner subscribe newsletter signup",
    "reply": "comment comments reply replies disqus discussion respond responses remarks remark feedback thread",
    "share": "share sharing social follow",
    "form": "form search login",
    "main": "article content main post entry story body text",
}.items() for w in ws.split()}
PASSED = frozenset("nav header footer aside form article main a".split())
TAGS = frozenset("article main section div nav header footer aside form p span h1 h2 h3 ul ol li a table td blockquote "
                 "pre body html b i label".split())


class Tree(HTMLParser):
    """Elements in page order (parents first), and the text and block breaks between them."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.attrs = ["#root"], [-1], [{}]
        self.text: list[tuple[int, str] | None] = []   # (element, text), or None for a block break
        self.stack, self.open = [0], ["#root"]         # open elements and their tags
        self.depths: dict[str, list[int]] = {}         # where in the stack each tag is open, outermost first
        self.unseen = self.foreign = 0
        self.feed(html)
        self.close()

    def pop(self, depth: int) -> None:
        """Close open elements down to this depth."""
        while len(self.stack) > depth:
            tag = self.open.pop()
            self.stack.pop()
            self.depths[tag].pop()
            self.unseen -= tag in UNSEEN
            self.foreign -= tag in FOREIGN
            if tag in BLOCKS:
                self.text.append(None)

    def find(self, tags: set | frozenset, bounds: set | frozenset = frozenset()) -> int:
        """Depth of the innermost open element with one of the tags; 0 if a bound comes first.

        Looks at each tag's last place, so it takes the same time however deep the page is.
        """
        found = max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)
        return found if all(not self.depths.get(t) or self.depths[t][-1] < found for t in bounds - tags) else 0

    def in_foreign(self) -> int:
        """Depth of the drawing or formula that the next tag belongs to; 0 if it is HTML."""
        return self.find(FOREIGN, HOLDS_HTML) if self.foreign else 0

    def end_head(self) -> None:
        if self.open[-1] == "head":
            self.pop(len(self.stack) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self.end_head()
        while tag in BREAKS_OUT and (depth := self.in_foreign()):
            self.pop(depth)
        if tag in VOID:
            if not self.unseen:
                self.text.append(None if tag == "hr" else (self.stack[-1], " "))
            return
        if tag in CLOSES:
            tags, bounds = CLOSES[tag]
            while depth := self.find(tags, bounds):
                self.pop(depth)
        if tag in BLOCKS and (depth := self.find({"p"}, HOLDS_P)):
            self.pop(depth)
        if tag in BLOCKS:
            self.text.append(None)
        if tag == "math" or self.open[self.in_foreign()] == "math":
            self.stack.append(self.stack[-1])          # a formula is part of the element around it
        else:
            self.tags.append(tag)
            self.parents.append(self.stack[-1])
            self.attrs.append(dict(attrs))
            self.stack.append(len(self.tags) - 1)
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append(tag)
        self.unseen += tag in UNSEEN
        self.foreign += tag in FOREIGN

    def handle_startendtag(self, tag, attrs):
        at_once = tag in FOREIGN or tag not in VOID | BREAKS_OUT and self.in_foreign()
        self.handle_starttag(tag, attrs)
        if at_once:
            self.pop(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag(tag, [])
        elif depth := self.find({tag}):
            self.pop(depth)

    def handle_data(self, data):
        if data.strip("\t\n\f\r "):
            self.end_head()
        if not self.unseen:
            self.text.append((self.stack[-1], data))


def remembered(limit: int):
    """Remember a function's results; forget all when ``limit`` are held."""
    def deco(f):
        held: dict = {}

        def call(*key):
            out = held.get(key)
            if out is None:
                if len(held) >= limit:
                    held.clear()
                out = held[key] = f(*key)
            return out
        return call
    return deco


@remembered(20_000)
def hints(words: str) -> frozenset:
    """What the words of class, id and role stand for."""
    return frozenset(HINTS[w] for w in _TOKEN.findall(words.lower()) if w in HINTS)


@remembered(20_000)
def passed_on(tag: str, marks: frozenset, around: frozenset) -> frozenset:
    """The kinds of ancestor that an element's children have."""
    here = around | {m for m in marks if not (m == "main" and around)}
    return here | {tag} if tag in PASSED else here


@remembered(100_000)
def names(tag: str, marks: frozenset, around: frozenset, size: int, links: int, ends: int, place: str) -> tuple[str, ...]:
    """The names of the features of an element."""
    return ("bias", "tag:" + (tag if tag in TAGS else "other"), *("hint:" + m for m in sorted(marks)),
            *("in:" + a for a in sorted(around)), *("mute in:" + a for a in sorted(around) if not ends), f"size:{size}", f"links:{links}", f"ends:{ends}", place)


def features(tree: Tree) -> list[tuple[str, ...]]:
    """The names of each element's features."""
    n = len(tree.tags)
    total, linked, ends = [0] * n, [0] * n, [0] * n
    for piece in tree.text:
        if piece:
            total[piece[0]] += len(piece[1])
            ends[piece[0]] += len(_ENDS.findall(piece[1]))
    # Before, among or after the page's headings; without any heading, nowhere.
    first = next((i for i, t in enumerate(tree.tags) if t in ("h1", "h2")), n)
    tags, parents = tree.tags, tree.parents
    for i in range(n - 1, 0, -1):
        if tags[i] == "a":
            linked[i] = total[i]
        total[parents[i]] += total[i]
        linked[parents[i]] += linked[i]
        ends[parents[i]] += ends[i]
    out, above, none = [], [frozenset()] * n, frozenset()
    for i, tag in enumerate(tags):
        attrs = tree.attrs[i]
        marks = hints(" ".join([attrs.get(k) or "" for k in _MARKED])) if attrs else none
        around = above[parents[i]] if i else none
        out.append(names(tag, marks, around, min((total[i] // 8 + 1).bit_length() - 1, 8),
                         4 * linked[i] // total[i] if total[i] else -1, min(ends[i], 3).bit_length(),
                         "place:none" if first == n else "place:before" if i < first else "place:after"))
        above[i] = passed_on(tag, marks, around)
    return out


@remembered(1_000)
def kind(tag: str) -> str:
    """Kinds of child, each with an agreement potential of its own."""
    if tag in ("article", "main", "section", "nav", "header", "footer", "aside", "form", "body", "html"):
        return "agree:part"
    return "agree:box" if tag in ("div", "ul", "ol", "table", "dl") else \
        "agree:block" if tag in BLOCKS else "agree:inline"


def _log_sum(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


def marginals(tree: Tree, weights: dict[str, float], feats: list[tuple[str, ...]], pairs: bool = False
              ) -> tuple[list[float], list[float]]:
    """P(content) of each element, and if asked P(agrees with its parent), by messages up and then down."""
    n = len(tree.tags)
    sums: dict[tuple, float] = {}
    for fs in feats:
        if fs not in sums:
            sums[fs] = sum(weights.get(f, 0.0) for f in fs)
    unary = [sums[fs] for fs in feats]
    agree = [weights.get(kind(t), 0.0) for t in tree.tags]
    on, off = unary[:], [0.0] * n                    # sums of own potential and the children's messages
    up = [(0.0, 0.0)] * n                             # message to the parent being (content, not)
    for i in range(n - 1, 0, -1):
        to_on, to_off = _log_sum(on[i] + agree[i], off[i]), _log_sum(on[i], off[i] + agree[i])
        up[i] = to_on, to_off
        on[tree.parents[i]] += to_on
        off[tree.parents[i]] += to_off
    probability, same = [0.0] * n, [0.0] * n
    full_on, full_off = on[:], off[:]
    for i in range(n):
        if i:
            p = tree.parents[i]
            rest_on, rest_off = full_on[p] - up[i][0], full_off[p] - up[i][1]   # the parent without this child
            if pairs:
                both = _log_sum(on[i] + agree[i] + rest_on, off[i] + agree[i] + rest_off)
                apart = _log_sum(on[i] + rest_off, off[i] + rest_on)
                same[i] = exp(both - _log_sum(both, apart))
            full_on[i] += _log_sum(agree[i] + rest_on, rest_off)
            full_off[i] += _log_sum(rest_on, agree[i] + rest_off)
        shift = full_on[i] - full_off[i]
        probability[i] = 1 / (1 + exp(-shift)) if shift > -700 else 0.0
    return probability, same


def labels(tree: Tree) -> list[bool]:
    """Elements below data-main and not below data-not."""
    out = [False] * len(tree.tags)
    for i in range(1, len(out)):
        out[i] = (out[tree.parents[i]] or "data-main" in tree.attrs[i]) and "data-not" not in tree.attrs[i]
    return out


def train(pages: list[str], rounds: int = 150, rate: float = 0.3, shrink: float = 0.003) -> dict[str, float]:
    """Weights that make the labels of the pages likely (gradient ascent, each step scaled by its history)."""
    trees = [Tree(p) for p in pages]
    ready = [(t, features(t), labels(t)) for t in trees]
    weights: dict[str, float] = {}
    history: dict[str, float] = {}
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for tree, feats, truth in ready:
            probability, same = marginals(tree, weights, feats, pairs=True)
            for i, fs in enumerate(feats):
                gap = truth[i] - probability[i]
                for f in fs:
                    slope[f] = slope.get(f, 0.0) + gap
                if i:
                    k = kind(tree.tags[i])
                    slope[k] = slope.get(k, 0.0) + (truth[i] == truth[tree.parents[i]]) - same[i]
        for f, g in sorted(slope.items()):
            g = g / len(ready) - shrink * weights.get(f, 0.0)
            history[f] = history.get(f, 0.0) + g * g
            weights[f] = weights.get(f, 0.0) + rate * g / math.sqrt(history[f] + 1e-9)
    return weights


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The kept blocks of a page, joined by line feeds."""
    if not html:
        return ""
    tree = Tree(html)
    probability, _ = marginals(tree, weights, features(tree))
    blocks, now = [], []
    for piece in [*tree.text, None]:
        if piece is None:
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        elif probability[piece[0]] > 0.5:
            now.append(piece[1])
    return "\n".join(b for b in blocks if b)


def extracted(pages: DataFrame, training: list[str] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = train(training if training is not None else labelled_pages())
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, pages_ = columns(b, "page_id", "url", "html")
            texts = [main_text(h, weights) for h in pages_]
            yield batch(out, [ids, urls, texts, [len(t) for t in texts]])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")) \
        .mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
