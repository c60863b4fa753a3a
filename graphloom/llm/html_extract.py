"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A logistic classifier over a block's own text (its length,
link share, punctuation, kind of element, place in the page) gives log-odds of content,
which become the capacities to the two terminals. Elements whose tag, role or class says
what they hold (an article; a menu, notice or comment section) are nodes that markup ties to
one terminal for good; a block is joined to the one that it stands in. Blocks that follow
each other in the page or in one container are joined by smoothness edges, whose capacity
falls with their distance in the DOM. A minimum cut, found by max-flow, separates content
from boilerplate. All capacities are log-odds.

What an element says is weighed by how it says it. Menus, footers, asides and the like hold by their tag or
role. Words of a class or id, and forms, are weaker: an article or main element inside, unless it is
a mere teaser beside a larger one, overrules all but comments; on a page without an article one that
holds most of the text (a layout's wrapper, a form around the page) says nothing; names that tell what a
layout has or lacks (``has-sidebar``, ``no-ads``) say nothing either, and a name that holds such a word among
others, on a paragraph of its own, only takes away what its article says. So no word overrules an
article that stands inside or bears it.

The classifier is fitted on the blocks of a bounded sample of pages that mark their article
(``SAMPLE`` pages): blocks in it are content, all others are not. The weights that it starts
from, ``PRIOR``, are those of a Gaussian prior, and are what is used without such pages.

Defined results: null or empty html, and a page without content, give an empty text;
unclosed and stray tags are tolerated; a page cut off in the middle is read as far as it
goes, an unclosed tag, comment, script or style up to the end of the page, any other unclosed element
whose text is skipped (a button, a drawing) up to the next tag; depth has no bound, and the work
grows with a page's size; repeated rows are treated each for itself; further columns are
ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ship

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object select button textarea canvas audio video head title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p")}
SAYING = frozenset("class id role style hidden aria-hidden itemtype".split())
MAIN_TAGS = frozenset(["article", "main"])
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
MAIN_ROLES = frozenset(["main", "article"])
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())
BAD_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner
    cookie cookies consent gdpr notice newsletter subscribe subscription signup signin login register comment comments
    disqus reply replies respond sidebar rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer
    masthead toolbar share sharing social related recommended recommendations popular trending pagination pager modal
    popup overlay dialog alert toast copyright legal skip search form""".split()
)
#: Of these, words of comments, which no article inside overrules; and words of names that only tell what a layout has.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
MODIFIERS = frozenset("has have with no without not is show hide enable enabled disable disabled open closed layout free".split())
#: Elements that end with the page if they aren't closed; the text of others is skipped up to the next tag.
RAW = frozenset(["script", "style"])

#: What a block's statistics weigh before any page is seen, in order of ``_shape``.
PRIOR = np.array([-0.5, 1.0, -0.6, -3.0, 0.3, 0.8, 0.8, 0.2, -0.2, 0.0])
#: Pages that the classifier is fitted on, at most, and how firmly the prior holds.
SAMPLE, FIRMNESS = 2000, 4.0
#: Log-odds of a block are held within this, so that one block never outweighs its element.
MOST = 2.5
#: Capacities between a block and the element that says what it holds: one that says
#: boilerplate, an article, a page that has its article elsewhere, and a hopeful class.
IN_BAD, IN_MAIN, NOT_MAIN, HALF_MAIN = 6.0, 3.5, 3.2, 1.5
#: A class or id that is such a word, or holds one.
WORD_BAD, PART_BAD = 4.0, 3.5
#: Share of a page's text from which an element is the page; of the largest article, from which one is no teaser.
WIDE, TEASER = 0.6, 0.5


@dataclass
class Block:
    """A text block: its statistics, its container, and the capacity (negative to the sink)
    between it and the element that says what it holds."""

    text: str
    shape: list[float]
    container: int
    tie: float


class _Open:
    """An open element: what it inherits and adds."""

    __slots__ = ("tag", "hint", "inside", "container", "link", "leaf")

    def __init__(self, tag, hint, inside, container, link, leaf):
        self.tag, self.hint, self.inside, self.container, self.link, self.leaf = tag, hint, inside, container, link, leaf


@dataclass
class _Hint:
    """What an element says of the blocks from ``start`` to ``end``, below what ``up`` says."""

    up: int
    main: float = 0.0
    bad: float = 0.0
    firm: bool = False
    comment: bool = False
    own: bool = False
    start: int = 0
    end: int = -1


def _hints(tag: str, attributes: str, inside_main: bool) -> _Hint | None:
    """What an element's tag and attributes say, if they say anything."""
    main = 1.0 if tag in MAIN_TAGS else 0.0
    bad, firm, comment, part = 0.0, False, False, False
    if tag in ("form", "fieldset"):
        bad = WORD_BAD
    elif tag in BAD_TAGS or (tag == "header" and not inside_main):
        bad, firm = IN_BAD, True
    if attributes.strip(" /") and tag not in ("html", "body"):
        whole: set[str] = set()
        parts: set[str] = set()
        hopeful = False
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name not in SAYING:
                continue
            if name == "role":
                main = max(main, value.lower() in MAIN_ROLES)
                if value.lower() in BAD_ROLES:
                    bad, firm = IN_BAD, True
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                bad, firm = IN_BAD, True
            elif name in ("class", "id"):
                for token in value.split():
                    words = [w.lower() for w in WORD.findall(token)]
                    hopeful |= bool(MAIN_WORDS & set(words))
                    if len(words) == 1:
                        whole.add(words[0])
                    elif not MODIFIERS & set(words):
                        parts.update(words)
            elif name == "itemtype" and value.rstrip("/").endswith("Comment"):
                bad, firm, comment = IN_BAD, True, True
        if "header" in whole | parts and not inside_main:
            whole.add("banner")
        if whole & BAD_WORDS:
            bad, main = max(bad, WORD_BAD), 0.0
        elif parts & BAD_WORDS and main < 1:
            part = not bad
            bad = max(bad, PART_BAD)
        elif hopeful:
            main = max(main, 0.5)
        comment |= bad > 0 and bool((whole | parts) & COMMENT_WORDS)
    if not main and not bad:
        return None
    return _Hint(-1, main, bad, firm, comment, part and tag in LEAVES)


def _ties(hints: list[_Hint], sizes: list[int]) -> list[float]:
    """The tie of a block that stands in each element with a hint, from the outermost in."""
    upto = np.r_[0, np.cumsum(sizes)]
    held = [int(upto[len(sizes) if h.end < 0 else h.end] - upto[h.start]) for h in hints]
    largest = max((n for h, n in zip(hints, held, strict=True) if h.main >= 1), default=0)
    any_main = any(h.main >= 1 for h in hints)
    states: list[tuple[float, float, bool, bool]] = []
    ties = []
    for h, n in zip(hints, held, strict=True):
        main, bad, firm, comment = states[h.up] if h.up >= 0 else (0.0, 0.0, False, False)
        own = 0.0
        if h.main >= 1 and bad and not firm and not comment and n >= TEASER * largest:
            bad = 0.0
        main = max(main, h.main)
        wide = not any_main and not h.firm and not h.comment and n > WIDE * upto[-1]
        if h.own and not bad and main >= 1:
            own = h.bad
        elif h.bad and not wide:
            bad, firm, comment = max(bad, h.bad), firm or h.firm, comment or h.comment
        states.append((main, bad, firm, comment))
        ties.append(-bad if bad else (IN_MAIN - own) if main >= 1 else -NOT_MAIN if any_main else HALF_MAIN if main else 0.0)
    return ties


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The text blocks of a page, and the container that each container stands in."""
    hints = [_Hint(-1)]
    stack = [_Open("", 0, False, 0, False, "")]
    open_tags: Counter[str] = Counter()
    up = [0]
    found: list[tuple[str, int, _Open]] = []
    pieces: list[str] = []
    unclosed: set[str] = set()
    linked = 0
    owner = stack[0]

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append((text, linked, owner))
            pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked, owner
        if not pieces:
            if raw.isspace():
                return
            owner = stack[-1]
        text = htmllib.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if stack[-1].link:
            linked += len(text.strip())

    def shut(i: int) -> None:
        for x, outer in zip(stack[i:], stack[i - 1 :], strict=False):
            open_tags[x.tag] -= 1
            if x.hint != outer.hint:
                hints[x.hint].end = len(found)
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        end, name, attributes = m.groups()
        if name is None:
            continue
        tag = name.lower()
        if end:
            if tag not in INLINE:
                close()
            if open_tags[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                shut(i)
            continue
        if tag in SKIPPED and not attributes.endswith("/"):
            if tag == "head":  # its elements are skipped one by one
                continue
            over = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
            if over is None:
                unclosed.add(tag)  # nor will a later one be
            if over:
                at = over.end()
            elif tag in RAW:
                at = n
            else:  # its own words end with the next tag, and it holds nothing else
                after = page.find("<", at)
                at = n if after < 0 else after
            continue
        if tag == "br":
            if pieces:
                pieces.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if tag not in INLINE:
            close()
            for other in CLOSES.get(tag, ("p",) if tag not in LEAVES or tag[0] == "h" else ()):
                if open_tags[other]:
                    i = len(stack) - 1
                    while i and stack[i].tag != other and (stack[i].tag in INLINE or stack[i].tag in LEAVES):
                        i -= 1
                    if i and stack[i].tag == other:
                        shut(i)
        if attributes.endswith("/") and tag not in INLINE:
            continue
        above = stack[-1]
        said = _hints(tag, attributes, above.inside)
        if said:
            said.up, said.start = above.hint, len(found)
            hints.append(said)
        container = above.container
        if tag not in INLINE and tag not in LEAVES:
            container = len(up)
            up.append(above.container)
        open_tags[tag] += 1
        stack.append(_Open(tag, len(hints) - 1 if said else above.hint, above.inside or (said is not None and said.main >= 1), container, above.link or tag == "a", tag if tag in LEAVES else above.leaf if tag in INLINE else ""))
    close()
    ties = _ties(hints, [len(text) for text, _, _ in found])
    return [Block(text, _shape(text, links, o.leaf, i / len(found)), o.container, ties[o.hint]) for i, (text, links, o) in enumerate(found)], up


def _shape(text: str, links: int, leaf: str, place: float) -> list[float]:
    """Statistics of a block's own text: no element around it but its own is looked at."""
    words = text.count(" ") + 1
    return [
        1.0,
        min(1.5, max(-1.0, (words - 10) / 10)),
        1.0 if words < 4 else 0.0,
        1.0 if links > 0.6 * len(text) else 0.0,
        1.0 if text[-1] in ".!?\u2026\"" else 0.0,
        1.0 if leaf == "p" else 0.0,
        1.0 if leaf[:1] == "h" else 0.0,
        1.0 if leaf and leaf[0] not in "ph" else 0.0,
        1.0 if "\u00a9" in text[:80] else 0.0,
        place,
    ]


def log_odds(found: list[Block], weight: np.ndarray) -> list[float]:
    if not found:
        return []
    return np.clip(np.array([b.shape for b in found]) @ weight, -MOST, MOST).tolist()


def fit(x: np.ndarray, y: np.ndarray, count: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights of the logistic classifier for rows that stand ``count`` times: Newton steps,
    held by the prior."""
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (count * (p - y)) + FIRMNESS * (w - PRIOR)
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + FIRMNESS * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def edges_of(found: list[Block], up: list[int]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, halved for each container to climb to their
    common one, and between a block and the one before it in its container."""
    depth = [0] * len(up)
    for i in range(1, len(up)):
        depth[i] = depth[up[i]] + 1
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            x, y, climbed = found[i - 1].container, b.container, 0
            while x != y:
                if depth[x] >= depth[y]:
                    x = up[x]
                else:
                    y = up[y]
                climbed += 1
            if climbed < 24:  # beyond that less than a rounding error
                edges.append((i - 1, i, 0.6 * 0.5**climbed))
        before = last.get(b.container)
        if before is not None and before != i - 1:
            edges.append((before, i, 0.4))
        last[b.container] = i
    return edges


def minimum_cut(logit: list[float], edges: list[tuple[int, int, float]], tie: list[float] | None = None) -> list[bool]:
    """True for the nodes on the source's (content) side of a minimum cut; a tie goes to
    the sink. ``tie``: capacities to elements that are part of a terminal already."""
    n = len(logit)
    tie = tie or [0.0] * n
    flow = _MaxFlow(n + 2)
    s, t = n, n + 1
    for i, (a, b) in enumerate(zip(logit, tie, strict=True)):
        # what goes straight through the node, from one terminal to the other, is saturated
        rest = a + b
        if rest > 0:
            flow.add(s, i, rest, 0.0)
        elif rest < 0:
            flow.add(i, t, -rest, 0.0)
    for a, b, c in edges:
        flow.add(a, b, c, c)
    return flow.source_side(s, t)[:n]


class _MaxFlow:
    """Level graphs and blocking flows."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def add(self, a: int, b: int, there: float, back: float) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s] = 0
        todo = deque([s])
        while todo:
            i = todo.popleft()
            for e in self.out[i]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[i] + 1
                    todo.append(self.to[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        while (level := self.levels(s))[t] >= 0:
            step = [0] * len(self.out)
            path: list[int] = []
            i = s
            while True:
                if i == t:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path, i = [], s
                    continue
                while step[i] < len(self.out[i]):
                    e = self.out[i][step[i]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[i] + 1:
                        break
                    step[i] += 1
                if step[i] < len(self.out[i]):
                    path.append(e)
                    i = self.to[e]
                elif path:
                    i = self.to[path.pop() ^ 1]
                    step[i] += 1
                else:
                    break
        return [x >= 0 for x in level]


def label(found: list[Block], up: list[int], weight: np.ndarray) -> list[bool]:
    return minimum_cut(log_odds(found, weight), edges_of(found, up), [b.tie for b in found])


def main_text(page: str | None, weight: np.ndarray = PRIOR) -> str:
    found, up = blocks(page or "")
    return " ".join(b.text for b, k in zip(found, label(found, up, weight), strict=True) if k)


def train(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted on the blocks of about ``sample`` pages, chosen by the hash of their id;
    only sums over equal statistics reach the driver."""
    ship(pages.sparkSession)
    share = sample / max(1, pages.count())
    picked = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.col("html").cast("string").alias("html")) if share < 1 else pages.select(F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column("html"):
                found, _ = blocks(x.as_py() or "")
                if any(f.tie == IN_MAIN for f in found):
                    rows += [([round(v, 1) for v in f.shape], int(f.tie == IN_MAIN)) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.int32())], ["x", "y"])

    sums = picked.mapInArrow(run, "x array<double>, y int").groupBy("x", "y").count().collect()
    if len({r.y for r in sums}) < 2:
        return PRIOR
    sums.sort(key=lambda r: (r.x, r.y))
    total = sum(r["count"] for r in sums)
    return fit(np.array([r.x for r in sums]), np.array([r.y for r in sums], float), np.array([r["count"] for r in sums]) * (min(total, 1000) / total))


def extract(pages: DataFrame, weight: np.ndarray | None = None) -> DataFrame:
    """``page_id, url, text`` of every row; without ``weight`` the classifier is fitted first."""
    ship(pages.sparkSession)
    weight = train(pages) if weight is None else weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                text = pa.array([main_text(x.as_py(), weight) for x in part.column("html")], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), text], ["page_id", "url", "text"])

    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cut.mapInArrow(run, "page_id long, url string, text string")
