"""Main text of web pages by minimum-cut labelling.

A page is tokenised into blocks of text (runs between block-level tags).  A logistic classifier
over structural features (tags and class names above the block, link density, words, sentence
signs, calls to act, place) gives each block a cost of being content and one of being boilerplate;
these are the capacities of its terminal edges.  Every block is a node: neighbouring blocks and
successive blocks of one container are joined by smoothness edges.  The source side of the minimum
cut is the content.  Where the cut leaves nothing of a page, blocks get cheaper as content in three
steps, until a cut leaves something.

The cut is found exactly: a node whose terminal edges outweigh its other edges lies on their side in
every minimum cut, so it is contracted into its terminal, again and again; what is left is cut by
Dinic's algorithm, component by component.

The classifier is fitted to the pages themselves.  No table labels blocks, so other evidence does: on
pages with an article or main element, blocks in it are content unless a bad class name or a settling
container speaks against it; blocks outside are boilerplate.  Texts that several
pages share are no evidence: short sentences and licence lines of articles are such.  Each block is learned
from as it stands and with its landmarks hidden, so that its text tells on pages without any; badly named blocks also
as if inside an article.  The fit is the mode under a normal prior about ``PRIOR``, to the blocks of
the ``MAX_TRAIN`` page_ids of smallest hash; without landmarks in these it is the prior.

Containers whose tag settles the matter (nav, script, form and so on) are terminals of infinite
capacity.  Neither these nor bad names count where they are or hold the page's article (of its landmarks
that with the most sentences, main first), or without one more than half of its sentences: such are
wrappers, or tags that were never closed.  White space inside a block becomes one space, character references are decoded, blocks
are joined by a newline.

Defined cases: a null or empty html gives the empty text; unclosed tags end with the page or their
container, and settle nothing if they swallow the article; a ``<`` that opens no tag is text; a cut-off tag at the end is dropped; text outside any
container is judged by the classifier; a very long page costs time in proportion to its blocks, but
for long runs of undecided ones; repeated rows are each extracted; an empty table gives no rows; extra
columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from math import log1p
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import modest, table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_RAW = frozenset(["script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "object", "canvas", "audio", "video", "xmp"])
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"])
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_BOILER = frozenset(["nav", "footer", "aside", "form", "button", "menu", "dialog", "head"])
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure figcaption details".split())
_SELF = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_SIGN = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|nav\w*|menu\w*|breadcrumb\w*|sidebar|side|widget\w*|related|recommend\w*|share\w*|social|follow|footer|header|masthead|copyright|legal|disclaimer|comment\w*|disqus|respond|replies|reply|pagination|pager|toolbar|tags|search\w*|form)(?=$|[\s_-])",
    re.I,
)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body|text|prose)(?=$|[\s_-])", re.I)
#: Short blocks that call to act, mark adverts or introduce a reader's comment.
_CALL = re.compile(
    r"^(?:advert\w*|anzeige|publicité|publicidad|sponsored|promoted|ad)\b\s*(?:[:.\-–|]|$)|^[\w.]+(?: \w+)? (?:says|said|wrote|replied|schrieb|sagt|a écrit|dijo)\s*:"
    r"|\b(?:sign up|subscribe|newsletter|log ?in|sign in|register now|follow us|share this|share on|click here|read more|read also|related (?:articles|posts|stories)|you may also like|accept (?:all )?cookies|uses? cookies|cookie policy|privacy policy|terms of (?:use|service)|leave a (?:comment|reply)|post a comment|\d+ comments?|abonnieren|jetzt anmelden|mehr lesen|inscrivez-vous|abonnez-vous|lire aussi|suscríbete|leer más)\b",
    re.I,
)
#: A sentence of a text may well hold such words: in sentences and in articles they must begin the block, as a call does.
_CALL_FIRST = re.compile(
    r"^(?:advert\w*|anzeige|publicité|publicidad|sponsored|promoted)\b\s*(?:[:.\-–|]|$)|^[\w.]+(?: \w+)? (?:says|wrote|replied|schrieb|sagt|a écrit|dijo)\s*:"
    r"|^(?:please )?(?:sign up|subscribe (?:to|now|today|here|for)|log ?in|sign in|register now|follow us|share (?:this|on)|click here|read more|read also|related (?:articles|posts|stories)|you may also like|accept (?:all )?cookies|we use cookies|(?:we|this (?:web)?site|our (?:web)?site|by (?:using|continuing))\b.*\b(?:cookies?|privacy policy|terms of (?:use|service))|leave a (?:comment|reply)|post a comment|\d+ comments?$|abonnieren|jetzt anmelden|mehr lesen|inscrivez-vous|abonnez-vous|lire aussi|suscríbete|leer más)\b",
    re.I,
)
CALL_WORDS = 15
#: Words from which a block counts as sentences; a landmark with less than this share of the sentences that nothing speaks against is a teaser.
SENTENCE_WORDS, TEASER = 5, 0.2
_ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_ROLE = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"])
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
INFINITE = 1e9

#: Prior means of the weights: bias; the page has landmarks; in an article or main element; under a
#: good class name; under a bad one; share of linked characters outside articles; log of words; ends
#: like a sentence; heading; list item; copyright sign outside articles; short call to act; table cell.
PRIOR = {"bias": -1.2, "landmarks": -2.5, "article": 6.5, "good": 1.5, "bad": -6.0, "link": -3.5, "words": 0.55, "sentence": 0.6, "heading": 0.6, "item": -0.5, "copyright": -2.5, "call": -7.0, "cell": 0.6}
NAMES = tuple(PRIOR)
_PRIOR = tuple(PRIOR.values())
MAX_TRAIN = 2000
#: Blocks that the sample counts as, against a prior of variance 1.
EVIDENCE = 1000.0
ADJACENT, SIBLING = 0.6, 0.4
#: What blocks of a page without content become cheaper by, in turn.
CHEAPER = (1.0, 2.0, 3.0)


class Block:
    __slots__ = ("text", "linked", "parent", "article", "good", "bad", "banned", "heading", "item", "cell", "call", "marks")

    def __init__(self, text, linked, parent, marks, heading, item, cell):
        self.text, self.linked, self.parent, self.marks = text, linked, parent, marks
        self.heading, self.item, self.cell = heading, item, cell

    def judge(self, article, good, bad, banned):
        self.article, self.good, self.bad, self.banned = article, good, bad, banned
        sentence = self.text[-1] in ".!?…" and self.text.count(" ") >= 3
        call = _CALL_FIRST if article or sentence else _CALL
        self.call = not self.heading and len(self.text) < 8 * CALL_WORDS and self.text.count(" ") < CALL_WORDS and bool(call.search(self.text))


class Marks:
    """What an element's tag and names say, below what its ancestors' do."""

    __slots__ = ("above", "article", "main", "good", "bad", "banned", "header", "sentences", "below")

    def __init__(self, above):
        self.above = above
        self.article = self.main = self.good = self.bad = self.banned = self.header = False
        self.sentences = 0


def _marks(tag: str, attrs: str, above: Marks, kept: list[Marks]) -> Marks:
    """The marks in force below an element; its own are kept in order of the page."""
    m = Marks(above)
    m.banned, m.header, m.main = tag in _BOILER, tag == "header", tag == "main"
    m.article = m.main or tag == "article"
    if attrs and tag not in ("html", "body"):
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                # a name with signs of both kinds tells nothing
                signs = {(bool(_GOOD.search(x)), bool(_SIGN.search(x))) for x in value.split()}
                m.bad = m.bad or (False, True) in signs
                m.good = m.good or (True, False) in signs
            elif name == "role":
                m.banned = m.banned or value.lower() in _ROLE
                m.main = m.main or value.lower() == "main"
                m.article = m.article or value.lower() in ("main", "article")
            elif (name == "hidden" and "hidden" in attrs) or (name == "style" and _HIDDEN.search(value)):
                m.banned = True
    if not (m.article or m.good or m.bad or m.banned or m.header):
        return above
    kept.append(m)
    return m


def _judge(bs: list[Block], root: Marks, kept: list[Marks]) -> None:
    """Settles what the marks say of each block."""
    size = [len(b.text) - b.linked if b.text.count(" ") >= SENTENCE_WORDS - 1 else 0 for b in bs]
    for b, n in zip(bs, size):
        b.marks.sentences += n
    root.below = root.bad = root.banned = False
    for m in kept:  # whether anything speaks against it, of which nothing is void yet
        m.below = m.bad or m.banned or m.above.below
    clean = sum(n for b, n in zip(bs, size) if not b.marks.below)
    for m in reversed(kept):
        m.above.sentences += m.sentences
    article = max((m for m in kept if m.article), key=lambda m: (m.main and m.sentences > 0, m.sentences), default=None)
    if article and article.sentences < TEASER * clean:
        article = None
    chain, m = set(), article
    while m:
        chain.add(id(m))
        m = m.above
    says: dict[int, tuple[bool, bool, bool, bool]] = {id(root): (False, False, False, False)}
    for m in kept:
        a, good, bad, banned = says[id(m.above)]
        void = id(m) in chain if article else 2 * m.sentences > root.sentences
        a = a or (m.article and (article is not None or not clean))
        says[id(m)] = a, good or m.good, bad or (m.bad and not void), banned or ((m.banned or (m.header and not a)) and not void)
    for b in bs:
        b.judge(*says[id(b.marks)])


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    root, kept = Marks(None), []
    stack: list[tuple[str, int, Marks]] = [("", 0, root)]
    parts: list[str] = []
    opened: Counter = Counter()
    linked, in_link, number, at, n = 0, 0, 0, 0, len(html)

    def cut(k: int) -> None:
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                tags = [s[0] for s in stack[-4:]]
                heading = any(len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in tags)
                parent = next((s[1] for s in reversed(stack) if s[0] not in _INLINE and s[0] not in ("p", "li")), 0)
                out.append(Block(text, linked, parent, stack[-1][2], heading, "li" in tags, "td" in tags or "th" in tags))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(text)

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        m = _TAG.match(html, lt)
        if not m:
            if lt == n - 1 or html[lt + 1] in "/":
                at = html.find(">", lt) + 1 or n
            else:
                add("<")
                at = lt + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in _RAW and not closing:
            if attrs.rstrip().endswith("/") and tag in ("svg", "math", "iframe"):
                continue
            if tag not in ("noscript",):
                flush()
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag not in _INLINE:
            flush()
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    if any(s[0] == "a" for s in stack[k + 1 :]):
                        in_link = 0
                    cut(k)
                    break
                if tag in _INLINE and stack[k][0] not in _INLINE:
                    break
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in _CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    cut(k)
                    in_link = 0
                    break
                if stack[k][0] not in _INLINE:
                    break
        if tag in _SELF:
            same, stop = _SELF[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in same.split():
                    cut(k)
                    in_link = 0
                    break
                if stack[k][0] in stop:
                    break
        if tag == "a":
            in_link += 1
        if attrs.rstrip().endswith("/") and tag not in _CLOSES_P:
            continue
        number += 1
        opened[tag] += 1
        stack.append((tag, number, _marks(tag, attrs, stack[-1][2], kept)))
    flush()
    _judge(out, root, kept)
    return out


def features(b: Block, landmarks: bool, article: bool, good: bool, bad: bool) -> tuple[float, ...]:
    """The values of ``NAMES`` for a block whose landmarks are given (as they are, or hidden).

    Shares are in tenths and logs of words in halves, so that equal blocks are counted together."""
    text = b.text
    link = 0.0 if article else round(10 * min(1.0, b.linked / max(len(text), 1))) / 10
    words = round(2 * log1p(text.count(" ") + 1)) / 2
    sign = not article and ("©" in text or "all rights reserved" in text.lower())
    return (1.0, float(landmarks), float(article), float(good), float(bad), link, words, float(text[-1] in ".!?…。！？\"”»"), float(b.heading), float(b.item), float(sign), float(b.call), float(b.cell))


def examples(bs: list[Block]) -> Iterator[tuple[float, ...]]:
    """(label, features...) of the blocks of a page that has landmarks."""
    if not any(b.article for b in bs):
        return
    for b in bs:
        content = float(b.article and not (b.bad or b.banned))
        yield content, *features(b, True, b.article, b.good, b.bad)
        yield content, *features(b, False, False, False, False)
        if b.bad:
            yield 0.0, *features(b, True, True, b.good, True)


def fit(counts: dict[tuple[float, ...], int]) -> tuple[float, ...]:
    """Weights of ``NAMES`` from counted examples, by Newton's method."""
    prior = np.array(_PRIOR)
    if not counts:
        return _PRIOR
    rows, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)], float)
    y, x, n = rows[:, 0], rows[:, 1:], n * EVIDENCE / n.sum()
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (p - y)) + (w - prior))
        size = float(np.abs(step).max())
        w -= step / max(1.0, size)  # at most 1 a round, so no step overshoots
        if size < 1e-9:
            break
    return tuple(w.tolist())


def train(pages: DataFrame) -> tuple[float, ...]:
    """Weights fitted to the pages of smallest hashed id; what comes to the driver is a count for
    each distinct row of features, of which there are few."""
    key = F.xxhash64(F.col("page_id").cast("bigint"))
    ids = pages.where("page_id is not null").select(key.alias("key")).distinct().orderBy("key").limit(MAX_TRAIN)
    last = ids.agg(F.max("key")).first()[0]
    if last is None:
        return _PRIOR

    sample = pages.where((key <= last) & F.col("page_id").isNotNull() & F.col("html").isNotNull()).select(F.col("html").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for k in range(batch.num_rows):
                seen.update(examples(blocks(batch.column(0)[k].as_py())))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.float64())), pa.array(list(seen.values()), pa.int64())], ["example", "n"])

    found = sample.mapInArrow(run, "example array<double>, n bigint").groupBy("example").agg(F.sum("n").alias("n"))
    return fit({tuple(r.example): r.n for r in found.collect()})


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source side of a minimum cut (ties go to the sink)."""
    n = len(source)
    graph: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        graph[a][b] = graph[a].get(b, 0) + c
        graph[b][a] = graph[b].get(a, 0) + c
    # What flows straight through a node leaves one terminal edge; where it outweighs the node's
    # other edges, the node is decided and its edges become terminal edges of its neighbours.
    pull = [a - z for a, z in zip(source, sink)]
    side: list[bool | None] = [None] * n
    weight = [sum(g.values()) for g in graph]
    queue = deque(range(n))
    while queue:
        v = queue.popleft()
        if side[v] is not None or -weight[v] < pull[v] <= weight[v]:
            continue
        side[v] = pull[v] > 0
        for u, c in graph[v].items():
            del graph[u][v]
            pull[u] += c if side[v] else -c
            weight[u] -= c
            queue.append(u)
        graph[v] = {}
    for v in range(n):
        if side[v] is None:
            _cut_component(v, graph, pull, side)
    return side


def _cut_component(start: int, graph: list[dict[int, float]], pull: list[float], side: list[bool | None]) -> None:
    """Dinic's algorithm over the undecided nodes that ``start`` reaches."""
    nodes, stack = {start}, [start]
    while stack:
        for u in graph[stack.pop()]:
            if u not in nodes:
                nodes.add(u)
                stack.append(u)
    left = {v: max(pull[v], 0.0) for v in nodes}
    right = {v: max(-pull[v], 0.0) for v in nodes}
    while True:
        level = {v: 0 for v in nodes if left[v] > 1e-12}
        queue, open_ = deque(level), False
        while queue:
            v = queue.popleft()
            open_ = open_ or right[v] > 1e-12
            for u, c in graph[v].items():
                if c > 1e-12 and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if not open_:
            for v in nodes:
                side[v] = v in level
            return
        ways = {v: list(graph[v]) for v in level}
        for root in [v for v in level if level[v] == 0]:
            while left[root] > 1e-12:  # a path to a node with room, by steps of one level
                path, v = [], root
                while right[v] <= 1e-12:
                    while ways[v] and not (graph[v][ways[v][-1]] > 1e-12 and level.get(ways[v][-1], -1) == level[v] + 1):
                        ways[v].pop()
                    if ways[v]:
                        path.append(v)
                        v = ways[v][-1]
                    elif path:
                        v = path.pop()
                        ways[v].pop()
                    else:
                        break
                if right[v] <= 1e-12:
                    break
                steps = list(zip(path, [*path[1:], v]))
                f = min([left[root], right[v], *(graph[a][b] for a, b in steps)])
                left[root] -= f
                right[v] -= f
                for a, b in steps:
                    graph[a][b] -= f
                    graph[b][a] += f


def label(bs: list[Block], weights: tuple[float, ...] = _PRIOR) -> list[bool]:
    """Content or not, for each block."""
    landmarks = any(b.article for b in bs)
    scores, edges = [], []
    last: dict[int, int] = {}
    for k, b in enumerate(bs):
        scores.append(-INFINITE if b.banned else sum(map(mul, weights, features(b, landmarks, b.article, b.good, b.bad))))
        if k:
            edges.append((k - 1, k, ADJACENT))
        if b.parent in last:
            edges.append((last[b.parent], k, SIBLING))
        last[b.parent] = k
    side = [False] * len(bs)
    for cheaper in (0.0, *CHEAPER):
        side = min_cut([max(s + cheaper, 0.0) for s in scores], [max(-s - cheaper, 0.0) for s in scores], edges)
        if any(side):
            break
    return side


def main_text(html: str | None, weights: tuple[float, ...] = _PRIOR) -> str:
    if not html:
        return ""
    bs = blocks(html)
    return "\n".join(b.text for b, keep in zip(bs, label(bs, weights)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    modest(pages.sparkSession)
    weights = train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(h, weights) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
