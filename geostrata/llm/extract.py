"""Main-text extraction by a minimum cut over a page's text blocks.

A page is cut into blocks of text with what is known of each: its tag, its length, its share of linked characters, and what the
enclosing elements are: their names, and the words of their class, id, role and itemprop. All of these are features of a logistic
classifier, which turns them into the costs of calling a block content or boilerplate; the costs are the capacities of its edges
to the two terminals. Edges of smoothness run between neighbouring blocks, weaker where another region of the page begins, and
between successive children of one element, the weaker the further apart. The minimum cut is the cheapest labelling of the whole
page. Its network is reduced node by node: one with at most two neighbours is replaced by the edge and the terminal capacities
that let exactly the same flow pass. Blocks in order and children in elements never cross, so that takes whole pages apart in time
in proportion to their blocks; a core that stays (from other graphs) is cut by augmenting paths.

The classifier is trained here: on made-up lessons, pages of a fixed seed whose blocks are labelled as they are made, and on blocks
of a bounded sample of the pages themselves that stand directly in an element whose name says what they are. No word decides by
itself: a class name weighs what the lessons teach about it, and less where it is a part of a longer name.

Defined results: null and empty html give an empty text. Unclosed comments, scripts and tags end with the page; a quoted value
without an end ends at its tag's first ``>``. Rows repeated give rows repeated; null ids and urls are kept. A page of any length is
held by one task and takes time in proportion to its length. Other columns of the input are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import only, slices

#: Pages that the classifier is fitted on besides the lessons, about, and blocks taken of one page for it.
SAMPLE, SAMPLE_BLOCKS = 500, 200
#: Made-up pages that the classifier is fitted on.
LESSONS, SEED = 400, 20240302
NEAR, SIBLING = 0.6, 0.4

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW = frozenset("script style noscript template iframe svg title textarea select".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?![a-z0-9:-])[^>]*>?", re.I | re.A) for tag in _RAW}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SELF_CLOSED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words in names of elements: of the main text, of boilerplate, of readers' comments, and such as say nothing.
_BODY_WORDS = frozenset("article articlebody main post entry story content".split())
_BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs consent contentinfo cookie cookies footer form header masthead menu modal nav navbar navigation "
    "newsletter notice notification popup promo promoted related search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget complementary "
    "alert gdpr login onetrust adsbygoogle dfp gpt taboola outbrain anzeige anzeigen werbung reklame publicite publicidad pubblicita datenschutz".split()
)
_TALK_WORDS = frozenset("comment comments disqus discussion reader replies reply respond kommentar kommentare commentaire commentaires comentario comentarios commenti opinions".split())
_PLAIN_WORDS = frozenset("area bar block bottom box button buttons class col column container group info inner item items left links list section site top global page primary right row secondary text thread wrap wrapper".split())
#: What an enclosing element can be. The last three: a class that is nothing but such words, one that has such a word beside others, readers' comments.
_MARKS = ["body", "nav", "footer", "header", "aside", "form", "whole", "part", "talk"]
_BIT = {name: 1 << i for i, name in enumerate(_MARKS)}
_MARK_OF_TAG = {"article": "body", "main": "body", "nav": "nav", "menu": "nav", "footer": "footer", "header": "header", "aside": "aside", "form": "form", "dialog": "form", "button": "form", "fieldset": "form"}
_TAGS = ["p", "li", "h", "td", "div"]
_TEXT = 8 + len(_TAGS)
N_FEATURES = _TEXT + 2 * len(_MARKS) + 7


class Block:
    __slots__ = ("text", "linked", "tag", "near", "outer", "region", "parent")

    def __init__(self, text, linked, tag, near, outer, region, parent):
        self.text, self.linked, self.tag, self.near, self.outer, self.region, self.parent = text, linked, tag, near, outer, region, parent


def _marks(tag: str, attributes: str) -> int:
    """What an element is, by its name and the words of its attributes: a set of bits of _MARKS."""
    out = _BIT[_MARK_OF_TAG[tag]] if tag in _MARK_OF_TAG else 0
    if "=" in attributes and tag not in ("html", "body"):
        for m in _NAMED.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").split():
                words = {w.lower() for w in _WORDS.findall(name)}
                if words & _TALK_WORDS:
                    out |= _BIT["talk" if words <= _TALK_WORDS | _BOILER_WORDS | _PLAIN_WORDS else "part"]
                elif words & _BOILER_WORDS:
                    out |= _BIT["whole" if words <= _BOILER_WORDS | _PLAIN_WORDS else "part"]
                elif words & _BODY_WORDS:
                    out |= _BIT["body"]
    # a reader's comment that is an article of its own is a comment
    return out & ~_BIT["body"] if out & (_BIT["talk"] | _BIT["whole"]) else out


_VALUES = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
_NOT_SHOWN = re.compile(r"(?<![\w-])style\s*=\s*(?:\"[^\"]*|'[^']*|[^\s>]*)display\s*:\s*none", re.I)


def _unseen(attributes: str) -> bool:
    """Whether an element says that it isn't shown."""
    return ("hidden" in attributes.lower() and bool(_HIDDEN.search(_VALUES.sub("", attributes)))) or ("none" in attributes and bool(_NOT_SHOWN.search(attributes)))


def _tag_end(page: str, at: int, closed: dict[str, int]) -> int:
    """Where the tag that goes on at ``at`` ends (its ``>``), or -1. Quotes count after an equals sign only; a quoted value
    that runs into another tag is taken as unclosed. ``closed`` remembers which quotes no longer occur."""
    i = at
    while m := _STOP.search(page, i):
        if m[0] == ">":
            return m.start()
        j = m.start() - 1
        while j >= at and page[j].isspace():
            j -= 1
        i = m.end()
        if j < at or page[j] != "=":
            continue
        close = -1 if closed.get(m[0]) else page.find(m[0], i)
        if close < 0:
            closed[m[0]] = 1
            return page.find(">", i)
        if not page[close + 1 : close + 2].strip(" \t\r\n\f/>"):
            i = close + 1
            continue
        first = page.find(">", i, close)
        if first >= 0:
            return first
        i = close + 1
    return -1


def _tokens(page: str):
    """(start and end of a text, name of the tag after it, whether that tag closes, its attributes); the last name is empty."""
    at = look = 0
    closed: dict[str, int] = {}
    while (low := page.find("<", look)) >= 0:
        c = page[low + 1 : low + 2]
        if c == "!" and page.startswith("<!--", low):
            end = page.find("-->", low + 4)
            yield at, low, None, False, ""
            at = look = len(page) if end < 0 else end + 3
        elif c in ("!", "?"):
            end = page.find(">", low)
            yield at, low, None, False, ""
            at = look = len(page) if end < 0 else end + 1
        elif m := _NAME.match(page, low + 1 + (c == "/")):
            end = _tag_end(page, m.end(), closed)
            tag = m[0].lower()
            if end < 0:
                yield at, low, None, False, ""
                return
            after = end + 1
            if c != "/" and tag in _RAW:
                close = _RAW_END[tag].search(page, after)
                yield at, low, None, False, ""
                after = close.end() if close else len(page)
            else:
                yield at, low, tag, c == "/", page[m.end() : end]
            at = look = after
        else:
            look = low + 1
    yield at, len(page), None, False, ""


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    # of every open element: tag, marks of the nearest telling one, marks of those around it, number of the nearest telling one, own number, place of the nearest block element, whether it is hidden
    stack: list[tuple[str, int, int, int, int, int, bool]] = [("", 0, 0, 0, 0, 0, False)]
    opened: Counter[str] = Counter()
    inline: list[Counter[str]] = [Counter()]  # open inline elements in each open block element
    parts, linked, links, number = [], 0, 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                block_at = stack[-1][5]
                out.append(Block(text, linked, stack[block_at][0], *stack[-1][1:4], stack[max(block_at - 1, 0)][4]))
            parts.clear()
        linked = 0

    def pop():
        tag = stack.pop()[0]
        if tag in _INLINE:
            inline[-1][tag] -= 1
        else:
            opened[tag] -= 1
            inline.pop()

    for low, high, tag, closes, attributes in _tokens(page):
        if high > low and not stack[-1][6]:
            parts.append(page[low:high])
            if links:
                linked += high - low
        if not tag:
            continue
        if tag not in _INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if closes:
            if tag == "a":
                links = max(links - 1, 0)
            if inline[-1][tag] if tag in _INLINE else opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in _VOID:
            if tag not in _INLINE:
                while len(stack) > 1 and (stack[-1][0] in _INLINE or stack[-1][0] == "p"):
                    pop()
                closed_by = _SELF_CLOSED.get(tag, ())
                while len(stack) > 1 and stack[-1][0] in closed_by:
                    pop()
                links = 0
            elif tag == "a":
                links += 1
            number += 1
            _, near, outer, region, _, block_at, hidden = stack[-1]
            own, hidden = _marks(tag, attributes), hidden or _unseen(attributes)
            if own:
                near, outer, region = own, near | outer, number
            if tag in _INLINE:
                if not attributes.endswith("/"):
                    inline[-1][tag] += 1
                    stack.append((tag, near, outer, region, number, block_at, hidden))
            else:
                opened[tag] += 1
                inline.append(Counter())
                stack.append((tag, near, outer, region, number, len(stack), hidden))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """What the classifier sees of each block."""
    x = np.zeros((len(found), N_FEATURES))
    body, header, part = _BIT["body"], _BIT["header"], _BIT["part"]
    has_body = any((b.near | b.outer) & body for b in found)
    for i, b in enumerate(found):
        n = len(b.text)
        density, length = min(b.linked / n, 1), math.log1p(n) / 6
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        x[i, :8] = (1, length, density, min(b.text.count(" ") / 40, 1), float(b.text[-1] in ".!?…:;\"'"), (i + 1) / len(found), math.log1p(len(before.text)) / 6 if before else 0, math.log1p(len(after.text)) / 6 if after else 0)
        tag = "h" if b.tag[:1] == "h" and b.tag[1:].isdigit() else b.tag
        if tag in _TAGS:
            x[i, 8 + _TAGS.index(tag)] = 1
        for j in range(len(_MARKS)):
            x[i, _TEXT + j], x[i, _TEXT + len(_MARKS) + j] = b.near >> j & 1, b.outer >> j & 1
        is_part = bool(b.near & part)
        x[i, -7] = has_body and not (b.near | b.outer) & body  # outside what the page itself calls its main text
        x[i, -6:] = (is_part * density, is_part * length, is_part and bool(b.outer & body), bool(b.near & header) and bool(b.outer & body), bool(b.near & header) and tag == "h", not b.near)
    return x


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge."""
    w = np.zeros(N_FEATURES)
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(N_FEATURES), x.T @ (p - y) + ridge * w)
    return w


def lesson(rng: Random) -> str:
    """A made-up page. Words of its main text have a c at their beginning, words of its boilerplate a b."""
    pick = rng.choice
    chance = lambda p: rng.random() < p
    words = lambda c, low, high: " ".join(c + "aeioumnrst"[: rng.randrange(1, 10)] for _ in range(rng.randrange(low, high)))
    prose = lambda c, low=4, high=90: words(c, low, high) + pick([".", ".", ".", "?", "!", "…", ""])
    link = lambda c, low=1, high=5: f'<a href="/x">{words(c, low, high)}</a>'
    boiler, talk, body, plain = (sorted(x) for x in (_BOILER_WORDS, _TALK_WORDS, _BODY_WORDS, _PLAIN_WORDS))

    def named(word: str) -> str:
        other = pick(plain)
        return f'{pick(["class", "class", "id", "role"])}="{pick([word, word, f"{word}-{other}", f"{other}-{word}", f"{word}_{other}", word + other.title()])}"'

    def paragraph(c: str) -> str:
        return f"<p>{' '.join(pick([prose(c), prose(c), link(c), '<b>' + words(c, 1, 6) + '</b>']) for _ in range(rng.randrange(1, 4)))}</p>"

    def items(c: str, linked: float) -> str:
        return "<ul>" + "".join(f"<li>{link(c) if chance(linked) else words(c, 1, 14)}</li>" for _ in range(rng.randrange(2, 9))) + "</ul>"

    def passage() -> str:
        kind = rng.random()
        if kind < 0.55:
            return paragraph("c")
        if kind < 0.65:
            return f"<h2>{words('c', 1, 8)}</h2>"
        if kind < 0.75:
            return items("c", 0.15)
        if kind < 0.8:
            return "<table>" + "".join(f"<tr><td>{words('c', 1, 4)}</td><td>{words('c', 1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.85:
            return f"<blockquote>{prose('c')}</blockquote>"
        if kind < 0.92:  # a name of which a word of boilerplate is but a part
            return f'<div class="{pick(boiler + talk)}-{words("w", 1, 2)}">{paragraph("c")}{paragraph("c")}</div>'
        return f'<div class="{words("w", 1, 2)}">{prose("c")}</div>'

    def side(name: str | None, inside: bool) -> str:
        """A piece of boilerplate, in an element of that name or with a telling class, if any."""
        inner = pick([items("b", 0.95), items("b", 0.95), paragraph("b"), prose("b", 3, 30), " ".join(link("b") for _ in range(5)), words("b", 1, 6), f"<h3>{words('b', 1, 4)}</h3>" + items("b", 0.9)])
        if name:
            return f"<{name}>{inner}</{name}>"
        if inside or chance(0.8):
            return f"<{(tag := pick(['div', 'section', 'div']))} {named(pick(boiler))}>{inner}</{tag}>"
        return f"<div>{pick([items('b', 1), ' '.join(link('b') for _ in range(4)), words('b', 1, 4)])}</div>"

    def comments() -> str:
        if chance(0.35):  # each an article of its own, named or not, with who said it and when
            one = lambda: f"<article{' ' + named(pick(talk)) if chance(0.5) else ''}><p>{words('b', 1, 3)} {rng.randrange(1, 28)}.{rng.randrange(1, 12)}.</p>{paragraph('b')}</article>"
            return f"<section {named(pick(talk))}>" + "".join(one() for _ in range(rng.randrange(1, 6))) + "</section>"
        return f"<{(tag := pick(['div', 'section', 'ol']))} {named(pick(talk))}>" + "".join(paragraph("b") for _ in range(rng.randrange(1, 6))) + f"</{tag}>"

    if chance(0.05):  # bare text
        return prose("c") + "<br>" + prose("c")
    title = f"<h1>{words('c', 2, 12)}</h1>"
    head = f"<header>{title}{'<p>' + words('c', 2, 12) + '</p>' if chance(0.4) else ''}</header>" if chance(0.4) else title
    story = head + "".join(pick([passage, passage, passage, passage, passage, lambda: side(pick([None, None, "aside", "form"]), True)])() for _ in range(rng.randrange(1, 14)))
    story += (f"<footer>{pick([words('b', 2, 8), items('b', 0.9), prose('b', 3, 20)])}</footer>" if chance(0.15) else "") + (comments() if chance(0.15) else "")
    open_, close = pick([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), (f"<div {named(pick(body))}>", "</div>"), ("<div>", "</div>"), ("", "")])
    page = "".join(side(pick(["nav", "header", "nav", None, None]), False) for _ in range(rng.randrange(1, 4))) + open_ + story + close
    page += "".join(pick([lambda: side(pick(["footer", "aside", "form", None, None]), False), comments])() for _ in range(rng.randrange(1, 4)))
    if open_ and "<div>" != open_ and chance(0.3):  # what a page that names its main text has outside of it, under no name
        page = (f"<div>{prose('b', 3, 20)}</div>" if chance(0.5) else "") + page + f"<div><h3>{words('b', 1, 3)}</h3>" + "".join(f"<div>{prose('b')}</div>" for _ in range(rng.randrange(1, 4))) + "</div>"
    if chance(0.1):  # a teaser is an article in a bar at the side
        page += f"<aside {named('related')}><article><h3>{link('b', 3, 9)}</h3><p>{prose('b', 3, 14)}</p></article></aside>"
    return f"<form>{page}</form>" if chance(0.08) else page


def lessons(n: int = LESSONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = Random(seed)
    found = [blocks(lesson(rng)) for _ in range(n)]
    return np.concatenate([features(f) for f in found]), np.array([b.text[0] == "c" for f in found for b in f], float)


_UNIT = 1 << 32


def minimum_cut(content: list[float], boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: content) that minimises costs of labels plus capacities of edges between unlike labels. Of several
    the one with fewest contents.

    Costs are whole numbers. The cost of an edge is kept as one that is paid where its lower end is boilerplate and its higher
    end content; what is paid the other way round is in the ends' own costs.
    """
    n = len(content)
    # the ones added make the cut with fewest contents the only cheapest one
    own = [round((c - b) * _UNIT) * (n + 1) + 1 for c, b in zip(content, boiler)]
    near: list[dict[int, int]] = [{} for _ in range(n)]

    def put(a: int, b: int, capacity: int):
        near[a][b] = near[b][a] = near[a].get(b, 0) + capacity

    for a, b, capacity in edges:
        if a != b:
            a, b, c = min(a, b), max(a, b), round(capacity * _UNIT) * (n + 1)
            own[a] += c
            own[b] -= c
            put(a, b, 2 * c)
    taken: list[tuple[int, int, list[tuple[int, int]]]] = []
    gone = [False] * n

    def best(cost: int, ends, labels) -> tuple[int, int]:
        """What the cheaper label of a node costs, and that label."""
        zero, one = 0, cost
        for (u, w), x in zip(ends, labels):
            if u > v and x:
                zero += w
            elif u < v and not x:
                one += w
        return (one, 1) if one < zero else (zero, 0)

    queue = deque(v for v in range(n) if len(near[v]) <= 2)
    while queue:
        v = queue.popleft()
        if gone[v] or len(near[v]) > 2:
            continue
        gone[v] = True
        ends = sorted(near[v].items())
        taken.append((v, own[v], ends))
        for u, _ in ends:
            del near[u][v]
        if len(ends) == 1:
            own[ends[0][0]] += best(own[v], ends, (1,))[0] - best(own[v], ends, (0,))[0]
        elif ends:
            (a, _), (b, _) = ends
            f = {(x, y): best(own[v], ends, (x, y))[0] for x in (0, 1) for y in (0, 1)}
            own[a] += f[1, 0] - f[0, 0]
            own[b] += f[1, 1] - f[1, 0]
            if w := f[0, 1] + f[1, 0] - f[0, 0] - f[1, 1]:
                put(a, b, w)
        queue.extend(u for u, _ in ends if len(near[u]) <= 2)
    label = [0] * n
    core = [v for v in range(n) if not gone[v]]
    if core:
        source, sink = n, n + 1
        residual: dict[int, dict[int, int]] = {v: {} for v in [*core, source, sink]}
        for v in core:
            a, b, c = (v, sink, own[v]) if own[v] > 0 else (source, v, -own[v])
            residual[a][b], residual[b][a] = c, residual[b].get(a, 0)
            for u, w in near[v].items():
                if u > v:
                    residual[u][v], residual[v][u] = w, 0
        while True:  # shortest augmenting paths
            parent, queue = {source: source}, deque([source])
            while queue and sink not in parent:
                v = queue.popleft()
                for u, capacity in residual[v].items():
                    if capacity > 0 and u not in parent:
                        parent[u] = v
                        queue.append(u)
            if sink not in parent:
                break
            path, v = [], sink
            while v != source:
                path.append((parent[v], v))
                v = parent[v]
            flow = min(residual[a][b] for a, b in path)
            for a, b in path:
                residual[a][b] -= flow
                residual[b][a] += flow
        for v in core:
            label[v] = int(v in parent)
    for v, cost, ends in reversed(taken):
        label[v] = best(cost, ends, [label[u] for u, _ in ends])[1]
    return [bool(x) for x in label]


def main_text(page: str, w: np.ndarray) -> str:
    """The text of the blocks that the minimum cut puts on the side of content, one to a line."""
    found = blocks(page)
    if not found:
        return ""
    odds = (features(found) @ w).tolist()
    cost = lambda z: math.log1p(math.exp(-abs(z))) + max(-z, 0.0)
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEAR / (1 if found[i - 1].region == b.region else 3)))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING / (i - last[b.parent])))
        last[b.parent] = i
    chosen = minimum_cut([cost(z) for z in odds], [cost(-z) for z in odds], edges)
    return "\n".join(b.text for b, keep in zip(found, chosen) if keep)


def train(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights, from the lessons and from about ``sample`` distinct pages, those with hashes below a cut-off."""

    def run(batches):
        for batch in slices(batches, 0):
            xs = []
            for page in batch.column(0).to_pylist():
                found = blocks(page)[:SAMPLE_BLOCKS]
                y = np.array([_told(b) for b in found])
                xs.append(np.concatenate([features(found), y.reshape(-1, 1)], 1)[y >= 0].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary())], ["x"])

    share = min(1.0, sample / max(pages.count(), 1))
    drawn = pages.where(F.col("html").isNotNull()).select("html", F.xxhash64("html").alias("h")).where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)) + 1)
    # copies of one page are one, folded before they are shuffled; their number is that of the hashes below the cut-off, and twice that at most comes back
    drawn = drawn.groupBy("h").agg(F.any_value("html").alias("html")).limit(2 * sample).select("html")
    rows = np.frombuffer(b"".join(r.x for r in drawn.mapInArrow(run, "x binary").collect()), float).reshape(-1, N_FEATURES + 1)
    x, y = lessons()
    return fit(np.concatenate([x, rows[:, :-1]]), np.concatenate([y, rows[:, -1]]))


def _told(b: Block) -> int:
    """1 or 0 for a block whose nearest telling element says by its name what it is, in nothing that says otherwise; else -1."""
    if b.near == _BIT["body"] and not b.outer & ~_BIT["body"]:
        return 1
    return 0 if b.near in (_BIT["nav"], _BIT["footer"], _BIT["aside"]) and not b.outer else -1


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """One row per row of ``df``: id, url, text, n_chars."""
    pages = only(df, id=id_col, url=url_col, html=html_col)
    w = train(pages) if weights is None else weights

    def run(batches):
        for batch in slices(batches, 2, 8 << 20):
            texts = [main_text(page or "", w) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(F.col("id").cast("long"), "url", "html").mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
