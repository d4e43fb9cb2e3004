"""The main text of web pages, by a linear-chain conditional random field.

A page is cut into leaf blocks of text by its block elements. Each block has
features of the tags and names of the elements around it and of its text. The field's two labels are
article and other; its weights are fitted to labelled pages, TRAINED at most,
by gradient ascent on the likelihood, with forward and backward sums over all pages at
once. Viterbi decoding labels the blocks of each page in the tasks.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from . import common
from .html_pages import labelled_pages

#: Labelled pages that are made and trained on, the rounds of training, and its pull to zero.
TRAINED, ROUNDS, DECAY = 800, 250, 0.02
#: Elements around a block, the nearest first, that give features.
AROUND = 32

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")  # of a tag, > between quotation marks included
_ATTR = re.compile(r"(class|id|role|hidden|data-y|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"'>]|\Z)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# HTML's elements by how they cut text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content isn't page text. The first four run to their end tag or the page's end, a drawing to the next block tag at most.
RAW = frozenset("script style textarea title svg".split())
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
SCOPES = frozenset("table ul ol dl select article section div body td th main aside nav header footer form blockquote".split())
NOT_IN_P = BLOCKS - frozenset("button label option select legend caption tbody thead tfoot tr td th head html body".split())


class Element:
    """An open block element; shared by all blocks within it."""

    __slots__ = ("depth", "features", "label", "names", "parent", "tag")

    def __init__(self, parent: Element | None, tag: str, names: tuple[str, ...], label: str | None):
        self.parent, self.tag, self.names = parent, tag, names
        self.label = label if label is not None else parent.label if parent else None
        self.depth = parent.depth + 1 if parent else 1
        self.features: list[str] | None = None


class Block:
    __slots__ = ("chars", "element", "linked", "text")

    def __init__(self, element: Element | None):
        self.element, self.text, self.chars, self.linked = element, [], 0, 0


_BLOCK_TAG = rf"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])"
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>" + (rf"|(?={_BLOCK_TAG})" if t == "svg" else ""), re.I) for t in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none")


def _element(parent: Element | None, tag: str, attrs: str, labelled: bool) -> Element:
    names, label = (), None
    if attrs and not attrs.isspace():
        got = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
        label = got.get("data-y") if labelled else None
        names = tuple(dict.fromkeys(x.lower() for k in ("class", "id", "role") for x in _NAME.findall(got.get(k, ""))))
        if "hidden" in got or _HIDDEN.search(got.get("style", "")):
            names += ("hidden",)
    return Element(parent, tag, names, label)


class _Open:
    """The block elements that are open, innermost last. `count` saves searches that can't find anything."""

    def __init__(self):
        self.stack: list[Element] = []
        self.count: dict[str, int] = {}

    def push(self, e: Element) -> None:
        self.stack.append(e)
        self.count[e.tag] = self.count.get(e.tag, 0) + 1

    def cut(self, i: int) -> None:
        for e in self.stack[i:]:
            self.count[e.tag] -= 1
        del self.stack[i:]

    def close(self, tag: str) -> bool:
        """Ends the innermost element of that tag and all within it."""
        if not self.count.get(tag):
            return False
        self.cut(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag))
        return True

    def close_implied(self, tag: str) -> None:
        """Ends what the start of `tag` ends without an end tag, within its scope and AROUND levels."""
        ends = CLOSES.get(tag) or (("p",) if tag in NOT_IN_P else ())
        if not any(self.count.get(t) for t in ends):
            return
        for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 1 - AROUND), -1):
            if self.stack[i].tag in ends:
                self.cut(i)
                if tag == "p":
                    return
            elif self.stack[i].tag in SCOPES:
                return


def blocks(page: str, labelled: bool = False) -> list[tuple[str, Element | None, int, int, int | None]]:
    """(text, innermost element, link per cent, own tag depth, label) of the page's leaf blocks, white
    space made single, in time linear in the page's length. label: data-y of the nearest element around if labelled, else None.
    Where a quotation mark in a tag has no mate, tags from there on end at the next >; a tag that never ends, ends the page."""
    out: list[Block] = []
    opened = _Open()
    now: Block | None = None
    at, end, links, quotes = 0, len(page), 0, True

    def add(piece: str) -> None:
        nonlocal now
        if now is None:
            if not piece.strip():
                return
            now = Block(opened.stack[-1] if opened.stack else None)
            out.append(now)
        now.text.append(piece)
        size = len(piece)
        now.chars += size
        now.linked += size if links else 0

    while at < end:
        m = _OPEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            add(html.unescape(page[at:stop]))
        if not m:
            break
        begin = m.end()
        if m[1] or m[2]:
            until = "-->" if m[1] else ">"
            at = page.find(until, begin)
            if at < 0:
                break
            at += len(until)
            continue
        rest = _REST.match(page, begin) if quotes else None
        quotes = quotes and rest is not None
        last = rest.end() - 1 if rest else page.find(">", begin)
        if last < 0:
            break
        attrs, at, tag = page[begin:last], last + 1, m[4].lower()
        if m[3]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                add(" ")
            elif tag in BLOCKS:
                now = None
                if opened.close(tag):
                    links = 0
        elif tag in RAW:
            if not attrs.endswith("/"):
                found = _RAW_END[tag].search(page, at)
                at = found.end() if found else end
        elif tag == "a":
            links = 1
        elif tag == "br":
            add(" ")
        elif tag in BLOCKS:
            now = None
            opened.close_implied(tag)
            if tag not in VOID and not attrs.endswith("/"):
                opened.push(_element(opened.stack[-1] if opened.stack else None, tag, attrs, labelled))
    made = []
    for b in out:
        text = " ".join("".join(b.text).split())
        if text:
            label = b.element.label if b.element else None
            made.append((text, b.element, 100 * b.linked // max(1, b.chars), b.element.depth if b.element else 0, None if label is None else int(label)))
    return made


def _around(element: Element | None) -> list[str]:
    """The features of the elements around a block, found once an element."""
    if element is None:
        return ["tag=none", "around=none", "unnamed"]
    if element.features is None:
        f, named, e = {f"tag={element.tag}"}, False, element
        for _ in range(AROUND):
            if e.tag != element.tag:
                f.add(f"in={e.tag}")
            f.update(f"name={x}" for x in e.names)
            named |= bool(e.names)
            e = e.parent
            if e is None:
                break
        f.add(f"around={element.parent.tag if element.parent else 'none'}")
        if not named:
            f.add("unnamed")
        element.features = sorted(f)
    return element.features


_BUCKETS = (1, 2, 4, 8, 16, 32, 64)


def features(page_blocks: list) -> list[list[str]]:
    n, out = len(page_blocks), []
    for i, (text, element, linked, _, _) in enumerate(page_blocks):
        words = text.count(" ") + 1
        size = sum(words >= b for b in _BUCKETS)
        own = element.tag if element else "none"
        ended = not text[-1].isalnum()
        f = {f"words={size}", f"linked={0 if not linked else 1 if linked < 30 else 2 if linked < 80 else 3}", f"ended={ended}", f"words={size} ended={ended}", f"tag={own} words={size}", *_around(element)}
        if "©" in text or "(c)" in text:
            f.add("copyright")
        if " | " in text or " · " in text:
            f.add("bars")
        if i == 0 or i == n - 1:
            f.add("first" if i == 0 else "last")
        f.add(f"at={4 * i // n}")
        out.append(list(f))
    return out


class Field:
    """weights: feature -> score of article over other; moves[a][b]: from label a to b; start: of article first."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]], bias: float, start: float):
        self.weights, self.moves, self.bias, self.start = weights, moves, bias, start

    def decode(self, feats: list[list[str]]) -> list[int]:
        """Viterbi; of equal paths the one with other."""
        get, (m0, m1) = self.weights.get, self.moves
        zero, one, back = 0.0, self.start, []
        for i, f in enumerate(feats):
            s = self.bias + sum([get(x, 0.0) for x in f])
            if i:
                a0, a1, b0, b1 = zero + m0[0], one + m1[0], zero + m0[1], one + m1[1]
                back.append((a1 > a0, b1 > b0))
                zero, one = max(a0, a1), max(b0, b1)
            one += s
        label, out = int(one > zero), []
        for step in reversed(back):
            out.append(label)
            label = int(step[label])
        return [*reversed([*out, label])] if feats else []


def train(pages: list[list[tuple[list[str], int]]]) -> Field:
    """The field fitted to labelled sequences of (features, label)."""
    pages = [p for p in pages if p]
    seen: dict[str, int] = {}
    for p in pages:
        for f, _ in p:
            for x in f:
                seen[x] = seen.get(x, 0) + 1
    known = {x: i for i, x in enumerate(sorted(x for x, c in seen.items() if c > 1))}
    longest = max(map(len, pages), default=0)
    y = np.zeros((len(pages), longest), np.int64)
    mask = np.zeros((len(pages), longest), bool)
    at, feat = [], []
    for r, p in enumerate(pages):
        for c, (f, label) in enumerate(p):
            y[r, c], mask[r, c] = label, True
            ids = [known[x] for x in f if x in known]
            feat += ids
            at += [r * longest + c] * len(ids)
    at, feat = np.array(at, np.int64), np.array(feat, np.int64)
    theta = np.zeros(len(known) + 6)  # weights, bias, start, moves
    square = np.full(len(theta), 1e-8)
    mean = np.zeros(len(theta))
    both = mask[:, 1:] & mask[:, :-1]
    for step in range(1, ROUNDS + 1):
        w, bias, start, moves = theta[:-6], theta[-6], theta[-5], theta[-4:].reshape(2, 2)
        s = np.bincount(at, w[feat], y.size).reshape(y.shape) + bias
        fwd = np.zeros((*y.shape, 2))
        fwd[:, 0, 1] = s[:, 0] + start
        for t in range(1, longest):
            fwd[:, t] = np.logaddexp(fwd[:, t - 1, :1] + moves[0], fwd[:, t - 1, 1:] + moves[1])
            fwd[:, t, 1] += s[:, t]
            fwd[:, t] = np.where(mask[:, t, None], fwd[:, t], fwd[:, t - 1])
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        bwd = np.zeros((*y.shape, 2))
        for t in range(longest - 2, -1, -1):
            ahead = bwd[:, t + 1].copy()
            ahead[:, 1] += s[:, t + 1]
            both_ways = np.stack([np.logaddexp(moves[a, 0] + ahead[:, 0], moves[a, 1] + ahead[:, 1]) for a in (0, 1)], axis=1)
            bwd[:, t] = np.where(mask[:, t + 1, None], both_ways, 0)
        p1 = np.exp(fwd[..., 1] + bwd[..., 1] - total[:, None]) * mask
        miss = (y - p1) * mask
        grad = np.empty_like(theta)
        grad[:-6] = np.bincount(feat, miss.reshape(-1)[at], len(known))
        grad[-6], grad[-5] = miss.sum(), miss[:, 0].sum()
        for a in (0, 1):
            for b in (0, 1):
                pair = fwd[:, :-1, a] + moves[a, b] + b * s[:, 1:] + bwd[:, 1:, b] - total[:, None]
                grad[-4 + 2 * a + b] = (((y[:, :-1] == a) & (y[:, 1:] == b)) * both).sum() - np.exp(np.where(both, pair, -np.inf)).sum()
        grad = grad / len(pages) - DECAY * theta / 10
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        theta += 0.15 * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    names = sorted(known, key=known.get)
    return Field(dict(zip(names, theta[:-6].tolist(), strict=True)), theta[-4:].reshape(2, 2).tolist(), float(theta[-6]), float(theta[-5]))


def sequence(page: str) -> list[tuple[list[str], int]]:
    """A labelled page's blocks; text outside all labels is other."""
    found = blocks(page, labelled=True)
    return [(f, b[4] or 0) for f, b in zip(features(found), found, strict=True)]


@lru_cache(maxsize=2)
def trained(n: int = TRAINED, seed: int = 1) -> Field:
    return train([sequence(p) for p in labelled_pages(n, seed)])


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    labels = field.decode(features(found))
    return "\n\n".join(b[0] for b, y in zip(found, labels, strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    A null or empty html, or one without an article, gives the empty text. Pages of any length
    are parsed whole; markup that isn't closed ends where HTML lets it or at
    the page's end. Repeated rows each get a row; null ids and urls stay null; an empty table gives an empty result; other
    columns are not read. field: by default one trained on made pages.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())

    def work(batch):
        texts = [main_text(p, shared.value) for p in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return common.per_batch(pages.selectExpr("cast(page_id as long) page_id", "url", "html"), "page_id bigint, url string, text string, n_chars bigint", work, rows=256)
