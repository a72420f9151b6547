"""Operator 5, HTML extraction by tag-path ratios.

A page is read once, leniently (unclosed and misnested tags are closed as browsers do for the common
cases).  Text is gathered into blocks; every block has its root-to-leaf path of block elements.

1. Aggregate per path: text length, punctuation, blocks and linked text.
2. Ratios: text length and punctuation per block of the path, less the linked share.  Names are a weight:
   in menus, notices, adverts, forms, side and foot parts and comments a block counts a hundredth.  A class or
   id tells them by a whole token or a known compound (``sidebar``, ``cookie-notice``, not ``has-sidebar``); no
   name weighs on html, body or main, nor on an element with most of the page's score and all its articles' text.
3. Smooth both ratios over the sequence of blocks with a Gaussian, fuse them (geometric mean), and
   threshold the mean of every path at a share of the page's spread.
4. From the root, follow the element that holds nearly all score of the chosen paths, as far as an
   ``article`` or ``main`` or until the score divides: that is the content node.  Its text are the blocks of
   chosen paths and the short headings, items and paragraphs between them that no name weighs on and whose
   path, but for headings, is not mostly links.

The work is a narrow pass over pages; a page's memory is that of its own text.

Defined cases: null or empty html gives an empty text; html without tags is one block; repeated rows
are extracted each; an empty table gives no rows; ``extract_pages`` keeps extra columns but for
``text`` and ``n_chars``.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from glazier.llm.common import column, read_table

# Element kinds.
RAW = "script|style|noscript|template|svg|annotation-xml|annotation|iframe|object|textarea|select|title"
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPARED_TAGS = frozenset("aside button dialog fieldset footer form head label legend menu nav option".split())
COMMENT_WORDS = frozenset("comment comments reply replies discussion disqus respond".split())
SPARED_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription signup sidebar side menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead related recommended recommendations share sharing social popup modal overlay "
    "widget toolbar pagination pager skip login search".split())
# What else a compound with such a word may hold; others (has, with, no, open, closed) make it a state.
COMPANIONS = frozenset(
    "area bar block bottom box button col column container feed fixed form google group icon icons inline inner item "
    "items left link links list message outer page panel post primary right row secondary section site slot sticky "
    "text thread top unit wrapper zone".split())
UNNAMED = frozenset("html body main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements an opening tag closes first, and the elements that stop the search.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
STOPS = frozenset("ul ol dl table article main section div body td th blockquote form menu".split())
_RAW_NAME = re.compile(rf"(?:{RAW})\b", re.I)
_TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_SPECIAL = re.compile(r"[>\"']")
DEEPEST = 64  # a path keeps so many names; deeper elements count as their ancestor there
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…¡¿。，、]")
KEEP, SPARE, SPARE_COMMENT = 0, 1, 2
SMOOTH = (0.06, 0.24, 0.40, 0.24, 0.06)
THRESHOLD = 0.15
NAMED = 0.01  # weight of blocks with names of page furniture
NEARLY_ALL = 0.95  # of the chosen score, to go down to an element


@dataclass(slots=True)
class _Element:
    tag: str
    name: str
    state: int
    path: tuple[str, ...] = ()
    elements: tuple[tuple[int, str], ...] = ((0, ""),)


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    elements: tuple[tuple[int, str], ...]
    spared: bool
    linked: int


class _Ends:
    """Where tags end: the first ``>`` outside quotes.  Every quote and ``>`` of the page is looked at once, from the
    back, so that unclosed tags and quotes cost no search of their own."""

    def __init__(self, page: str):
        self.at = [m.start() for m in _SPECIAL.finditer(page)]
        n = len(self.at)
        self.end = [-1] * (n + 1)       # the end of a tag that meets special character k outside quotes
        following = {'"': n, "'": n}    # the next quote of either kind
        for k in range(n - 1, -1, -1):
            char = page[self.at[k]]
            if char == ">":
                self.end[k] = self.at[k] + 1
            else:
                closing = following[char]
                self.end[k] = self.end[closing + 1] if closing < n else -1
                following[char] = k

    def of(self, start: int) -> int:
        return self.end[bisect_left(self.at, start)]


def _tokens(page: str):
    """(start, end, tag, is an end tag, attributes) of the markup in page order, in linear time; the tag of comments,
    declarations and raw elements is empty.  What is not closed is text, but a comment or raw element ends with the page."""
    ends, at = _Ends(page), 0
    closed = True  # whether a ">" may follow
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        if closed and (page.startswith("!", at + 1) or page.startswith("?", at + 1)):
            end = page.find(">", at)
            closed = end >= 0
            if closed:
                yield at, end + 1, "", False, ""
                at = end + 1
                continue
        raw = _RAW_NAME.match(page, at + 1) if closed else None
        if raw:
            end = page.find(">", raw.end())
            closed = end >= 0
            if closed:
                found = re.compile(rf"</{raw[0]}\s*>", re.I).search(page, end + 1)
                end = found.end() if found else len(page)
                yield at, end, "", False, ""
                at = end
                continue
        name = _TAG_NAME.match(page, at + 1)
        end = ends.of(name.end()) if name else -1
        if end < 0:
            at += 1
            continue
        is_end = name[0][0] == "/"
        yield at, end, name[0][is_end:].lower(), is_end, page[name.end():end - 1]
        at = end


def _named(token: str) -> frozenset[str]:
    """The spared words of a class or id that is one of them or a known compound."""
    parts = _PART.findall(token)
    found = SPARED_WORDS.intersection(parts)
    return found if all(p in found or p in COMPANIONS or len(p) == 1 for p in parts) else frozenset()


def _state(tag: str, attrs: str, parent: int, in_content: bool, exempt: bool) -> tuple[str, int, bool]:
    """Name for the path, whether the element's text is spared, and whether by its names alone."""
    tokens = {t for found in _NAMES.findall(attrs) for t in "".join(found).lower().split()} if attrs else set()
    name = ".".join([tag, *sorted({w for t in tokens for w in _PART.findall(t)})])
    words = frozenset().union(*map(_named, tokens)) if tokens and tag not in UNNAMED else frozenset()
    by_name = bool(words)
    if exempt:
        words = frozenset()
    if parent == SPARE_COMMENT or words & COMMENT_WORDS:
        return name, SPARE_COMMENT, by_name
    if tag in SPARED_TAGS or (tag == "header" and not in_content) or words or attrs and _HIDDEN.search(attrs):
        return name, SPARE, by_name
    # An article begins anew where a menu or an advert before it was not closed.
    return name, KEEP if tag in ("article", "main", "body") else parent, by_name


def read_blocks(page: str, exempt: frozenset[int] = frozenset()) -> tuple[list[Block], frozenset[int]]:
    """The page's blocks of text in page order, and the elements with names that spare them; those of
    ``exempt`` are not spared by name."""
    blocks: list[Block] = []
    named: list[int] = []
    stack = [_Element("", "", KEEP)]
    held = Counter()  # open elements by tag
    parts: list[str] = []
    links = opened = linked = at = 0

    def flush():
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(parts)).split()) if parts else ""
        if text:
            blocks.append(Block(text, stack[-1].path, stack[-1].elements, stack[-1].state != KEEP, linked))
        parts.clear()
        linked = 0

    def cut(size: int):
        held.subtract(e.tag for e in stack[size:])
        del stack[size:]

    for start, end, tag, is_end, attrs in _tokens(page):
        if start > at:
            parts.append(page[at:start])
            if links:
                linked += start - at
        at = end
        if not tag:
            continue
        if tag not in BLOCKS:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if is_end else 1
            continue
        flush()
        links = 0
        if is_end:
            if held[tag] > 0:
                size = len(stack) - 1
                while stack[size].tag != tag:
                    size -= 1
                cut(size)
            continue
        while stack[-1].tag == "p" or stack[-1].tag[:1] == "h" and stack[-1].tag[1:].isdigit() and tag[:1] == "h":
            cut(len(stack) - 1)
        closing = CLOSES.get(tag)
        if closing and any(held[t] > 0 for t in closing):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closing:
                    cut(i)
                    break
                if stack[i].tag in STOPS:
                    break
        if tag not in VOID:
            opened += 1
            above = stack[-1]
            name, state, by_name = _state(tag, attrs, above.state, held["article"] + held["main"] > 0, opened in exempt)
            if by_name:
                named.append(opened)
            deep = len(stack) > DEEPEST
            stack.append(_Element(tag, name, state, above.path if deep else (*above.path, name),
                                  above.elements if deep else (*above.elements, (opened, tag))))
            held[tag] += 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return blocks, frozenset(named)


def _wrongly_named(page: str, blocks: list[Block], named: frozenset[int]) -> frozenset[int]:
    """Elements of ``named`` with all unspared text of articles and most of the score the page has without names."""
    def held(found: list[Block], values: list[float]) -> dict[int, float]:
        sums = dict.fromkeys(named, 0.0)
        for b, v in zip(found, values):
            for number, _ in b.elements:
                if number in sums:
                    sums[number] += v
        return sums

    kept = [b for b in blocks if not b.spared and any(tag in ("article", "main") for _, tag in b.elements)]
    inside = held(kept, [1.0] * len(kept))
    if all(n < len(kept) for n in inside.values()):
        return frozenset()
    whole, _ = read_blocks(page, named)
    scores = path_scores(whole)
    values = [scores[b.path] for b in whole]
    most = held(whole, values)
    return frozenset(n for n in named if inside[n] == len(kept) and 2 * most[n] > sum(values))


def path_scores(blocks: list[Block]) -> dict[tuple[str, ...], float]:
    """Fused, smoothed tag-path ratio of every path: the mean over its blocks."""
    sums: dict[tuple[str, ...], list[int]] = {}
    for b in blocks:
        total = sums.setdefault(b.path, [0, 0, 0, 0])
        for i, v in enumerate((len(b.text), len(_PUNCTUATION.findall(b.text)), 1, b.linked)):
            total[i] += v
    length, signs, plain = [], [], []
    for b in blocks:
        chars, punctuation, n, linked = sums[b.path]
        plain.append((NAMED if b.spared else 1.0) * max(0.0, 1 - linked / chars))
        length.append(plain[-1] * chars / n)
        signs.append(plain[-1] * punctuation / n)

    def smooth(values: list[float]) -> list[float]:
        half = len(SMOOTH) // 2
        padded = [0.0] * half + values + [0.0] * half
        return [sum(k * padded[i + j] for j, k in enumerate(SMOOTH)) for i in range(len(values))]

    fused: dict[tuple[str, ...], list[float]] = {}
    for b, x, y, share in zip(blocks, smooth(length), smooth(signs), plain):
        # Again, since smoothing lends a menu the length of its neighbours.
        fused.setdefault(b.path, []).append(share * math.sqrt(x * (1 + y)))
    return {path: sum(v) / len(v) for path, v in fused.items()}


def extract_text(page: str | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    blocks, named = read_blocks(page)
    wrong = _wrongly_named(page, blocks, named) if named else named
    if wrong:
        blocks, _ = read_blocks(page, wrong)
    if all(b.spared for b in blocks):
        return ""
    scores = path_scores(blocks)
    values = [scores[b.path] for b in blocks]
    top = max(values)
    if top <= 0:
        return ""
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    least = min(top, max(THRESHOLD * top, mean - spread))
    node = _content_node(blocks, [v if v >= least else 0.0 for v in values])
    chars, linked = Counter(), Counter()
    for b in blocks:
        chars[b.path] += len(b.text)
        linked[b.path] += b.linked
    return " ".join(
        b.text for b, v in zip(blocks, values) if any(number == node for number, _ in b.elements)
        and (v >= least or not b.spared and (2 * linked[b.path] <= chars[b.path] or b.elements[-1][1] in HEADINGS)))


def _content_node(blocks: list[Block], scores: list[float]) -> int:
    """The element reached from the root by following the one with nearly all of the score."""
    held: dict[int, float] = {}
    above: dict[int, list[tuple[int, str]]] = {}
    for b, v in zip(blocks, scores):
        last = None
        for number, tag in b.elements:
            if number not in held:
                held[number] = 0.0
                if last is not None:
                    above.setdefault(last, []).append((number, tag))
            held[number] += v
            last = number
    node, tag = 0, ""
    while tag not in ("article", "main"):
        best = max(above.get(node, ()), key=lambda x: held[x[0]], default=None)
        if best is None or held[best[0]] < NEARLY_ALL * held[0]:
            break
        node, tag = best
    return node


def extract_pages(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (None: all) of ``pages`` with ``text`` and ``n_chars``."""
    pages = pages.drop("text", "n_chars")
    keep = list(pages.columns if keep is None else keep)
    kinds = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def extract(batches):
        for batch in batches:
            texts = [extract_text(p) for p in column(batch, html).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"])

    return pages.mapInArrow(extract, kinds)


def op5_tag_path_ratios(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
