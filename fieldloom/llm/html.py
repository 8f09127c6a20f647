"""Main text of web pages by tree scoring.

Paragraph-like blocks earn points for their length and commas. Points pass to the parent in
full, to the grandparent by half and onwards by a third and so on over ``LEVELS`` ancestors, so the
container of the article collects those of all its paragraphs; they are discounted by link density
(the share of text inside links). The best container is kept together with siblings that score well
or read like prose, and with prose of any length between or next to them.

What takes no part: elements that can hold no article (navigation, page headers and footers, asides,
scripts, controls and so on), hidden elements, and reader comments by a word of their class, id or role.
Other names and the elements ``form``, ``fieldset`` and ``dialog`` are only evidence, weighed against the page:

* A name that is a furniture word, or a compound whose last word is one (``site-footer``), drops its element,
  unless another word names content or nothing readable would be left of the page.
* A compound that only begins with such a word (``menu-page``, ``ad-free-content``), a name beside
  content words (``post sponsored``), words that articles bear too (``legal``), forms, field sets and
  dialogs drop their element only where it holds at most half of what is left of the page, or mostly links.

Edge cases: a null or empty page gives an empty text; a page without paragraphs falls back to
its body's blocks; unclosed and stray tags are tolerated; repeated pages are rows of their own;
a null page_id or url is kept; other columns are ignored. Nesting is walked without recursion
and each block touches at most ``LEVELS`` ancestors, so deep and long pages take linear time.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

# Fixed values of HTML: element names by role.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset(
    "nav header footer aside script style noscript template iframe button select option textarea input label svg math canvas object embed audio video menu head title noembed noframes datalist".split(
    ))
#: Furniture or a wrapper of the whole page.
EITHER = frozenset("form fieldset dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split(
    ))
PROSE = frozenset("p pre blockquote td li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure details".split(
    ))
# Words in class, id or role that name furniture, reader comments, furniture or an article, and content.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr popup modal newsletter subscribe signup login toolbar pagination pager complementary contentinfo "
    "site-header page-header side-bar skip-link".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
WEAK = frozenset("notice alert share sharing social related recommended widget search disclaimer legal".split())
CONTENT = frozenset("article content main entry post story body text".split())
MODIFIERS = frozenset("no has with without not is hide".split())
LEVELS = 6
TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: One attribute with its value (quoted or not), or the end of the tag.
ATTRIBUTE = re.compile(r"[\s/]*+(?:(>|\Z)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?)", re.S)
NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """The attributes of a tag (the first of a name counts), where the tag ends, and whether it ends itself."""
    found: dict[str, str] = {}
    while m := ATTRIBUTE.match(page, at):
        if m.group(1) is not None:
            return found, m.end(), page[m.start() : m.end()].rstrip("> \t\n\f\r").endswith("/")
        value = next((v for v in m.groups()[2:] if v is not None), "")
        found.setdefault(m.group(2).lower(), value)
        at = m.end()
    return found, len(page), False


def is_hidden(said: dict[str, str]) -> bool:
    return "hidden" in said or said.get("aria-hidden", "").strip().lower() == "true" or bool(
        NO_DISPLAY.search(said.get("style", "")))


class Node:
    __slots__ = ("tag", "parent", "skip", "name", "score", "text", "links", "off", "kept")

    def __init__(self, tag: str, parent: Node | None, skip: bool, name: str):
        self.tag, self.parent, self.skip, self.name = tag, parent, skip, name
        self.score, self.text, self.links, self.off, self.kept = 0.0, 0, 0, skip, False


@lru_cache(maxsize=4096)
def named(names: str) -> str:
    """What an element's class, id and role say: ``comment``, ``drop``, ``weak``, ``content`` or nothing."""
    said = set()
    for word in names.lower().split():
        parts = [p for p in re.split(r"[-_:]+", word) if p]
        # A word after a modifier (``no-sidebar``) names nothing.
        own = [p for i, p in enumerate(parts) if i == 0 or parts[i - 1] not in MODIFIERS]
        if not own or own[0] in MODIFIERS and len(own) == 1:
            continue
        head = own[-1] if len(own) == len(parts) or own[-1] == parts[-1] else ""
        if any(p in COMMENTS for p in own):
            said.add("comment")
        elif word in STRONG or head in STRONG:
            said.add("drop")
        elif head in CONTENT:
            said.add("content")
        elif any(p in STRONG or p in WEAK for p in own):
            said.add("weak")
        elif any(p in CONTENT for p in own):
            said.add("content")
    if "content" in said:
        return "weak" if len(said) > 1 else "content"
    return next((kind for kind in ("comment", "drop", "weak") if kind in said), "")


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements in page order, and the text blocks with the block element that holds each."""
    root = Node("#root", None, False, "")
    nodes, stack, holders, blocks, pieces = [root], [root], [root], [], []
    open_tags: Counter[str] = Counter()
    links = 0
    in_link = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(pieces).split())
        if text:
            blocks.append((holders[-1], text, min(links, len(text))))
        pieces.clear()
        links = 0

    def close(to: int) -> None:
        nonlocal in_link
        if any(n.tag not in INLINE for n in stack[to:]):
            flush()
        for n in stack[to:]:
            open_tags[n.tag] -= 1
            in_link -= n.tag == "a"
            if n.tag not in INLINE:
                holders.pop()
        del stack[to:]

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not stack[-1].skip:
            text = _html.unescape(text)
            pieces.append(text)
            if in_link:
                links += len(" ".join(text.split()))
        if not m:
            break
        at = m.end()
        closing, tag = m.group(1), (m.group(2) or "").lower()
        if not tag:
            continue
        said, at, ends = attributes(page, at)
        if closing:
            for i in range(len(stack) - 1, 0, -1) if open_tags[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # a stray inline end tag never closes a block
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in CLOSES_P or tag in PROSE:
            # The next block ends an open paragraph, with whatever inline elements it left open.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" and tag in CLOSES_P or stack[i].tag == tag and tag in ("li", "td", "dd", "dt"):
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        parent = stack[-1]
        names = " ".join(said[k] for k in ("class", "id", "role") if k in said)
        kind = named(names) if tag not in ("html", "body") else ""
        if tag in ("article", "main"):
            kind = "content"
        elif tag in EITHER and kind in ("", "content"):
            kind = "weak"
        node = Node(tag, parent, parent.skip or tag in FURNITURE or is_hidden(said), kind)
        nodes.append(node)
        if ends and tag in ("svg", "path"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        stack.append(node)
        open_tags[tag] += 1
        if tag not in INLINE:
            holders.append(node)
        in_link += tag == "a"
    flush()
    return nodes, blocks


def _totals(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Text and link lengths of every element with all that it holds; children stand after their parents."""
    for node in nodes:
        node.text = node.links = 0
    for node, text, links in blocks:
        node.text += len(text)
        node.links += links
    for node in reversed(nodes[1:]):
        node.parent.text += node.text
        node.parent.links += node.links


def _wanted(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks outside of furniture and comments; sets ``off`` where an element takes no part."""

    def off(drop: frozenset[str]) -> list[tuple[Node, str, int]]:
        for node in nodes[1:]:
            node.off = node.skip or node.parent.off or node.name in drop
        return [b for b in blocks if not b[0].off]

    for drop in (frozenset(("comment", "drop")), frozenset(("comment",))):
        left = off(drop)
        _totals(nodes, left)
        half = nodes[0].text / 2
        for node in nodes[1:]:
            # Where names leave nothing to read, the furniture words are weighed like the weaker ones.
            unsure = node.name == "weak" or node.name == "drop" and "drop" not in drop
            most = node.text > half and node.links < 0.33 * node.text
            node.off = node.off or node.parent.off or unsure and not most
        left = [b for b in left if not b[0].off]
        if any(links < 0.5 * len(text) for _, text, links in left):
            return left
    return left


def _neighbours(siblings: list[Node], kept: set[int]) -> None:
    """Adds prose of any length that stands between kept siblings, or next to them in one run."""
    prose = [n.tag in PROSE or n.tag in ("ul", "ol", "dl", "table", "figure", "hr") for n in siblings]
    good = [p and n.links <= 0.33 * n.text for p, n in zip(prose, siblings)]
    at = [i for i, n in enumerate(siblings) if id(n) in kept]
    lo, hi = at[0], at[-1]
    while lo > 0 and good[lo - 1]:
        lo -= 1
    while hi + 1 < len(siblings) and good[hi + 1]:
        hi += 1
    kept.update(id(n) for n, g in zip(siblings[lo : hi + 1], good[lo : hi + 1]) if g)


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    _totals(nodes, blocks)
    blocks = _wanted(nodes, blocks)
    _totals(nodes, blocks)
    for node, text, links in blocks:
        if node.tag in PROSE or node.tag == "div":
            points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))
            up = node.parent
            for divisor in range(1, LEVELS + 1):
                if up is None:
                    break
                up.score += points / divisor
                up = up.parent
    best, most = None, 0.0
    for node in nodes:
        if node.off or not node.text or node.tag in INLINE or node.tag in PROSE:
            continue
        score = node.score * (1 - node.links / node.text) * (1.5 if node.name == "content" else 1.0)
        if score > most:
            best, most = node, score
    if best is None:
        kept = [text for node, text, links in blocks if links < 0.5 * len(text)] or [text for _, text, _ in blocks]
        return "\n".join(kept)
    # A container inside the article (a section of it) must not win over the whole article.
    up = best
    while up is not None:
        if up.tag in ("article", "main") and not up.off:
            best = up
        up = up.parent
    kept_siblings = {id(best)}
    if best.parent is not None:
        siblings = [n for n in nodes if n.parent is best.parent and not n.off and n.text]
        for node in siblings:
            density = node.links / node.text
            bonus = node.score * (1 - density) >= max(10.0, 0.2 * most)
            prose = node.tag == "p" and density < 0.25 and node.text > 80
            if bonus or prose or node.tag in ("article", "h1"):
                kept_siblings.add(id(node))
        _neighbours(siblings, kept_siblings)
    for node in nodes:
        node.kept = id(node) in kept_siblings or node.parent is not None and node.parent.kept
    return "\n".join(text for node, text, _ in blocks if node.kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.chunks(batches, "html"):
        texts = [main_text(x) for x in K.strings(batch.column("html"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; the whole page is read, nothing is cut."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract,
        "page_id long, url string, text string, n_chars long")
