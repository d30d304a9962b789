"""A small HTML reader: decision nodes with what the extraction model needs, and text pieces in page order.

Elements that only format text (b, em, a, ...) are no nodes; their text belongs to the node around them. A block is
the text between two starts or ends of block elements.

Time is in proportion to the length of the text, whatever it holds: a tag is read once, up to the first > outside of quoted
values or, as the standard has it, up to the end; where an end tag or a start tag closes others, the place of the last open
element of each name is at hand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLING_ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tbody thead", "tbody": "tbody thead"}
SIBLING_STOPS = "ul ol dl table"

#: Words of class, id, role and the like, by what they speak for.
TOKENS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager tabs toc skip",
    "header": "header masthead banner topbar branding logo hero",
    "footer": "footer foot copyright legal colophon contentinfo imprint bottom",
    "side": "sidebar aside side rail widget widgets complementary secondary",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense dfp outbrain taboola",
    "notice": "cookie cookies notice notices consent gdpr alert popup modal overlay warning disclaimer announcement toast dialog paywall",
    "comment": "comment comments commentlist reply replies respond disqus discussion responses reader readers",
    "form": "form search searchbox newsletter subscribe subscription signup login register contact poll",
    "share": "share sharing social follow facebook twitter tweet like buttons",
    "related": "related recommend recommended recommendations more teaser teasers trending popular latest also next prev previous tags",
    "main": "article content contents post entry story main maincontent body text prose blog page single hentry articlebody",
}
TOKEN_NAMES = tuple(TOKENS)
TOKEN_BIT = {word: 1 << i for i, words in enumerate(TOKENS.values()) for word in words.split()}
TAG_BIT = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "dialog": "notice", "article": "main", "main": "main"}
HIDDEN = 1 << len(TOKEN_NAMES)

TAGS = tuple("other html head body div section article main p h1 h2 h3 h4 ul ol li table tr td nav header footer aside form blockquote pre figure figcaption span dl button input".split())
TAG_ID = {t: i for i, t in enumerate(TAGS)}

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: What stands in a tag up to its end. Quotes count after an equals sign if they are closed.
BODY = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+""")
ATTR = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?", re.S)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
#: Attribute texts up to this length are kept with their bits.
SHORT = 500

_bits: dict[str, int] = {}


def attribute_bits(raw: str) -> int:
    """What the attribute text of a tag speaks for."""
    known = _bits.get(raw)
    if known is None:
        known = 0
        for name, value in ATTR.findall(raw):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role", "itemprop", "aria-label", "data-role", "data-component"):
                for word in WORDS.findall(value):
                    known |= TOKEN_BIT.get(word.lower(), 0)
            elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "") or name == "aria-hidden" and value == "true":
                known |= HIDDEN
        if len(_bits) > 20_000:
            _bits.clear()
        if len(raw) <= SHORT:
            _bits[raw] = known
    return known


@dataclass
class Page:
    """Nodes in document order, as columns, and text pieces as (node, block, text)."""

    tag: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)  # the first node after the subtree
    depth: list[int] = field(default_factory=list)
    bits: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)  # bits of all ancestors
    index: list[int] = field(default_factory=list)  # among the parent's nodes
    children: list[int] = field(default_factory=list)
    before: list[int] = field(default_factory=list)  # tag of the sibling before
    text: list[int] = field(default_factory=list)  # characters of own text
    links: list[int] = field(default_factory=list)  # of those, in links
    marks: list[int] = field(default_factory=list)  # sentence marks and commas
    anchors: list[int] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    pieces: list[tuple[int, int, str]] = field(default_factory=list)


def parse(html: str) -> Page:
    """Read any text as HTML; unclosed and stray tags do no harm."""
    page = Page()
    last_child: list[int] = []

    def open_node(tag: str, raw: str) -> int:
        n, up = len(page.tag), stack[-1][1] if stack else -1
        bits = attribute_bits(raw) if raw else 0
        if tag in TAG_BIT:
            bits |= TOKEN_BIT[TAG_BIT[tag]]
        tag_id = TAG_ID.get(tag, 0)
        page.tag.append(tag_id)
        page.parent.append(up)
        page.end.append(0)
        page.depth.append(page.depth[up] + 1 if up >= 0 else 0)
        page.bits.append(bits)
        page.above.append(page.above[up] | page.bits[up] if up >= 0 else 0)
        page.index.append(page.children[up] if up >= 0 else 0)
        page.before.append(last_child[up] if up >= 0 else 0)
        page.children.append(0)
        last_child.append(0)
        if up >= 0:
            page.children[up] += 1
            last_child[up] = tag_id
        for column in (page.text, page.links, page.marks, page.anchors):
            column.append(0)
        page.attrs.append(raw)
        return n

    # Open elements: name, node, and the place of the last one that is no span; and the places of each name.
    stack: list[tuple[str, int, int]] = []
    places: dict[str, list[int]] = {}
    unclosed: set[str] = set()
    block, in_link, pos, size = 0, 0, 0, len(html)

    def push(name: str, node: int) -> None:
        places.setdefault(name, []).append(len(stack))
        stack.append((name, node, stack[-1][2] if name == "span" and stack else len(stack)))

    def last(names: str) -> int:
        return max((places[x][-1] for x in names.split() if places.get(x)), default=-1)

    def say(raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        node = stack[-1][1]
        n = len(text)
        page.pieces.append((node, block, text))
        page.text[node] += n
        if in_link:
            page.links[node] += n
        page.marks[node] += text.count(".") + text.count(",")

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            name, node, _ = stack.pop()
            places[name].pop()
            if not stack or stack[-1][1] != node:  # a span without attributes stands for the node around it
                page.end[node] = len(page.tag)

    push("#root", open_node("html", ""))
    while pos < size:
        start = html.find("<", pos)
        if start < 0:
            say(html[pos:])
            break
        closing = html.startswith("/", start + 1)
        m = NAME.match(html, start + 1 + closing)
        other = html[start + 1 : start + 2]
        if m is None and other not in ("!", "?"):  # no tag; the sign is text
            end = html.find("<", start + 1)
            say(html[pos : end if end > 0 else size])
            pos = end if end > 0 else size
            continue
        if start > pos:
            say(html[pos:start])
        if m is None:
            mark = "-->" if html.startswith("<!--", start) else ">"
            end = html.find(mark, start + (4 if len(mark) == 3 else 2))
            pos = end + len(mark) if end >= 0 else size
            continue
        body = BODY.match(html, m.end())
        pos = body.end() + 1
        if pos > size:
            break
        name, raw = m.group().lower(), body.group()
        if closing:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in INLINE:
                continue
            if places.get(name):
                close_to(places[name][-1])
            if name != "span":
                block += 1
            continue
        if name in RAW:
            end = None if name in unclosed else ENDS[name].search(html, pos)
            if end is None:
                unclosed.add(name)
            pos = end.end() if end else size if name in ("script", "style") else pos
            continue
        if name == "a":
            in_link += 1
            page.anchors[stack[-1][1]] += 1
            continue
        if name == "br":
            page.pieces.append((stack[-1][1], block, " "))
            continue
        if name in INLINE or name in VOID and name not in ("hr", "input"):
            continue
        if name == "span" and not attribute_bits(raw):
            push(name, stack[-1][1])
            continue
        if name != "span":
            block += 1
            in_link = 0 if name in CLOSES_P else in_link
        if name == "hr":
            continue
        if name in CLOSES_P and stack[stack[-1][2]][0] == "p":
            close_to(stack[-1][2])
        if name in SIBLING_ENDS:
            stop = last(SIBLING_STOPS)
            while (depth := last(SIBLING_ENDS[name])) > stop:
                close_to(depth)
                if name != "tr":
                    break
        n = open_node(name, raw)
        if name in VOID:
            page.end[n] = len(page.tag)
        else:
            push(name, n)
    close_to(0)
    return page
