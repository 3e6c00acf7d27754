"""A small tolerant reader of HTML: elements with features, and text runs in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("button script style noscript template iframe svg textarea title xmp noembed select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var object math semantics annotation mstyle mrow mi mn mo ms mtext mspace mfrac msqrt "
    "mroot msub msup msubsup munder mover munderover mmultiscripts mpadded mphantom menclose merror mtable mtr mtd".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
# An element on the left ends an open one on the right, unless one of the scope stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""(?:^|[\s/])(class|id|role|itemprop|aria-label|rel)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


# Shared by the elements without any: pages have hundreds of thousands.
NO_TOKENS: list[str] = []


def attribute_tokens(attrs: str) -> list[str]:
    """Lower-case words of the attributes that name what an element is for."""
    found = []
    for _, a, b, c in _ATTR.findall(attrs):
        parts = re.sub(r"([a-z])([A-Z])", r"\1 \2", html.unescape(a or b or c)).lower()
        found += [w for w in re.split(r"[^a-z]+", parts) if w]
    return found or NO_TOKENS


@dataclass
class Page:
    """Elements in page order (a parent before its children) and what lies between them."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tokens: list[list[str]] = field(default_factory=list)
    inline: list[bool] = field(default_factory=list)
    # (element, text, in a link), or (element, None, False) where a block begins or ends.
    runs: list[tuple[int, str | None, bool]] = field(default_factory=list)

    def add(self, tag: str, parent: int, tokens: list[str], inline: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tokens.append(tokens)
        self.inline.append(inline)
        return len(self.tag) - 1


def read_page(source: str) -> Page:
    """Elements and text of any string; markup that never ends, or ends twice, is put right."""
    page = Page()
    root = page.add("html", -1, NO_TOKENS, False)
    open_tags: list[tuple[str, int]] = [("html", root)]
    links = at = 0
    never_ends: set[str] = set()  # names of which no end follows

    def text(upto: int) -> None:
        if upto > at:
            page.runs.append((open_tags[-1][1], html.unescape(source[at:upto]), links > 0))

    def mark() -> None:
        page.runs.append((open_tags[-1][1], None, False))

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(open_tags) > depth:
            name, _ = open_tags.pop()
            links -= name == "a"

    def close(names: set[str] | frozenset, scope: set[str] | frozenset) -> None:
        """End the outermost open element of ``names`` that no element of ``scope`` hides."""
        found = 0
        for k in range(len(open_tags) - 1, 0, -1):
            if open_tags[k][0] in scope:
                break
            if open_tags[k][0] in names:
                found = k
        if found:
            pop_to(found)
            mark()

    while token := _TOKEN.search(source, at):
        text(token.start())
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if token["end"]:
            hidden = INLINE if name in INLINE else None
            for k in range(len(open_tags) - 1, 0, -1):
                if open_tags[k][0] == name:
                    block = name not in INLINE
                    if block:
                        mark()
                    pop_to(k)
                    if block:
                        mark()
                    break
                if hidden and open_tags[k][0] not in hidden:
                    break
            else:
                if name in CLOSES_P:
                    mark()
            continue
        if name == "br" or name == "wbr":
            page.runs.append((open_tags[-1][1], " " if name == "br" else "", links > 0))
            continue
        if name in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "article", "section", "div", "li", "blockquote", "body"})
        if name in ENDS:
            close(*ENDS[name])
        if name in VOID:
            if name == "hr":
                mark()
            continue
        if name in RAW:
            end = None
            if name not in never_ends:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            if not end:
                never_ends.add(name)
            if end or name in ("script", "style"):  # others may be left open by mistake
                at = end.end() if end else len(source)
            continue
        tokens = attribute_tokens(token["attrs"])
        if name == "html":
            page.tokens[root] = tokens
            continue
        if name in INLINE:
            # A plain inline element is part of its block; one with a purpose is an element of its own.
            owner = page.add(name, open_tags[-1][1], tokens, True) if tokens else open_tags[-1][1]
            open_tags.append((name, owner))
            links += name == "a"
            continue
        mark()
        open_tags.append((name, page.add(name, open_tags[-1][1], tokens, False)))
        mark()
    text(len(source))
    return page


def blocks(page: Page, kept) -> list[str]:
    """Text of the kept elements: a block a string, white space inside it one space."""
    out, now = [], []
    for element, piece, _ in page.runs:
        if piece is None:
            if now:
                out.append(" ".join("".join(now).split()))
                now = []
        elif kept[element]:
            now.append(piece)
    if now:
        out.append(" ".join("".join(now).split()))
    return [b for b in out if b]
