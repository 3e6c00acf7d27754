"""Pages with known main text, made from layouts, to train the extraction model on.

No table of pages says which elements are main text, so the model learns from
made-up pages: a fixed number of them (``PAGES``) with a fixed seed, each a
random mix of layout, element names, attribute names and text lengths.
"""

from __future__ import annotations

import random

PAGES = 800

# Names that sites give to parts of a page.
MAIN = "content main article post entry story body text article-body post-content entry-content main-content page hentry"
SIDE = {
    "nav": "nav menu navbar navigation main-menu topnav site-nav",
    "header": "header masthead site-header top-bar branding banner",
    "footer": "footer site-footer bottom colophon copyright legal",
    "aside": "sidebar aside widget-area right-column rail secondary widget",
    "ad": "ad ads advert advertisement ad-slot sponsored sponsor promo banner-ad adsense",
    "notice": "cookie cookie-notice notice consent gdpr alert popup modal overlay banner-notice",
    "form": "search search-form login newsletter subscribe signup contact-form feedback",
    "comments": "comments comment-list comment reader-comments replies discussion disqus responses",
    "related": "related recommended more-stories teaser read-more trending popular",
    "share": "share social social-links sharing buttons toolbar follow",
    "crumbs": "breadcrumb breadcrumbs pagination pager toc",
}


class Maker:
    """Builds one page; ``labels`` says for each of its elements, in page order, whether main text lies in it."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.labels: list[bool] = [True]  # the html element
        syllables = ["".join(self.r.choice(s) for s in ("bcdfglmnprstv", "aeiouéü", "nrstl")) for _ in range(60)]
        self.words = ["".join(self.r.choices(syllables, k=self.r.choice((1, 1, 2, 2, 3)))) for _ in range(400)]

    def say(self, low: int, high: int) -> str:
        out = self.r.choices(self.words, k=self.r.randint(low, high))
        out = [w + ("," if self.r.random() < 0.08 else "") for w in out]
        return " ".join(out).capitalize()

    def prose(self, most: int) -> str:
        sentences = self.r.randint(1, most)
        return " ".join(self.say(1, 22).rstrip(",") + "." for _ in range(sentences))

    def el(self, tag: str, label: bool, inside, attrs: str = "") -> str:
        """``inside`` is text or a function that gives it; its elements follow this one."""
        self.labels.append(label)
        return f"<{tag}{attrs}>{inside() if callable(inside) else inside}</{tag}>"

    def named(self, names: str, always: float = 0.75) -> str:
        if self.r.random() > always:
            return ""
        return f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(names.split())}"'

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.choice(self.words)}">{self.say(low, high)}</a>'

    def links(self, low: int, high: int, tag: str = "ul", wide: int = 3) -> str:
        count = self.r.randint(low, high)
        return self.el(tag, False, lambda: "".join(self.el("li", False, self.link(1, wide)) for _ in range(count)))

    def side(self, kind: str) -> str:
        """A part that is not main text."""
        r = self.r
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        semantic = own and r.random() < 0.6
        tag = own if semantic else r.choice(("div", "div", "section", "aside" if kind in ("related", "ad") else "div"))
        attrs = self.named(SIDE[kind], 0.5 if semantic else 0.97)

        def inside() -> str:
            if kind == "nav" or kind == "crumbs":
                return self.links(2, 9, r.choice(("ul", "ul", "ol"))) if r.random() < 0.7 else " | ".join(
                    self.link() for _ in range(r.randint(2, 9))
                )
            if kind == "header":
                name = self.el(r.choice(("h1", "div", "p")), False, self.link(1, 4) if r.random() < 0.5 else self.say(1, 4))
                return name + (self.el("p", False, self.say(3, 10)) if r.random() < 0.5 else "") + (
                    self.side("nav") if r.random() < 0.6 else ""
                )
            if kind == "footer":
                note = f"&copy; {self.r.choice(self.words)}.example &middot; {self.prose(2)}"
                if r.random() < 0.5:
                    return note
                return self.el("p", False, note) + (self.links(2, 6) if r.random() < 0.5 else "")
            if kind == "aside":
                return "".join(
                    self.el("h3", False, self.say(1, 3))
                    + (self.links(2, 6, wide=8) if r.random() < 0.6 else self.el("p", False, self.prose(3)))
                    for _ in range(r.randint(1, 3))
                )
            if kind == "form":
                return (self.el("p", False, self.prose(2)) if r.random() < 0.5 else "") + (
                    self.el("label", False, self.say(1, 2), ' class="field"') if r.random() < 0.3 else self.say(1, 3)
                ) + '<input type="text"><button>' + self.say(1, 2) + "</button>"
            if kind == "comments":
                count = r.randint(1, 8)
                item = r.choice(("li", "div", "article"))
                one = lambda: self.el(
                    item, False,
                    lambda: (self.el("p", False, self.say(1, 3)) if r.random() < 0.4 else "") + self.el("p", False, self.prose(6)),
                    self.named("comment reply comment-body response", 0.6),
                )
                title = self.el("h3", False, self.say(1, 3)) if r.random() < 0.7 else ""
                if item == "li":
                    return title + self.el("ol", False, lambda: "".join(one() for _ in range(count)))
                return title + "".join(one() for _ in range(count))
            if kind == "related":
                return self.el("h3", False, self.say(1, 3)) + (
                    self.links(2, 6, wide=9) if r.random() < 0.6
                    else "".join(self.el("p", False, self.link(3, 9) + " " + self.prose(1)) for _ in range(r.randint(1, 4)))
                )
            if kind == "share":
                return " ".join(self.link(1, 1) for _ in range(r.randint(2, 5)))
            return self.prose(3) if r.random() < 0.5 else self.el("p", False, self.prose(3))

        return self.el(tag, False, inside, attrs)

    def paragraph(self) -> str:
        text = self.prose(self.r.choice((1, 1, 3, 8)))
        if self.r.random() < 0.2:
            text = f"<b>{text}</b>"
        if self.r.random() < 0.15:
            text += " " + self.link(1, 6) + " " + self.prose(2)
        if self.r.random() < 0.06:
            text = self.el("span", True, text, self.named("dropcap lead intro highlight", 1.0))
        return text

    def block(self) -> str:
        r = self.r.random()
        if r < 0.74:
            # Evaluated first to last, so that the paragraph's element precedes those in it.
            return self.el("p", True, self.paragraph, self.named("lead intro text paragraph", 0.08))
        if r < 0.82:
            return self.el(self.r.choice(("h2", "h3", "h4")), True, self.say(1, 9))
        if r < 0.88:
            count = self.r.randint(1, 7)
            tag = self.r.choice(("ul", "ol"))
            return self.el(tag, True, lambda: "".join(self.el("li", True, self.prose(2)) for _ in range(count)))
        if r < 0.92:
            return self.el("blockquote", True, lambda: self.el("p", True, self.prose(4)))
        if r < 0.95:
            return self.el("pre", True, self.prose(3))
        if r < 0.97:
            rows = self.r.randint(1, 4)
            row = lambda: self.el("tr", True, lambda: "".join(self.el("td", True, self.say(1, 4)) for _ in range(3)))
            return self.el("table", True, lambda: "".join(row() for _ in range(rows)))
        return self.el("div", True, self.prose(4))

    def article(self) -> str:
        r = self.r
        count = r.choice((0, 0, 1, 1, 1, 2, 3, 5, 8, 13, 20))
        inner = ["ad", "share", "related", "form", "aside", "crumbs", "comments", "footer", "notice"]

        def blocks() -> str:
            out = []
            if r.random() < 0.8:
                head = lambda: self.el(r.choice(("h1", "h1", "h2")), True, self.say(1, 12))
                out.append(self.el("header", True, head, self.named("entry-header title", 0.4)) if r.random() < 0.15 else head())
            if not count:
                out.append(self.el("p", True, self.paragraph))
            for _ in range(count):
                out.append(self.block())
                if r.random() < 0.05:
                    out.append(self.side(r.choice(inner)))
            if r.random() < 0.3:
                out.append(self.side(r.choice(inner)))
            return "".join(out)

        kind = r.random()
        if kind < 0.5:
            tag, attrs = "article", self.named(MAIN, 0.4)
        elif kind < 0.7:
            tag, attrs = "main", self.named(MAIN, 0.4)
        else:
            tag, attrs = r.choice(("div", "div", "section", "td")), self.named(MAIN, 0.9)
        tag = "div" if tag == "td" else tag
        if r.random() < 0.25:
            wrapped = lambda: self.el("div", True, blocks, self.named(MAIN, 0.6))
            return self.el(tag, True, wrapped, attrs)
        return self.el(tag, True, blocks, attrs)

    def page(self) -> str:
        r = self.r

        def around() -> str:
            before = [k for k in ("header", "nav", "crumbs", "notice", "ad", "form", "aside") if r.random() < 0.4]
            after = [k for k in ("comments", "related", "share", "aside", "ad", "form", "notice", "footer") if r.random() < 0.4]
            out = [self.side(k) for k in before] + [self.article()]
            return "".join(out + [self.side(k) for k in after])

        def body() -> str:
            if r.random() < 0.35:
                wrap = self.named("wrapper container page site layout row", 0.8)
                first = self.side("header") if r.random() < 0.5 else ""
                middle = self.el("div", True, around, wrap)
                return first + middle + (self.side("footer") if r.random() < 0.6 else "")
            return around()

        head = self.el("head", False, lambda: f"<title>{self.say(1, 9)}</title><script>var a = '<p>';</script>")
        return f"<!DOCTYPE html><html>{head}{self.el('body', True, body)}</html>"


def training_pages(count: int = PAGES, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """(html, label of each element in page order)."""
    out = []
    for k in range(count):
        maker = Maker(seed * 1_000_003 + k)
        out.append((maker.page(), maker.labels))
    return out
