"""Made pages with known main text, for training and testing the block labeller."""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

SYLLABLES = "an ar be bo ca cha co da de di do el en er es fa ge ha he in is ka la le li lo ma me mi na ne no on or ou pa pe qu ra re ri ro sa se si so ta te ti to un ur va ve vi wa zu é ß ñ ü".split()
MENU = "Home About Contact News Blog Shop Login Search Archive Help Terms Privacy Sitemap Careers Start Kontakt Accueil Inicio".split()
#: Names that pages commonly give their parts.
NAMES = {
    "nav": "nav navbar menu main-menu topnav navigation breadcrumb breadcrumbs mainNav".split(),
    "header": "header site-header masthead banner top branding logo".split(),
    "footer": "footer site-footer bottom copyright legal colophon".split(),
    "aside": "sidebar aside side widget related recommended more-stories right-column rail".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad ad-slot".split(),
    "notice": "cookie cookie-notice notice consent gdpr alert popup modal newsletter subscribe".split(),
    "comments": "comments comment comment-list discussion replies reader-comments disqus".split(),
    "main": "content main article post entry story article-body post-content entry-content body-text text".split(),
    "share": "share social share-buttons tags meta byline toolbar".split(),
}


class Maker:
    def __init__(self, r: random.Random):
        self.r = r
        self.named = r.random() < 0.8  # whether this page's parts bear telling names
        self.semantic = r.random() < 0.7  # whether it uses article, nav, footer and the like
        self.style = r.choice(("", "", "", "shout", "symbols", "again", "cells"))  # of the article's texts

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 20) -> str:
        mark = self.r.choice(("", "", "", ",", " &", "***", '"'))
        return (self.words(low, high) + mark + " " + self.words(1, 5)).capitalize() + self.r.choice("....!?")

    def styled(self, text: str) -> str:
        words = text.split(" ")
        if self.style == "shout":
            return " ".join(w.upper() + "!!" for w in words)
        if self.style == "symbols":
            return " ".join(w + self.r.choice(("%%%", "$$$", "&&&", "***", "###")) for w in words)
        if self.style == "again":
            return " ".join(w for x in words[: self.r.randint(1, 6)] for w in [x] * self.r.randint(2, 12))
        if self.style == "cells":
            return " | ".join(words)
        return text

    def open(self, kind: str, tags: tuple[str, ...]) -> tuple[str, str]:
        """Begin and end tag of a part of a page."""
        tag = self.r.choice(tags) if self.semantic else "div"
        name = ""
        if self.named and (tag == "div" or self.r.random() < 0.5):
            name = f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(NAMES[kind])}"'
        return f"<{tag}{name}>", f"</{tag}>"

    def part(self, kind: str, tags: tuple[str, ...], inner: str) -> str:
        a, b = self.open(kind, tags)
        return a + inner + b

    def links(self, low: int, high: int) -> str:
        names = [self.r.choice((self.r.choice(MENU), self.word().capitalize(), self.words(1, 4))) for _ in range(self.r.randint(low, high))]
        own = [f'<a href="/{html.escape(n)}">{html.escape(n)}</a>' for n in names]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in own) + "</ul>" if self.r.random() < 0.7 else self.r.choice((" | ", " ", "<br>")).join(own)

    def inline(self, text: str) -> str:
        """Escaped, at times with inline elements around a few words."""
        words = html.escape(text, quote=False).split(" ")
        if len(words) > 4 and self.r.random() < 0.3:
            i = self.r.randrange(len(words) - 2)
            tag = self.r.choice(("b", "i", "em", "strong", 'a href="/x"', "span"))
            words[i] = f"<{tag}>{words[i]}"
            words[i + 1] += f"</{tag.split()[0]}>"
        return " ".join(words)

    def article(self) -> tuple[list[str], list[str]]:
        """(elements side by side, texts of the blocks)."""
        main, out = [], []

        def add(tag: str, text: str, end: bool = True) -> None:
            text = self.styled(text)
            main.append(text)
            out.append(f"<{tag}>{self.inline(text)}" + (f"</{tag}>" if end else ""))

        if self.r.random() < 0.85:
            add(self.r.choice(("h1", "h1", "h2")), self.sentence(2, 9))
        for _ in range(self.r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            text = " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 6))))
            kind = self.r.random()
            if kind < 0.68:
                add("p", text, self.r.random() < 0.9)
            elif kind < 0.74:
                out.append(f"<p><b>{html.escape(text, quote=False)}<br>")
                main.append(text)
            elif kind < 0.76:
                cells = [[self.words(1, 3) if self.r.random() < 0.6 else str(self.r.randrange(9999)) for _ in range(self.r.randint(2, 3))] for _ in range(self.r.randint(1, 3))]
                main += [c for row in cells for c in row]
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in row) + "</tr>" for row in cells) + "</table>")
            elif kind < 0.80:
                add(self.r.choice(("h2", "h3")), self.words(1, 6).capitalize())
            elif kind < 0.86:
                items = [self.words(1, 12).capitalize() for _ in range(self.r.randint(2, 5))]
                main += items
                out.append("<ul>" + "".join(f"<li>{html.escape(x)}</li>" for x in items) + "</ul>")
            elif kind < 0.92:
                add("p", text)
                out[-1] = f"<blockquote>{out[-1]}</blockquote>"
            elif kind < 0.96:
                add(self.r.choice(("p", "p", "pre")), self.words(1, 4).capitalize() + ".")
            else:
                add("div" if not self.semantic else "figcaption", text)
        if self.r.random() < 0.05:  # one short line over and over
            line = self.words(1, 3).capitalize() + self.r.choice((".", ""))
            for _ in range(self.r.randint(20, 90)):
                add("p", line)
        return out, main

    def comments(self) -> str:
        each = "".join(f'<div{" class=comment" if self.named else ""}><b>{self.word()}</b><p>{html.escape(self.sentence(3, 14))}</p></div>' for _ in range(self.r.randint(1, 5)))
        return self.part("comments", ("section", "div", "aside"), f"<h3>{self.r.choice(('Comments', 'Kommentare', 'Commentaires', '3 replies'))}</h3>{each}")

    def aside(self) -> str:
        inner = f"<h3>{self.words(1, 3).capitalize()}</h3>" + (self.links(3, 8) if self.r.random() < 0.6 else f"<p>{html.escape(self.sentence())}</p>")
        return self.part("aside", ("aside", "aside", "div"), inner)

    def page(self) -> tuple[str, list[str]]:
        r, out = self.r, ["<!DOCTYPE html><html><head><title>", self.words(2, 8), "</title><style>p{margin:0}</style><script>var t='</p>';if(1<2){}</script></head><body>"]
        maybe = lambda p, make: out.append(make()) if r.random() < p else None
        ad = lambda: self.part("ad", ("div",), r.choice((html.escape(self.sentence(3, 12)), f"<p>{html.escape(self.sentence(3, 12))}</p>", f'<a href="/buy">{self.words(2, 6)}</a>')))
        notice = lambda: self.part("notice", ("div", "aside", "section"), f"<p>{html.escape(self.sentence())}</p>" + r.choice(("", "<button>OK</button>", "<form><input name=e><button>Subscribe</button></form>")))
        maybe(0.2, notice)
        maybe(0.5, lambda: self.part("header", ("header",), r.choice((f"<p>{self.words(1, 5)}</p>", f'<a href="/">{self.word()}</a>', f"<h1>{self.words(1, 3)}</h1><p>{self.words(2, 6)}</p>")) + (self.part("nav", ("nav",), self.links(3, 8)) if r.random() < 0.3 else "")))
        maybe(0.8, lambda: self.part("nav", ("nav",), self.links(3, 9)))
        out.append("<!-- ad 1 -->")
        maybe(0.5, ad)
        maybe(0.15, self.aside)
        wrap = r.random() < 0.4
        if wrap:
            out.append('<div class="wrapper">' if r.random() < 0.5 else "<div>")
        parts, main = self.article()
        if r.random() < 0.06:
            parts, main = [], []
        for _ in range(r.choice((0, 0, 0, 1, 1, 2))):  # what stands between an article's paragraphs and is none of it
            if main and (self.named or r.random() < 0.3):
                share = lambda: self.part("share", ("div",), self.links(2, 4))
                other = r.choice((ad, ad, notice, share, self.aside)) if self.named else (lambda: self.links(3, 6))
                parts.insert(r.randint(1, len(parts)), other())
        body = "".join(parts)
        a, b = self.open("main", ("article", "article", "main"))
        if not self.semantic and not self.named:
            a, b = r.choice((("<div>", "</div>"), ("", ""), (f"<table><tr><td>{self.links(2, 6)}</td><td>", "</td></tr></table>")))
        tail = self.part("share", ("div",), self.links(2, 4)) if r.random() < 0.2 else ""
        out.append(a + body + tail + b)
        maybe(0.3, self.comments)
        maybe(0.35, self.aside)
        if wrap:
            out.append("</div>")
        maybe(0.1, lambda: f"<form{' class=search' if self.named else ''}><label>{self.words(1, 3)}</label><input><button>Go</button></form>")
        maybe(0.15, ad)
        maybe(0.85, lambda: self.part("footer", ("footer",), r.choice((f"&copy; {self.word()}.example.com &middot; {html.escape(self.sentence(2, 9))}", f"<p>&copy; 2024 {self.words(1, 4)}</p>" + self.links(2, 5), f"{html.escape(self.sentence())}\n{html.escape(self.sentence(2, 6))}"))))
        maybe(0.2, notice)
        if r.random() < 0.85:
            out.append("</body></html>")
        return "".join(out), main


def training_pages(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """(page, the main text's blocks)."""
    r = random.Random(seed)
    for _ in range(n):
        source, main = Maker(r).page()
        yield source, {" ".join(m.split()) for m in main}
