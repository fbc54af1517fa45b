"""Pages with known main text, made by rule, for fitting the extractor.

A page is a list of parts: (markup, is main text). Markup is nested lists of nodes (tag, attributes, content).
"""

from __future__ import annotations

import numpy as np

SYLLABLES = "ba con der el fi ga hon in jor ka lum mi na or pel qui ra sen ti ur ven wo xi yel za".split()
#: Attribute tokens by what they mark.
MARKS = {
    "nav": "nav menu navbar navigation breadcrumb topbar toc pagination",
    "header": "header masthead banner site-header top-bar logo",
    "footer": "footer copyright colophon bottom site-footer legal",
    "aside": "sidebar related widget recommended popular trending aside side-column",
    "ad": "ad ads advert advertisement promo sponsored sponsor ad-slot",
    "notice": "cookie notice consent alert newsletter subscribe gdpr popup paywall warning",
    "form": "form search login signup contact-form",
    "comment": "comments comment replies reply discussion disqus",
    "share": "share social tags byline meta author-box",
}
MAIN = "content post entry article-body story text main-content article page-body".split()
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}


class Writer:
    """Random pages from a seed."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, lo: int, hi: int) -> str:
        n = int(self.rng.integers(lo, hi + 1))
        out = ["".join(self.pick(SYLLABLES) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n)]
        out = [w + ("," if self.chance(0.08) else "") for w in out]
        return (" ".join(out)).capitalize() + ("." if n > 3 else "")

    def prose(self) -> str:
        return " ".join(self.words(5, 25) for _ in range(int(self.rng.integers(1, 6))))

    def links(self, n: int) -> str:
        items = "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n))
        return f"<ul>{items}</ul>" if self.chance(0.7) else " | ".join(f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n))

    def aside(self, kind: str) -> str:
        """One part that isn't main text."""
        if kind == "nav":
            inner = self.links(int(self.rng.integers(2, 9)))
        elif kind == "footer":
            inner = f"&copy; {self.words(1, 3)} &middot; {self.words(2, 20)}" if self.chance(0.6) else f"<p>{self.words(3, 20)}</p>{self.links(3)}"
        elif kind == "header":
            inner = f"<h2>{self.words(1, 4)}</h2>" + (self.links(4) if self.chance(0.6) else f"<p>{self.words(2, 12)}</p>")
        elif kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input name=q><select><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button>" + (f"<p>{self.words(3, 15)}</p>" if self.chance(0.5) else "")
        elif kind == "comment":
            inner = "".join(f'<div class="{self.pick(MARKS["comment"].split())}"><b>{self.words(1, 2)}</b><p>{self.prose()}</p></div>' for _ in range(int(self.rng.integers(1, 5))))
        elif kind == "aside":
            inner = (f"<h3>{self.words(1, 4)}</h3>" if self.chance(0.7) else "") + (self.links(5) if self.chance(0.5) else f"<p>{self.prose()}</p>")
        else:
            inner = self.words(2, 30) if self.chance(0.5) else f"<p>{self.words(3, 30)}</p>" + (f'<a href="#">{self.words(1, 3)}</a>' if self.chance(0.4) else "")
        tag = TAGS[kind] if kind in TAGS and self.chance(0.6) else self.pick(["div", "div", "section"])
        mark = self.pick(MARKS[kind].split())
        attrs = "" if tag != "div" and tag != "section" and self.chance(0.6) else f' {self.pick(["class", "class", "id"])}="{mark}{self.pick(["", "", " box", " wrap", "-1"])}"'
        return f"<{tag}{attrs} data-x=0>{inner}</{tag}>"

    def body(self) -> str:
        """One piece of main text."""
        r = self.rng.random()
        if r < 0.72:
            p = self.prose()
            if self.chance(0.15):
                return f"<p><b>{p}<br>"  # never closed
            return f"<p>{p}" if self.chance(0.1) else f"<p>{p.replace(' ', ' <a href=/x>', 1) + '</a>' if self.chance(0.1) else p}</p>"
        if r < 0.82:
            return f"<h2>{self.words(2, 8)}</h2>"
        if r < 0.90:
            return "<ul>" + "".join(f"<li>{self.words(3, 15)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>"
        if r < 0.94:
            return f"<blockquote>{self.prose()}</blockquote>"
        if r < 0.97:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<figure><figcaption>{self.words(3, 12)}</figcaption></figure>"

    def page(self) -> str:
        """A page; its parts that aren't main text carry the attribute data-x, which features never see."""
        inner = f"<h1>{self.words(3, 12)}</h1>" + "".join(self.aside(self.pick(["ad", "aside", "share", "notice"])) if self.chance(0.08) else self.body() for _ in range(int(self.rng.integers(1, 14))))
        if self.chance(0.2):  # a very short article
            text = self.words(2, 12)
            inner = f"<h1>{text if self.chance(0.5) else self.words(2, 10)}</h1>" + (f"<p><b>{text}<br>" if self.chance(0.5) else f"<p>{text}</p>")
        if self.chance(0.12):
            inner += self.aside("comment")
        kind = self.rng.random()
        if kind < 0.45:
            main = f"<article>{inner}</article>"
        elif kind < 0.6:
            main = f"<main>{inner}</main>"
        elif kind < 0.93:
            main = f'<div {self.pick(["class", "id"])}="{self.pick(MAIN)}">{inner}</div>'
        else:
            main = f"<div>{inner}</div>"
        before = [self.aside(k) for k in ("header", "nav", "notice", "ad", "form") if self.chance(0.45)]
        after = [self.aside(k) for k in ("aside", "ad", "comment", "form", "notice", "share", "footer") if self.chance(0.4)]
        middle = "".join([*before, main, *after])
        if self.chance(0.3):
            middle = f'<div class="{self.pick(["wrapper", "container", "page", "layout"])}">{middle}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>{middle}</body></html>"
