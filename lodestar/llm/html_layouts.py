"""A seeded generator of web pages of many layouts, whose main text carries a mark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The character that begins every block of main text in generated pages.
MARK = "⁣"
_PARTS = "an er on th re in st al le ti se ro na mi co de la ve ka su".split()


def is_main(text: str) -> bool:
    return MARK in text


class _Maker:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def pick(self, *of):
        return of[self.rng.integers(len(of))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, n: int) -> str:
        drawn = ["".join(self.rng.choice(_PARTS, self.rng.integers(1, 4))) for _ in range(max(1, n))]
        for i in range(0, len(drawn), int(self.rng.integers(5, 14))):
            drawn[i] = drawn[i].capitalize()
            if i:
                drawn[i - 1] += self.pick(".", ".", ",", "!")
        return " ".join(drawn)

    def prose(self) -> str:
        return self.words(int(self.rng.lognormal(3.2, 0.9)) + 1) + "."

    def links(self, n: int, item: str = "li") -> str:
        inside = "".join(f'<{item}><a href="/{i}">{self.words(int(self.rng.integers(1, 4)))}</a></{item}>' for i in range(n))
        return f"<ul>{inside}</ul>" if item == "li" else inside

    def hint(self, *names: str) -> str:
        if self.chance(0.15):
            return ""
        name = self.pick(*names)
        return f' {self.pick("class", "class", "id")}="{self.pick(name, name, name + " " + self.words(1).lower(), "site-" + name, name + "-box")}"'

    def nav(self) -> str:
        tag = self.pick("nav", "nav", "div", "header")
        mark = self.hint("menu", "nav", "navbar", "breadcrumb") if tag != "nav" or self.chance(0.4) else ""
        return f"<{tag}{mark}>{self.links(int(self.rng.integers(2, 12)), self.pick('li', 'li', 'span'))}</{tag}>"

    def header(self) -> str:
        tag = self.pick("header", "header", "div")
        title = self.pick("h1", "h2", "p", "div")
        more = self.nav() if self.chance(0.4) else ""
        return f"<{tag}{self.hint('header', 'masthead', 'top', 'logo', 'branding')}><{title}>{self.words(3)}</{title}><p>{self.words(int(self.rng.integers(3, 14)))}</p>{more}</{tag}>"

    def footer(self) -> str:
        tag = self.pick("footer", "footer", "div")
        body = self.pick("", "&copy; ") + self.pick("", "site.example ") + "&middot; " + self.prose()
        if self.chance(0.4):
            body = f"<p>{body}</p>" + self.links(int(self.rng.integers(2, 8)))
        return f"<{tag}{self.hint('footer', 'bottom', 'copyright') if tag == 'div' or self.chance(0.3) else ''}>{body}</{tag}>"

    def advert(self) -> str:
        tag = self.pick("div", "div", "aside", "section", "p")
        mark = f' class="{self.pick("ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner")}"'
        body = self.prose() if self.chance(0.6) else f'<a href="/x">{self.words(int(self.rng.integers(3, 20)))}</a>'
        return f"<{tag}{mark}>{body}</{tag}>"

    def notice(self) -> str:
        return f'<div class="{self.pick("cookie-notice", "notice", "alert", "consent", "popup", "modal", "privacy")}"><p>{self.prose()}</p><button>OK</button></div>'

    def form(self) -> str:
        mark = self.hint("newsletter", "search", "login", "subscribe")
        return f"<form{mark}><label>{self.words(3)}</label><input name=q><p>{self.words(int(self.rng.integers(3, 20)))}</p><button>{self.words(1)}</button></form>"

    def side(self) -> str:
        tag = self.pick("aside", "aside", "div", "section")
        body = f"<h3>{self.words(2)}</h3>" + self.links(int(self.rng.integers(2, 9)))
        for _ in range(int(self.rng.integers(0, 4))):
            body += f"<div><h4><a href=/t>{self.words(5)}</a></h4><p>{self.prose()}</p></div>"
        mark = f' class="{self.pick("sidebar", "related", "widget", "recommended", "popular", "teaser")}"' if tag != "aside" or self.chance(0.4) else ""
        return f"<{tag}{mark}>{body}</{tag}>"

    def talk(self) -> str:
        tag, item = self.pick(("section", "div"), ("div", "article"), ("ol", "li"), ("div", "div"), ("section", "article"))
        said = "".join(f'<{item}{self.pick("", " class=comment", " class=reply")}><p>{self.words(2)}</p><p>{self.prose()}</p></{item}>' for _ in range(int(self.rng.integers(1, 9))))
        return f'<{tag} {self.pick("class", "id")}="{self.pick("comments", "comment-list", "discussion", "replies", "reader-comments", "respond")}"><h3>{self.words(1)}</h3>{said}</{tag}>'

    def inline(self, text: str) -> str:
        words = text.split(" ")
        if len(words) > 4 and self.chance(0.4):
            i = int(self.rng.integers(1, len(words) - 2))
            tag = self.pick('a href="/w"', "b", "em", "i", "span", "strong")
            words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
        return " ".join(words)

    def block(self) -> str:
        kind = self.rng.random()
        text = MARK + self.inline(self.prose())
        if kind < 0.74:
            return f"<p>{text}" + ("</p>" if self.chance(0.85) else "")
        if kind < 0.82:
            return f"<{(h := self.pick('h2', 'h3'))}>{MARK}{self.words(4)}</{h}>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{MARK}{self.inline(self.prose())}</li>" for _ in range(int(self.rng.integers(2, 7)))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.95:
            return f"<p><b>{text}<br>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{text}</figcaption></figure>"
        return "<table>" + "".join(f"<tr><td>{MARK}{self.words(2)}</td><td>{MARK}{self.words(3)}</td></tr>" for _ in range(int(self.rng.integers(2, 6)))) + "</table>"

    def share(self) -> str:
        return f'<div class="{self.pick("share", "social", "sharing")}">{self.links(3, "span")}</div>'

    def article(self) -> str:
        n = int(self.rng.choice([1, 1, 2, 3, 4, 6, 10, 20, 40]))
        body = [self.block() for _ in range(n)]
        if self.chance(0.1):
            body = [f"<p>{MARK}{self.words(int(self.rng.integers(1, 9)))}</p>"]
        for make, p in ((self.advert, 0.3), (self.share, 0.25), (self.notice, 0.06), (self.form, 0.1), (self.side, 0.1)):
            if self.chance(p):
                body.insert(int(self.rng.integers(0, len(body) + 1)), make())
        title = f"<h1>{MARK}{self.words(int(self.rng.integers(1, 12)))}</h1>" if self.chance(0.8) else ""
        if self.chance(0.15) and title:
            title = f"<header>{title}</header>"
        text = title + "".join(body)
        if self.chance(0.25):
            text = f"<div{self.hint('content', 'entry', 'body', 'text', 'post')}>{text}</div>"
        if self.chance(0.15):
            text += self.talk()
        wrap = self.rng.random()
        if wrap < 0.55:
            return f"<article{self.hint('post', 'entry', 'story') if self.chance(0.3) else ''}>{text}</article>"
        if wrap < 0.7:
            return f"<main>{text}</main>"
        if wrap < 0.92:
            return f"<div{self.hint('content', 'main', 'article', 'post', 'entry-content', 'story')}>{text}</div>"
        return f"<section>{text}</section>" if wrap < 0.97 else text

    def page(self) -> str:
        if self.chance(0.02):
            return MARK + self.prose()
        before = [make() for make, p in ((self.notice, 0.2), (self.header, 0.4), (self.nav, 0.8), (self.form, 0.1), (self.advert, 0.5)) if self.chance(p)]
        after = [make() for make, p in ((self.side, 0.35), (self.talk, 0.35), (self.advert, 0.2), (self.form, 0.2), (self.footer, 0.85)) if self.chance(p)]
        if self.chance(0.3):
            self.rng.shuffle(before)
        if self.chance(0.15) and after:
            before.insert(0, after.pop(0))
        body = "".join(before) + self.article() + "".join(after)
        if self.chance(0.3):
            body = f"<div{self.hint('page', 'wrapper', 'container')}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{margin:0}}</style></head><body>{body}" + ("</body></html>" if self.chance(0.9) else "")


def pages(n: int, seed: int) -> Iterator[str]:
    """``n`` pages; the same for the same seed."""
    maker = _Maker(np.random.default_rng(seed))
    for _ in range(n):
        yield maker.page()
