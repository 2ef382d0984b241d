"""Web pages written by rule, with the texts that belong to their articles: the labelled sample for the trees."""

from __future__ import annotations

import random
from collections.abc import Iterator

_SYLLABLES = "ka lo mi ten ra su vel or an thi es du par con ne ti gro ba fer ul ish men".split()
#: Markup that sites commonly use for each part of a page, as (opening, closing) tags.
_ARTICLE = [
    ("<article>", "</article>"), ('<article class="post">', "</article>"), ("<main><article>", "</article></main>"), ('<main id="main">', "</main>"), ('<div class="article-body">', "</div>"),
    ('<div id="content">', "</div>"), ('<div class="post-content entry">', "</div>"), ('<section class="story">', "</section>"), ('<div class="main-text">', "</div>"),
    ('<div class="x1">', "</div>"), ("<div>", "</div>"), ('<div itemprop="articleBody">', "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("", ""), ("<section>", "</section>"),
]
_NAV = [("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<div id="navbar">', "</div>"), ('<nav class="main-nav" role="navigation">', "</nav>"), ('<div class="breadcrumbs">', "</div>"), ("<div>", "</div>"), ('<div class="pagination">', "</div>")]
_HEADER = [("<header>", "</header>"), ('<div class="header">', "</div>"), ('<div id="masthead">', "</div>"), ('<header class="site-header">', "</header>"), ('<div class="top-banner">', "</div>")]
_FOOTER = [("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="colophon">', "</div>"), ('<footer class="site-footer">', "</footer>"), ('<div class="copyright legal">', "</div>")]
_SIDE = [("<aside>", "</aside>"), ("<aside>", "</aside>"), ("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<aside class="related">', "</aside>"), ('<div id="right-rail" class="widget">', "</div>"), ('<section class="recommended">', "</section>"), ('<div class="more-stories">', "</div>")]
_AD = [('<div class="ad">', "</div>"), ('<div class="advert">', "</div>"), ('<div id="ads-top">', "</div>"), ('<aside class="sponsored">', "</aside>"), ('<p class="promo">', "</p>"), ('<section class="advertisement">', "</section>"), ('<div class="ad-slot">', "</div>")]
_NOTICE = [('<div class="cookie-notice">', "</div>"), ('<div id="consent">', "</div>"), ('<div class="alert">', "</div>"), ('<div class="gdpr modal" role="dialog">', "</div>"), ('<p class="notice">', "</p>"), ('<section class="announcement">', "</section>"), ('<div class="cookie-banner">', "</div>"), ("<dialog>", "</dialog>")]
_COMMENTS = [('<section class="comments">', "</section>"), ('<div id="comments">', "</div>"), ('<div class="comment-list">', "</div>"), ('<section id="disqus_thread">', "</section>"), ('<div class="reader-comments">', "</div>"), ('<div class="responses discussion">', "</div>")]
_FORM = [('<form action="/s">', "</form>"), ('<form class="newsletter">', "</form>"), ('<div class="subscribe"><form>', "</form></div>"), ('<form id="login">', "</form>")]


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.kept, self.count = rng, set(), 0

    def words(self, low: int, high: int) -> str:
        r = self.rng
        self.count += 1
        n = r.randint(low, high)
        out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(n)]
        for k in range(r.randint(4, 14), n, 11):
            out[k - 1] += r.choice([",", ".", "."])
        return " ".join([out[0].capitalize() + str(self.count), *out[1:]]) + r.choice([".", ".", ""])

    def text(self, low: int, high: int, kept: bool) -> str:
        t = self.words(low, high)
        if kept:
            self.kept.add(t)
        return t

    def link(self, low=1, high=3) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{self.words(low, high)}</a>'

    def paragraph(self, kept: bool) -> str:
        r = self.rng
        low, high = r.choice([(2, 8), (8, 30), (30, 90), (30, 90), (60, 200)])
        t = self.text(low, high, kept)
        if r.random() < 0.15 and " " in t:
            a, b = t.split(" ", 1)
            t = f'<a href="/x">{a}</a> {b}' if r.random() < 0.5 else f"<b>{a}</b> {b}"
        style = r.random()
        if style < 0.08:
            return f"<p>{t}<p>" if r.random() < 0.5 else f"<p><b>{t}<br>"
        return f"<div>{t}</div>" if style < 0.12 else f"<p>{t}</p>"

    def links(self) -> str:
        r = self.rng
        items = [self.link() for _ in range(r.randint(2, 9))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return r.choice([" | ", " ", "<br>"]).join(items)

    def part(self, kinds, inner: str) -> str:
        a, b = self.rng.choice(kinds)
        return f"{a}{inner}{b}"

    def aside(self) -> str:
        r = self.rng
        inner = (f"<h3>{self.words(1, 4)}</h3>" if r.random() < 0.6 else "") + r.choice([self.links, self.links, lambda: "".join(f"<p>{self.words(5, 40)}</p>" for _ in range(r.randint(1, 3))), lambda: self.words(3, 40)])()
        return self.part(_SIDE, inner)

    def ad(self) -> str:
        t = self.words(2, 30)
        return self.part(_AD, self.rng.choice([t, t, f'<a href="/b">{t}</a>']))

    def notice(self) -> str:
        t = self.words(4, 45)
        return self.part(_NOTICE, self.rng.choice([t, f"{t} {self.link()}", f"{t}<button>{self.words(1, 2)}</button>"]))

    def comments(self) -> str:
        r = self.rng
        items = []
        for _ in range(r.randint(1, 6)):
            body = f"<p>{self.words(3, 80)}</p>"
            items.append(r.choice([f'<div class="comment">{self.words(1, 3)}{body}</div>', f"<li><b>{self.words(1, 2)}</b>{body}</li>", body, f'<div class="reply">{body}</div>']))
        inner = "".join(items)
        return self.part(_COMMENTS, (f"<h2>{self.words(1, 3)}</h2>" if r.random() < 0.6 else "") + (f"<ol>{inner}</ol>" if "<li>" in inner else inner))

    def form(self) -> str:
        return self.part(_FORM, f"<label>{self.words(1, 3)}</label><input type=text>" + (f"<p>{self.words(3, 20)}</p>" if self.rng.random() < 0.5 else "") + f"<button>{self.words(1, 2)}</button>")

    def article(self) -> str:
        r = self.rng
        out = [f"<h1>{self.text(3, 14, True)}</h1>"] if r.random() < 0.85 else []
        if out and r.random() < 0.15:
            out = [r.choice(["<header>", '<header class="entry-header">']) + out[0] + "</header>"]
        for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25])):
            kind = r.random()
            if kind < 0.78:
                out.append(self.paragraph(True))
            elif kind < 0.84:
                out.append(f"<h2>{self.text(2, 9, True)}</h2>")
            elif kind < 0.89:
                out.append("<ul>" + "".join(f"<li>{self.text(3, 25, True)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{self.text(10, 50, True)}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{self.text(1, 5, True)}</td><td>{self.text(1, 5, True)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            else:
                out.append(f"<figure><img src=a.jpg><figcaption>{self.text(3, 15, True)}</figcaption></figure>" if r.random() < 0.5 else f"<section><h3>{self.text(2, 6, True)}</h3>{self.paragraph(True)}</section>")
            if r.random() < 0.16:
                out.append(r.choice([self.ad, self.aside, self.aside, self.form, self.notice])())
        if r.random() < 0.12:
            out.append(self.comments())
        if r.random() < 0.1:
            out.append(f'<div class="share">{self.links()}</div>')
        if r.random() < 0.1:
            out.append(f"<footer><p>{self.words(3, 15)}</p></footer>")
        return self.part(_ARTICLE, "".join(out))

    def page(self) -> str:
        r = self.rng
        maybe = lambda p, f: f() if r.random() < p else ""
        top = [maybe(0.8, lambda: self.part(_NAV, self.links())), maybe(0.5, lambda: self.part(_HEADER, r.choice([self.words(1, 8), f"<h1>{self.words(1, 5)}</h1><p>{self.words(3, 12)}</p>", self.links()]))), maybe(0.3, self.notice), maybe(0.4, self.ad), maybe(0.15, self.form)]
        end = [maybe(0.35, self.comments), maybe(0.45, self.aside), maybe(0.2, self.form), maybe(0.2, self.ad), maybe(0.2, self.notice), maybe(0.15, lambda: self.part(_NAV, self.links()))]
        r.shuffle(top)
        r.shuffle(end)
        left = maybe(0.15, self.aside)
        body = "".join([*top, left, self.article(), *end]) + maybe(0.8, lambda: self.part(_FOOTER, r.choice([self.words(3, 25), f"<p>{self.words(3, 40)}</p>" + self.links(), f"&copy; {self.words(2, 8)}"])))
        for _ in range(r.choice([0, 0, 1, 2])):
            body = self.part([("<div>", "</div>"), ('<div class="container">', "</div>"), ('<div id="page">', "</div>"), ('<div class="wrapper">', "</div>")], body)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"


def sample_pages(count: int, seed: int = 1) -> Iterator[tuple[str, set[str]]]:
    """``count`` pages as (source, the texts of the article's blocks); the same for the same seed."""
    rng = random.Random(seed)
    for _ in range(count):
        w = _Writer(rng)
        source = w.page()
        yield source, w.kept
