"""Labelled web pages for training: invented layouts in which the main text is marked.

``data-main="1"`` marks an element whose text is main text, ``data-main="0"`` an
element inside such a one whose text is not. Pages come from layout rules and a
seed, so any number of them can be made.
"""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu é ñ ö la".split()

#: Words of furniture that an article's subject may hold as well.
TELLING = "navigation menu header footer legal comment reply ad alert notice cookie rail social side widget".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(out).capitalize()

    def name(self, *names: str) -> str:
        """A class or id attribute, sometimes with further words, sometimes none."""
        r = self.r
        word = r.choice(names)
        if r.random() < 0.12:  # beside words of the page's subject
            word = "-".join(r.choice(([self.topic(), word], [word, self.topic()], [self.topic(), word, self.topic()])))
        word = r.choice([word, f"{word}-{r.choice(('box', 'wrap', 'inner', 'block'))}", f"site-{word}", word])
        return r.choice([f' class="{word}"', f' id="{word}"', f' class="{word} x{r.randint(1, 9)}"'])

    def topic(self) -> str:
        return "".join(self.r.choices(SYLLABLES[:21], k=3))

    def links(self, n: int) -> str:
        items = "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a>' + self.r.choice(("</li>", "")) for k in range(n))
        return f"<ul>{items}</ul>"

    def paragraph(self) -> str:
        r = self.r
        text = self.words(*r.choice(((1, 1), (1, 4), (5, 20), (20, 80), (60, 160)))) + r.choice((".", ".", "!", "", "?"))
        if r.random() < 0.25:
            text += f' {r.choice(("<b>", "<em>", "<strong>", "<i>"))}{self.words(1, 6)}'  # often left open
        if r.random() < 0.2:
            text += f' <a href="/x">{self.words(1, 5)}</a> {self.words(2, 9)}.'
        if r.random() < 0.15:
            text += "".join(f"<br>{self.words(2, 12)}" + r.choice((".", "")) for _ in range(r.choice((1, 1, 4, 8))))
        return f"<p>{text}" + r.choice(("</p>", "</p>", "</p>", ""))

    def body_text(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.85:
            title = f"<h1>{self.words(*r.choice(((1, 1), (1, 3), (1, 10))))}</h1>"
            if r.random() < 0.2:
                title = r.choice((f"<header>{title}</header>", f"<header>{title}<p>{self.words(1, 6)}</p></header>", f'<div class="article-header">{title}</div>', f'<div class="entry-header">{title}</div>'))
            parts.append(title)
        for _ in range(r.choice((1, 1, 2, 4, 8, 16))):
            parts.append(self.paragraph())
            extra = r.random()
            if extra < 0.08:
                parts.append(f"<h{r.randint(2, 4)}>{self.words(1, 6)}</h2>")
            elif extra < 0.13:
                parts.append("<ul>" + "".join(f"<li>{self.words(1, 15)}.</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif extra < 0.16:
                parts.append(f"<blockquote><p>{self.words(5, 30)}.</p></blockquote>")
            elif extra < 0.19:
                parts.append(f"<pre>{self.words(3, 12)}\n  {self.words(3, 12)}</pre>")
            elif extra < 0.22:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}<td>{self.words(1, 4)}" for _ in range(3)) + "</table>")
            elif extra < 0.25:
                parts.append(f'<figure><img src="a"><figcaption>{self.words(3, 10)}</figcaption></figure>')
            elif extra < 0.28:
                parts.append(f"<div><p>{self.words(10, 40)}.</p></div>")
            elif extra < 0.31:
                parts.append(f"<section><h2>{self.words(1, 5)}</h2><p>{self.words(10, 40)}.</p></section>")
            elif extra < 0.35:
                parts.append(f'<div data-main="0"{self.name("ad", "advert", "promo", "sponsored", "banner")}>{self.words(2, 25)}.</div>')
            elif extra < 0.38:
                parts.append(f'<aside data-main="0">{self.words(2, 25)}.{self.links(2)}</aside>')
            elif extra < 0.41:
                parts.append(f'<div data-main="0"{self.name("share", "social", "related", "newsletter")}>{self.links(r.randint(2, 5))}</div>')
            elif extra < 0.43:
                parts.append(f'<nav data-main="0">{self.links(3)}</nav>')
            elif extra < 0.46:
                parts.append(r.choice(("", f"<h2>{self.words(1, 2)}</h2>")) + self.links(r.randint(2, 7)))
            elif extra < 0.49:
                parts.append((tag := r.choice(("<ul>", "<ol>"))) + "".join(f"<li>{self.words(1, 3)}</li>" for _ in range(r.randint(2, 8))) + tag.replace("<", "</"))
            elif extra < 0.51:
                parts.append("<dl>" + "".join(f"<dt>{self.words(1, 2)}<dd>{self.words(1, 9)}" for _ in range(r.randint(2, 4))) + "</dl>")
        if r.random() < 0.08:
            parts.append(f'<footer data-main="0">{r.choice((self.words(2, 12) + ".", self.links(2)))}</footer>')
        return "".join(parts)

    def furniture(self, kind: str) -> str:
        r = self.r
        line = "".join(f"<p>{self.words(2, 30)}.</p>" for _ in range(r.choice((1, 1, 1, 1, 3))))
        if kind == "nav":
            inner = self.links(r.randint(2, 8))
            return r.choice((f"<nav>{inner}</nav>", f"<nav>{inner}</nav>", f'<div{self.name("menu", "nav", "navbar", "breadcrumb")}>{inner}</div>', inner))
        if kind == "header":
            inner = f"<h1>{self.words(1, 4)}</h1>" + r.choice(("", line, f"<span>{self.words(1, 8)}</span>"))
            return r.choice((f"<header>{inner}</header>", f'<div{self.name("header", "masthead", "topbar")}>{inner}</div>'))
        if kind == "footer":
            inner = f"&copy; {self.words(2, 12)} &middot; {self.words(2, 12)}." + r.choice(("", line, self.links(3)))
            return r.choice((f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div{self.name("footer", "copyright", "legal")}>{inner}</div>'))
        if kind == "side":
            inner = f"<h3>{self.words(1, 3)}</h3>" + r.choice((self.links(4), line, line + self.links(3)))
            return r.choice((f"<aside>{inner}</aside>", f'<div{self.name("sidebar", "widget", "rail", "related")}>{inner}</div>'))
        if kind == "ad":
            return f'<div{self.name("ad", "ads", "advert", "sponsor", "promo", "banner")}>{r.choice((self.words(2, 30) + ".", line, self.links(2)))}</div>'
        if kind == "notice":
            return f'<div{self.name("cookie", "notice", "consent", "alert", "popup", "modal", "newsletter", "subscribe")}>{line}<button>{self.words(1, 2)}</button></div>'
        if kind == "form":
            return f"<form><label>{self.words(1, 3)}</label><input><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button></form>"
        some = "".join(
            r.choice((f'<div{self.name("comment", "reply")}><b>{self.words(1, 2)}</b><p>{self.words(3, 50)}.</p></div>', f"<li><p>{self.words(3, 50)}.</p></li>", f"<article><p>{self.words(3, 50)}.</p></article>"))
            for _ in range(r.randint(1, 5))
        )
        return f'<{(tag := r.choice(("div", "section", "ol")))}{self.name("comments", "comment-list", "disqus", "replies", "responses")}><h3>{self.words(1, 3)}</h3>{some}</{tag}>'

    def html(self) -> str:
        r = self.r
        open_, close = r.choice(
            (("<article", "</article>"),) * 4
            + (("<main", "</main>"), ("<main", "</main>"))
            + tuple((f'<div{self.name(n)}', "</div>") for n in ("content", "article", "post", "entry", "story", "body-text", "main"))
            + tuple((f'<section{self.name(n)}', "</section>") for n in ("content", "article", "text"))
            + (("<div", "</div>"), (f'<div class="{self.topic()}"', "</div>"))
            + tuple((f'<div class="{self.topic()}-{r.choice(TELLING)}-{self.topic()}"', "</div>") for _ in range(3))
        )
        main = f'{open_} data-main="1">{self.body_text()}{close}'
        if r.random() < 0.25 and "<main" not in main:
            main = f'<main>{main}{r.choice(("", self.furniture("side"), self.furniture("comments")))}</main>'
        before = [self.furniture(k) for k in ("header", "nav", "ad", "notice", "form", "side") if r.random() < 0.4]
        after = [self.furniture(k) for k in ("comments", "side", "ad", "form", "nav", "notice", "footer") if r.random() < 0.4]
        inner = "".join([*before, main, *after])
        if r.random() < 0.3:
            inner = f'<div{r.choice(("", self.name("wrapper", "page", "container", "layout")))}>{inner}</div>'
        if r.random() < 0.03:
            inner = f"<form>{inner}</form>"
        head = f"<head><title>{self.words(1, 9)}</title><style>p{{}}</style><script>var a='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{inner}" + r.choice(("</body></html>", ""))


def labelled_pages(n: int = 1500, seed: int = 7) -> list[tuple[int, str]]:
    """Rows of page_id and html."""
    return [(k, _Page(seed * 1_000_003 + k).html()) for k in range(n)]
