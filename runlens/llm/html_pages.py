"""Labelled pages to train the extractor with, made by rule: every block of
text carries data-y="1" (article) or "0" on itself or an element around it. LAYOUTS are families of
page frames, from semantic elements over named boxes, tables and nested boxes without names to text in a bare body;
languages and broken markup vary from page to page within each."""

from __future__ import annotations

import random
import re

# Class and id names that sites give their parts.
NAMES = {
    "header": "header masthead site-header top-bar banner branding page-header logo".split(),
    "nav": "nav menu navbar navigation main-menu breadcrumb breadcrumbs tabs pagination pager toc".split(),
    "footer": "footer site-footer bottom colophon copyright legal page-footer".split(),
    "sidebar": "sidebar side widget related aside rail trending popular recommended tags".split(),
    "notice": "notice cookie cookie-banner consent alert gdpr warning message disclaimer paywall".split(),
    "advert": "ad ads advert advertisement sponsored promo promotion banner-ad adsense sponsor".split(),
    "form": "form search newsletter subscribe signup login contact-form poll".split(),
    "comments": "comments comment reader-comments discussion replies responses comment-list thread disqus".split(),
    "share": "share social sharing follow buttons toolbar".split(),
    "content": "content article post entry-content story main-text article-body post-content body-text text story-body".split(),
}
# Ordinary words of four languages.
WORDS = {
    "en": "river market winter children answer letter between morning history evening simple garden story window music people question during teacher never bridge season almost village together science because another doctor weather".split(),
    "de": "Straße Wasser zwischen Kinder Geschichte Garten immer Fenster Arbeit können Morgen Brücke schon Lehrer wieder Stadt Wissenschaft über Antwort Winter gegen Musik Frage heute".split(),
    "fr": "rivière toujours enfants histoire jardin pendant fenêtre travail matin réponse ville science lettre musique hiver question avec village chose encore maison".split(),
    "es": "mercado siempre niños historia jardín durante ventana trabajo mañana respuesta ciudad ciencia carta música invierno pregunta entre pueblo cosa todavía puente".split(),
}
LAYOUTS = ("semantic", "boxes", "prefixed", "table", "bare", "document", "nested", "unmarked")


class _Maker:
    def __init__(self, seed: int, layout: str):
        self.r, self.layout = random.Random(seed), layout
        self.semantic = layout == "semantic" or (layout in ("document", "nested") and self.r.random() < 0.5)
        self.named = layout in ("boxes", "prefixed", "document") or (layout in ("semantic", "nested", "table") and self.r.random() < 0.6)
        self.lang = self.r.choice(list(WORDS))
        self.prefix = self.r.choice(("c-", "o-", "site__", "js-", "Page", "x-")) if layout == "prefixed" else ""

    def word(self) -> str:
        return self.r.choice(WORDS[self.lang])

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(2, 18).capitalize() + self.r.choice("....!?")

    def prose(self, high: int = 8) -> str:
        out = []
        for _ in range(self.r.choice((1, 1, 2, 3, self.r.randint(1, high)))):
            s = self.sentence()
            if self.r.random() < 0.1:
                tag = self.r.choice(("b", "i", "em", "strong", "a href='/x'", "span", "code"))
                s = f"<{tag}>{s}</{tag.split()[0]}>" if self.r.random() < 0.8 or tag[0] == "a" else f"<b>{s}<br>"
            out.append(s)
        return " ".join(out)

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice((" ", " | ", " &middot; ", "\n")).join(items)

    def box(self, kind: str, tag: str, inner: str, y: int = 0) -> str:
        """inner in an element whose tag or class, if the page has such, tells its kind."""
        semantic = self.semantic and tag
        name = ""
        if (self.named and self.r.random() < 0.9) or not semantic:
            own = self.prefix + self.r.choice(NAMES[kind]) + (self.r.choice(("", "__inner", "-block", "--wide")) if self.prefix else "")
            name = f' {self.r.choice(("class", "class", "id"))}="{own}"' if self.named else ""
        t = tag if semantic else "td" if self.layout == "table" else self.r.choice(("div", "div", "section"))
        return f'<{t}{name} data-y="{y}">{inner}</{t}>'

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            title = self.words(1, 12).capitalize()
            out.append(f"<h1>{title}</h1>" if r.random() < 0.8 else f"<header><h1>{title}</h1></header>")
        for _ in range(r.choice((1, 2, 3, 4, 6, 9, 14, 22))):
            k = r.random()
            if k < 0.72:
                out.append(f"<p>{self.prose() if r.random() < 0.93 else self.words(1, 8)}" + ("</p>" if r.random() < 0.9 else ""))
            elif k < 0.79:
                out.append(f"<{(h := r.choice(('h2', 'h3', 'h4')))}>{self.words(1, 8).capitalize()}</{h}>")
            elif k < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.prose(2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.88:
                out.append(f"<blockquote><p>{self.prose(3)}</p></blockquote>")
            elif k < 0.90:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif k < 0.92:
                out.append(f"<figure><img src='x.png'><figcaption>{self.sentence()}</figcaption></figure>")
            elif k < 0.925:
                out.append(f"<p>{' | '.join(self.words(1, 2) for _ in range(r.randint(2, 9)))}{r.choice(('', ' |', '.'))}</p>")
            elif k < 0.935:
                out.append(f"<pre>{self.words(4, 20)}</pre>")
            elif k < 0.94:
                out.append(f"<div>{self.prose()}</div>")
            elif k < 0.95:
                out.append(f"<section{r.choice(('', ' class=part', ' id=s1'))}><h2>{self.words(1, 5)}</h2><p>{self.prose()}</p><p>{self.prose()}</p></section>")
            elif k < 0.97:
                out.append(self.advert())
            elif k < 0.985:
                out.append(self.box("share", "", self.links(2, 4)))
            else:
                out.append(self.box("sidebar", "aside", f"<h3>{self.words(1, 3)}</h3>{self.links(2, 5)}"))
        return "".join(out)

    def advert(self) -> str:
        return self.box("advert", "", self.r.choice((self.prose(2), f"<p>{self.prose(2)}</p>", f'<a href="http://x">{self.words(2, 9)}</a>')))

    def comments(self) -> str:
        one = lambda: self.r.choice(("<p><b>{w}</b></p><p>{p}</p>", "<div><span>{w}</span><p>{p}</p></div>", "<li><p>{p}</p></li>", "<p>{p}</p>", "<div>{p}</div>", "<article><h4>{w}</h4><p>{p}</p></article>")).format(w=self.words(1, 2), p=self.prose(4))
        head = self.r.choice(("", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.r.randint(1, 90)} {self.words(1, 1)}</h3>"))
        return self.box("comments", "section" if self.r.random() < 0.5 else "", head + "".join(one() for _ in range(self.r.randint(1, 6))))

    def form(self) -> str:
        return f'<form data-y="0"{self.r.choice(("", " class=search", " id=newsletter"))}><label>{self.words(1, 4)}</label><p>{self.sentence()}</p><input name="q"><button>{self.words(1, 2)}</button></form>'

    def page(self) -> str:
        r = self.r
        if self.layout == "bare" and r.random() < 0.35:  # text and nothing else
            text = r.choice((self.prose(), "".join(f"<p>{self.prose()}</p>" for _ in range(r.randint(1, 3))), f"<h1>{self.words(1, 6)}</h1><p>{self.prose()}</p>", f"<p>{self.words(1, 12)}</p>"))
            return f'<html><body data-y="1">{text}</body></html>'
        before = [lambda: self.box("header", "header", f"<a href='/'>{self.words(1, 3)}</a>" + r.choice(("", f"<p>{self.words(2, 6)}</p>"))), lambda: self.box("nav", "nav", self.links(3, 9)), lambda: self.box("notice", "", f"<p>{self.prose(2)}</p>" if r.random() < 0.5 else self.prose(2)), self.advert, self.form, lambda: self.box("sidebar", "aside", self.sidebar())]
        after = [self.comments, lambda: self.box("sidebar", "aside", self.sidebar()), self.advert, self.form, lambda: self.box("share", "", self.links(2, 5)), lambda: self.box("nav", "nav", self.links(2, 5)), lambda: self.box("notice", "", self.prose(2))]
        top = [f() for f in before if r.random() < 0.45]
        end = [f() for f in after if r.random() < 0.4]
        end.append(self.box("footer", "footer", r.choice(("&copy; {h} &middot; {p}", "<p>&copy; 20{n} {h}</p>", "<p>{p}</p>" + self.links(2, 5), "{p}", "&copy; {h}")).format(h="www." + self.word().lower() + ".test", p=self.prose(3), n=r.randint(10, 29))))
        alone = self.layout != "table" and r.random() < 0.1
        if alone:
            top, end = [], [""]
        core = self.frame(self.article() if not alone or r.random() < 0.6 else f"<p>{self.words(1, 8)}", end)
        if self.layout == "table":
            side = "".join(top[:1])
            core = f"<table><tr>{side}{core}{''.join(end[:1])}</tr></table>"
            top, end = [f"<table><tr>{x}</tr></table>" for x in top[1:]], [f"<table><tr>{x}</tr></table>" for x in end[1:]]
        elif self.layout == "nested" or r.random() < 0.2:
            for name in r.choice((("wrapper",), ("container", "row"), ("page", "layout", "col"))):
                core = f"<div class='{name}'>{core}{''.join(end[:1])}</div>" if self.named else f"<div>{core}</div>"
                end = end[1:] or end
        elif self.layout in ("bare", "unmarked"):
            top, end = [x for x in top if r.random() < 0.4], [x for x in end if r.random() < 0.5]
        head = f"<head><title>{self.words(1, 6)}</title>" + r.choice(("", "<style>body{color:#333}</style>", "<script>let a = 1 < 2;</script>", "<link rel=stylesheet href=a.css>")) + "</head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(top)}{r.choice(('', '<!-- main -->'))}{core}{''.join(end)}" + ("</body></html>" if r.random() < 0.9 else "")

    def frame(self, article: str, end: list[str]) -> str:
        """The article in what the layout has around it."""
        r, name = self.r, self.prefix + self.r.choice(NAMES["content"])
        if self.layout == "bare":  # each block is labelled itself
            return re.sub(r"<(p|h[1-4]|ul|blockquote|figure|pre|div|section|header)(?=[ >])(?![^>]*data-y)", r'<\1 data-y="1"', article)
        if self.layout == "table":
            return f'<td data-y="1"{r.choice(("", f" class={name}", " width=70%"))}>{article}</td>'
        if self.layout in ("boxes", "prefixed"):
            return f'<div {r.choice(("class", "id"))}="{name}" data-y="1">{article}</div>'
        if self.layout == "unmarked":
            return f'<div data-y="1">{article}</div>'
        if self.layout == "document":
            return f'<div role="main"><div id="{name}" data-y="1">{article}</div></div>' if r.random() < 0.5 else f'<main id="{name}" data-y="1">{article}</main>'
        tag = r.choice(("article", "article", "main", "section"))
        inner = f'<{tag} data-y="1"{r.choice(("", f" class={name}"))}>{article}</{tag}>'
        return f"<main>{inner}{r.choice(end)}</main>" if tag == "article" and r.random() < 0.3 else inner

    def sidebar(self) -> str:
        return self.r.choice((f"<h3>{self.words(1, 3)}</h3>{self.links(2, 6)}", f"<p>{self.prose(2)}</p>", f"<h4>{self.words(1, 3)}</h4><p>{self.prose(2)}</p>", self.links(2, 6)))


def labelled_pages(n: int, seed: int = 1, layouts: tuple[str, ...] = LAYOUTS) -> list[str]:
    return [_Maker(seed * 1_000_003 + i, layouts[i % len(layouts)]).page() for i in range(n)]
