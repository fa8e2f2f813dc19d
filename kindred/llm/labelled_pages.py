"""Labelled pages for the weights of `html_text`, made by a rule from a seed.

A page is dealt a layout: a holder for the article (an article or main element, a named or a nameless
container, or none), or no article, and around and inside it menus, headers, footers, sidebars, notices, adverts, forms,
comments, link lists and share bars, by element or by name. Names are a kind's nouns, alone or with a
modifier before or a part after them; modifiers and parts are shared by all kinds, so that they say
little. Every run of the article's text begins with MARK.
"""

from __future__ import annotations

import random

MARK = "\x02"

#: Nouns that name the article's own containers.
OWN = "article content story post entry text body copy prose column essay".split()
#: Nouns that name other parts, and elements that stand for them.
OTHER = {
    "menu": ("menu nav navbar navigation breadcrumb breadcrumbs toolbar tabs pager pagination topbar", "nav"),
    "header": ("header masthead branding logo", "header"),
    "footer": ("footer copyright imprint legal credits colophon", "footer"),
    "side": ("sidebar side rail left right aside widget widgets", "aside"),
    "notice": ("notice notices cookie cookies consent gdpr alert popup modal overlay disclaimer paywall", ""),
    "advert": ("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner", ""),
    "form": ("form search login signin signup newsletter subscribe subscription register", "form"),
    "comments": ("comment comments reply replies respond response responses remark remarks discussion disqus", ""),
    "related": ("related recommended more popular trending teaser teasers", ""),
    "share": ("share sharing social follow", ""),
}
MODIFIERS = "top main site page big lead reader banner ad free js new inner first js extra big global user blog".split()
LAYOUT = "with no has without".split()
PARTS = "box wrap wrapper container inner block area list item unit section panel".split()

_WORDS = "the committee met on tuesday and agreed to publish its findings before year end while others said that nothing new had been learned from it at all".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choices(_WORDS, k=self.r.randint(low, high)))

    def name(self, nouns: list[str]) -> str:
        noun, form = self.r.choice(nouns), self.r.random()
        if form < 0.4:
            return noun
        if form < 0.75:
            return f"{self.r.choice(MODIFIERS)}-{noun}"
        return f"{noun}-{self.r.choice(PARTS)}"

    def attribute(self, nouns: list[str]) -> str:
        names = [self.name(nouns)]
        if nouns is OWN and self.r.random() < 0.15:  # the layout names what stands beside
            names.append(f"{self.r.choice(LAYOUT)}-{self.r.choice(OTHER[self.r.choice(list(OTHER))][0].split())}")
        if self.r.random() < 0.2:
            names.append(f"{self.r.choice(MODIFIERS)}-{self.r.choice(MODIFIERS)}")
        self.r.shuffle(names)
        return f' {self.r.choice(["class", "class", "id"])}="{" ".join(names)}"'

    def links(self) -> str:
        links = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(self.r.randint(1, 9))]
        return " ".join(links) if self.r.random() < 0.3 else f"<ul>{''.join(f'<li>{x}</li>' for x in links)}</ul>"

    def inner(self, kind: str) -> str:
        if kind in ("menu", "share") or kind == "related" and self.r.random() < 0.6:
            return self.links()
        if kind == "form":
            return f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button><p>{self.words(2, 10)}</p>"
        if kind == "comments":
            return "".join(f"<{t}>{self.words(4, 30)}</{t}>" for t in self.r.choices(["p", "div", "li"], k=self.r.randint(1, 4)))
        if kind == "header":
            return f"<{(t := self.r.choice(['h1', 'h2', 'p', 'div']))}>{self.words(1, 6)}</{t}>" + (self.links() if self.r.random() < 0.3 else "")
        return "".join(f"<p>{self.words(3, 25)}</p>" if self.r.random() < 0.6 else f"{self.words(2, 12)} <a href=/>{self.words(1, 3)}</a>" for _ in range(self.r.randint(1, 3)))

    def other(self, kind: str) -> str:
        nouns, element = OTHER[kind][0].split(), OTHER[kind][1]
        if element and self.r.random() < 0.5:
            return f"<{element}{self.attribute(nouns) if self.r.random() < 0.4 else ''}>{self.inner(kind)}</{element}>"
        tag = self.r.choice(["div", "div", "section", "ul" if kind == "menu" else "div", "article" if kind in ("comments", "related") else "div"])
        return f"<{tag}{self.attribute(nouns)}>{self.inner(kind)}</{tag}>"

    def own(self, low: int, high: int) -> str:
        """Words of the article, now and then with a link."""
        text = f"{MARK}{self.words(low, high)}"
        link = f"<a href=/y>{MARK}{self.words(1, 3)}</a>"
        return self.r.choice([link, f"{link} {text}", f"{text} {link}"]) if self.r.random() < 0.25 else text

    def block(self) -> str:
        r, text = self.r.random(), f"{MARK}{self.words(3, 60)}"
        if r < 0.55:
            return f"<p>{text} <em>{MARK}{self.words(1, 3)}</em> {MARK}{self.words(2, 20)}</p>" if self.r.random() < 0.3 else f"<p>{text}</p>"
        if r < 0.65:
            return f"<{(t := self.r.choice(['h1', 'h2', 'h3', 'h4']))}>{self.own(1, 8)}</{t}>"
        if r < 0.75:
            return f"<p>{text} <a href=/x>{MARK}{self.words(1, 3)}</a> {MARK}{self.words(2, 20)}</p>"
        if r < 0.82:
            return "<ul>" + "".join(f"<li>{self.own(2, 12)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if r < 0.87:
            return f"<blockquote><p>{text}</p></blockquote>"
        if r < 0.92:
            return f"<table><tr><td>{self.own(1, 5)}</td><td>{self.own(1, 5)}</td></tr></table>"
        if r < 0.96:
            return f"<figure><img src=x><figcaption>{self.own(2, 9)}</figcaption></figure>"
        return f"<div>{text}</div>"

    def page(self) -> str:
        blocks = [f"<h1>{MARK}{self.words(2, 9)}</h1>" if self.r.random() < 0.8 else self.block(), *(self.block() for _ in range(self.r.randint(2, 12)))]
        if self.r.random() < 0.5:  # what is not the article's, inside it
            kind = self.r.choice(["notice", "advert", "related", "form", "comments", "side", "share", "menu"])
            blocks.insert(self.r.randint(1, len(blocks)), self.other(kind))
        holder = self.r.choice(["article", "article", "main", "named", "named", "nameless", "none"])
        if holder in ("article", "main") and self.r.random() < 0.3:
            blocks[0] = f"<header>{blocks[0]}</header>"
        body = "".join(blocks)
        if holder in ("article", "main"):
            body = f"<{holder}{self.attribute(OWN) if self.r.random() < 0.4 else ''}>{body}</{holder}>"
        elif holder == "named":
            body = f"<{(t := self.r.choice(['div', 'section']))}{self.attribute(OWN)}>{body}</{t}>"
        elif holder == "nameless":
            body = f"<div>{body}</div>"
        if self.r.random() < 0.1:  # a page without an article
            holder = body = ""
        before = [self.other(k) for k in self.r.sample(["menu", "header", "notice", "advert", "side", "form"], self.r.randint(1, 4))]
        after = [self.other(k) for k in self.r.sample(["footer", "comments", "related", "side", "advert", "share", "form"], self.r.randint(1, 5))]
        if holder in ("article", "main") and self.r.random() < 0.4:
            # Beside a marked article even nameless text is something else.
            self.r.choice((before, after)).append(f"<div><p>{self.words(5, 40)}</p></div>")
        head = "<!DOCTYPE html><html><head><meta charset=utf-8><title>t</title><style>p{}</style></head><body>"
        return f"{head}{''.join(before)}{body}{''.join(after)}</body></html>"


def pages(n: int, seed: int) -> list[str]:
    """n labelled pages; equal seeds give equal pages."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
