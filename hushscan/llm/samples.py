"""Drawn pages of many layouts whose blocks are labelled as they are built."""

from __future__ import annotations

import random

from hushscan.llm.blocks import Block, read_blocks

_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo an er in on st th".split()
#: ways to mark the article, from pages' usual markup
_ARTICLES = (
    "article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'section class="post"',
    'div class="entry-content"', 'div class="article-body"', 'div id="story"', 'div role="main"',
)
#: what stands beside an article: opening tag and the kind of its text
_BESIDE = (
    ("nav", "links"), ('ul class="menu"', "items"), ('div class="navbar"', "links"), ('div class="breadcrumbs"', "links"),
    ("header", "site"), ("header", "site"), ("header", "site"), ('div class="site-header"', "site"), ('div id="header"', "site"), ("footer", "short"), ('div class="footer"', "links"),
    ("aside", "prose"), ("aside", "prose"), ("aside", "items"), ('div class="sidebar"', "items"), ('aside class="related"', "links"), ('div class="related-posts"', "items"),
    ('div class="ad"', "short"), ('div class="ads"', "prose"), ('div class="advertisement"', "prose"), ('div class="sponsored"', "short"),
    ('div class="banner promo"', "short"), ('div class="cookie-notice"', "prose"), ('div id="cookie-consent"', "prose"),
    ('div class="notice"', "prose"), ('div class="alert popup"', "prose"), ('div class="modal" role="dialog"', "short"),
    ("form", "form"), ('form class="newsletter"', "form"), ('div class="subscribe"', "form"), ('form class="search" role="search"', "form"),
    ('section class="comments"', "comments"), ('div id="comments"', "comments"), ('ol class="comment-list"', "items"),
    ('div class="advert"', "prose"), ('div class="adverts"', "short"), ('div class="widget"', "items"), ('div id="side-nav"', "items"),
    ('div class="cookies"', "prose"), ('div class="disclaimer"', "prose"), ('div class="responses"', "comments"),
    ('div class="signup"', "form"), ('div class="login"', "form"), ('div class="top-bar"', "links"), ('div class="copyright"', "short"),
    ('div class="share-buttons"', "items"), ('div class="social"', "links"), ("noscript", "prose"), ('div style="display:none"', "prose"),
)

#: kinds of text that can be told from an article by their shape alone
_PLAIN_KINDS = ("links", "links", "site", "short", "form")


class _Drawer:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        pick = self.random
        return " ".join(
            "".join(pick.choice(_SYLLABLES) for _ in range(pick.randint(1, 4))) for _ in range(pick.randint(least, most))
        )

    def sentence(self, least: int = 3, most: int = 60) -> str:
        return self.words(least, most).capitalize() + self.random.choice("...!?")

    def beside(self, start: str, kind: str) -> str:
        name = start.split()[0]
        n = self.random.randint(1, 6)
        if kind == "links":
            body = "".join(f'<li><a href="/{i}">{self.words(1, 4)}</a></li>' for i in range(n))
            body = f"<ul>{body}</ul>" if self.random.random() < 0.7 else body.replace("<li>", "<div>").replace("</li>", "</div>")
        elif kind == "items":
            body = "".join(f"<li>{self.sentence(1, 12)}</li>" for _ in range(n))
        elif kind == "site":
            title = f"<h1>{self.words(1, 5)}</h1>" if self.random.random() < 0.5 else f"<span>{self.words(1, 3)}</span>"
            body = title + (self.beside("nav", "links") if self.random.random() < 0.4 else f"<p>{self.sentence(2, 9)}</p>")
        elif kind == "form":
            body = f"<p>{self.sentence(2, 10)}</p><label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>"
        elif kind == "comments":
            body = f"<h3>{self.words(1, 3)}</h3>" + "".join(
                f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.sentence()}</p></div>' for _ in range(n)
            )
        elif kind == "prose":
            body = "".join(f"<p>{self.sentence()}</p>" for _ in range(self.random.randint(1, 3)))
            body = body if self.random.random() < 0.6 else self.sentence(3, 30)
        else:
            body = self.sentence(1, 12) if self.random.random() < 0.6 else f"<p>&copy; {self.words(1, 8)}</p>"
        return f"<{start}>{body}</{name}>"

    def content(self) -> str:
        """Blocks of an article; every text starts with the mark that labels it."""
        draw, out = self.random, [f"<h1>\x01{self.words(1, 12)}</h1>"] if self.random.random() < 0.8 else []
        for _ in range(draw.randint(1, 9)):
            kind = draw.random()
            if kind < 0.7:
                text = self.sentence(3, 120)
                out.append(f"<p>\x01{text}</p>" if draw.random() < 0.8 else f"<p>\x01<b>{text}<br>")
            elif kind < 0.8:
                out.append(f"<h2>\x01{self.words(1, 8)}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>\x01{self.sentence(2, 20)}</li>" for _ in range(draw.randint(1, 5))) + "</ul>")
            elif kind < 0.93:
                out.append(f"<blockquote>\x01{self.sentence()}</blockquote>")
            elif kind < 0.96:
                out.append(f"<table><tr><td>\x01{self.words(1, 4)}</td><td>\x01{self.words(1, 4)}</td></tr></table>")
            else:
                out.append(f"<pre>\x01{self.words(3, 20)}</pre>")
        if draw.random() < 0.15 and out[0].startswith("<h1>"):
            out[0] = f"<header>{out[0]}</header>"
        return out

    def plain(self, start: str, kind: str) -> str:
        """Something beside the article inside nothing but plain containers."""
        html = self.beside(start, kind)
        for name in ("nav", "header", "footer", "form"):
            html = html.replace(f"<{name}>", "<div>").replace(f"</{name}>", "</div>")
        return html

    def plain_page(self) -> str:
        """A page of plain containers: nothing says by name where the article is."""
        draw = self.random
        body = "".join(self.content())
        if draw.random() < 0.25:
            body = body.replace("<p>", "<div>").replace("</p>", "</div>")
        for _ in range(draw.choice((0, 0, 1, 2))):
            body = f"<div>{body}</div>"
        above = [self.plain("div", draw.choice(_PLAIN_KINDS)) for _ in range(draw.randint(0, 3))]
        below = [self.plain("div", draw.choice(_PLAIN_KINDS)) for _ in range(draw.randint(0, 3))]
        if draw.random() < 0.5:
            # some pages do name what stands beside the article
            above.insert(draw.randint(0, len(above)), self.beside(*draw.choice(_BESIDE)))
            below.insert(draw.randint(0, len(below)), self.beside(*draw.choice(_BESIDE)))
        whole = "".join((*above, body, *below))
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{whole}</body></html>"

    def page(self) -> str:
        draw = self.random
        if draw.random() < 0.3:
            return self.plain_page()
        article = draw.choice(_ARTICLES)
        body = self.content()
        for _ in range(draw.choice((0, 1, 1, 2, 3))):
            body.insert(draw.randint(1, len(body)), self.beside(*draw.choice(_BESIDE[11:])))
        beside = [self.beside(*draw.choice(_BESIDE)) for _ in range(draw.randint(1, 6))]
        split = draw.randint(0, len(beside))
        middle = f"<{article}>{''.join(body)}</{article.split()[0]}>"
        if draw.random() < 0.3:
            middle = f'<div class="container"><div class="row">{middle}</div></div>'
        whole = "".join(beside[:split]) + middle + "".join(beside[split:])
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{whole}</body></html>"


def labelled_samples(n: int, seed: int) -> list[list[tuple[Block, bool]]]:
    drawer, pages = _Drawer(seed), []
    for _ in range(n):
        found = []
        for block in read_blocks(drawer.page()):
            text = block.text.replace("\x01", "").strip()
            if text:
                found.append((Block(text, block.path, block.tag, block.linked), "\x01" in block.text))
        pages.append(found)
    return pages
