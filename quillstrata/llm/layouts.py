"""Made-up pages with known article blocks, to train the extraction trees on: no page of a corpus is needed.

Each page draws its layout, its tags, its attribute names and its made-up words from a seeded generator.
"""

from __future__ import annotations

import random

_VOWELS, _CONSONANTS = "aeiou", "bcdfghklmnprstvw"


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.article: list[str] = []
        self.serial = 0

    def words(self, least: int, most: int) -> str:
        r = self.r
        n = r.randint(least, most)
        out = ["".join(r.choice(_CONSONANTS) + r.choice(_VOWELS) for _ in range(r.randint(1, 4))) for _ in range(n)]
        for i in range(0, n, r.randint(6, 14)):
            out[i] = out[i].capitalize()
        text = " ".join(w + (r.choice(".,.;") if r.random() < 0.1 else "") for w in out)
        self.serial += 1
        return f"{text} {self.serial}x" if r.random() < 0.2 else text

    def attrs(self, *names: str, chance: float = 0.75) -> str:
        """A class, an id or a role with one of the names, sometimes with another word; else nothing."""
        r = self.r
        if not names or r.random() > chance:
            return r.choice(["", "", f' class="{self.words(1, 1).strip(".,;x 0123456789").lower()}"'])
        name = r.choice(names)
        if r.random() < 0.3:
            name += r.choice(["-wrap", "_box", "Area", "-1", " clearfix", "-container"])
        return f' {r.choice(["class", "class", "class", "id"])}="{name}"'

    def main(self, text: str) -> str:
        self.article.append(" ".join(text.split()))
        return text

    def links(self, n: int, most: int = 3) -> list[str]:
        return [f'<a href="/{i}">{self.words(1, most)}</a>' for i in range(n)]

    # parts that are not the article

    def nav(self) -> str:
        r = self.r
        links = self.links(r.randint(2, 9))
        tag = r.choice(["nav", "nav", "div"])
        own = self.attrs("nav", "menu", "navbar", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", chance=0.5 if tag == "nav" else 0.95)
        if r.random() < 0.6:
            return f"<{tag}{own}><ul>" + "".join(f"<li>{x}</li>" for x in links) + f"</ul></{tag}>"
        return f"<{tag}{own}>" + r.choice([" | ", " ", " &raquo; "]).join(links) + f"</{tag}>"

    def header(self) -> str:
        r = self.r
        tag = r.choice(["header", "header", "div"])
        inside = r.choice([f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(2, 9)}</p>", f"<div{self.attrs('logo', 'site-title')}>{self.words(1, 3)}</div>"])
        return f"<{tag}{self.attrs('header', 'site-header', 'masthead', 'top', 'banner', chance=0.5 if tag == 'header' else 1)}>{inside}{self.nav() if r.random() < 0.4 else ''}</{tag}>"

    def footer(self) -> str:
        r = self.r
        tag = r.choice(["footer", "footer", "footer", "div"])
        inside = [f"&copy; {self.words(1, 4)} &middot; {self.words(1, 40)}"]
        if r.random() < 0.4:
            inside.append(" ".join(self.links(r.randint(1, 6))))
        body = "".join(f"<p>{x}</p>" for x in inside) if r.random() < 0.5 else " ".join(inside)
        return f"<{tag}{self.attrs('footer', 'site-footer', 'copyright', 'legal', 'bottom', chance=0.4 if tag == 'footer' else 1)}>{body}</{tag}>"

    def sidebar(self) -> str:
        r = self.r
        tag = r.choice(["aside", "aside", "div", "section"])
        own = self.attrs("sidebar", "side", "widget", "related", "related-posts", "popular", "recommended", "rail", "trending", chance=0.5 if tag == "aside" else 1)
        parts = []
        for _ in range(r.randint(1, 3)):
            parts.append(f"<h{r.randint(2, 4)}>{self.words(1, 4)}</h3>")
            parts.append(r.choice([
                "<ul>" + "".join(f"<li>{x}</li>" for x in self.links(r.randint(2, 6), 8)) + "</ul>",
                f"<p>{self.words(5, 60)}</p>",
                "".join(f"<div><a href='/x'>{self.words(3, 9)}</a><p>{self.words(4, 20)}</p></div>" for _ in range(r.randint(1, 4))),
            ]))
        return f"<{tag}{own}>{''.join(parts)}</{tag}>"

    def notice(self) -> str:
        tag = self.r.choice(["div", "div", "section", "p", "aside"])
        more = self.r.choice(["", " <button>OK</button>", f' <a href="/p">{self.words(1, 2)}</a>'])
        inside = f"{self.words(4, 40)}{more}"
        if tag != "p" and self.r.random() < 0.4:
            inside = f"<p>{inside}</p>"
        return f"<{tag}{self.attrs('notice', 'cookie', 'cookie-banner', 'gdpr', 'consent', 'alert', 'popup', 'modal', 'newsletter', 'subscribe', 'paywall', chance=1)}>{inside}</{tag}>"

    def advert(self) -> str:
        tag = self.r.choice(["div", "div", "div", "aside", "section", "ins"])
        inside = self.words(3, 60)
        if self.r.random() < 0.4:
            inside = f"<p>{inside}</p>" + self.r.choice(["", f'<a href="/b">{self.words(2, 5)}</a>'])
        elif self.r.random() < 0.2:
            inside = f'<a href="/b">{inside}</a>'
        return f"<{tag}{self.attrs('ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'ad-slot', 'banner-ad', chance=1)}>{inside}</{tag}>"

    def form(self) -> str:
        inside = self.r.choice([
            f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>",
            f"<p>{self.words(3, 15)}</p><input type=text><input type=submit>",
            f"{self.words(2, 8)} <input><select><option>{self.words(1, 2)}</option></select> {self.words(1, 4)}",
            f"<fieldset><legend>{self.words(1, 3)}</legend><div>{self.words(1, 5)} <textarea></textarea></div></fieldset>",
        ])
        return f"<form{self.attrs('search', 'signup', 'login', 'form', 'contact', chance=0.5)}>{inside}</form>"

    def share(self) -> str:
        tag = self.r.choice(["div", "ul"])
        links = self.links(self.r.randint(2, 5), 2)
        return f"<{tag}{self.attrs('share', 'social', 'share-buttons', 'follow', 'tags', chance=1)}>" + "".join(f"<li>{x}</li>" if tag == "ul" else x for x in links) + f"</{tag}>"

    def comments(self) -> str:
        r = self.r
        parts = [f"<h3>{self.words(1, 3)}</h3>"] if r.random() < 0.7 else []
        tag, item = r.choice([("ol", "li"), ("ul", "li"), ("div", "div"), ("section", "article"), ("div", "article")])
        for _ in range(r.randint(1, 7)):
            who = r.choice([f"<b>{self.words(1, 2)}</b> ", f"<p{self.attrs('author', 'user')}>{self.words(1, 2)}</p>", f"<cite>{self.words(1, 2)}</cite>"])
            body = "".join(f"<p>{self.words(3, 70)}</p>" for _ in range(r.randint(1, 2)))
            parts.append(f"<{item}{self.attrs('comment', 'comment-body', 'reply', chance=0.7)}>{who}{body}</{item}>")
        if r.random() < 0.4:
            parts.append(self.form())
        return f"<{tag}{self.attrs('comments', 'comment-list', 'commentlist', 'discussion', 'responses', 'replies', 'disqus', chance=1)}>{''.join(parts)}</{tag}>"

    # the article

    def block(self) -> str:
        r, kind = self.r, self.r.random()
        if kind < 0.72:
            text = self.main(self.words(1, r.choice([3, 12, 40, 120, 120, 220])))
            if r.random() < 0.15:
                return f"<p><b>{text}<br>"
            if r.random() < 0.2:
                cut = text.split(" ")
                at = r.randrange(len(cut))
                cut[at] = f"<{r.choice(['em', 'strong', 'a href=/y', 'i'])}>{cut[at]}</a></em></strong></i>"
                text = " ".join(cut)
            if r.random() < 0.08:  # controls and media that are left out, closed or not
                text += r.choice([f" <button>{self.words(1, 2)}</button>", f" <button>{self.words(1, 2)}", "<svg><path d='M0'/></svg>", f"<select><option>{self.words(1, 1)}</select>", "<input type=text>"])
            return f"<p>{text}" + ("</p>" if r.random() < 0.85 else "")
        if kind < 0.82:
            level = r.randint(2, 4)
            return f"<h{level}>{self.main(self.words(1, 8))}</h{level}>"
        if kind < 0.90:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.main(self.words(1, 25))}</li>" for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if kind < 0.94:
            return f"<blockquote>{self.main(self.words(5, 60))}</blockquote>"
        if kind < 0.97:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.main(self.words(1, 6))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        text = self.main(self.words(2, 20))
        return r.choice([f"<pre>{text}</pre>", f"<figure><img src=/i><figcaption>{text}</figcaption></figure>"])

    def body(self) -> str:
        r = self.r
        parts = [f"<h1>{self.main(self.words(2, 12))}</h1>"] if r.random() < 0.8 else []
        blocks = [self.block() for _ in range(r.choice([1, 1, 2, 3, 4, 6, 8, 12, 20]))]
        if r.random() < 0.3:
            blocks.insert(r.randint(0, len(blocks)), r.choice([self.advert, self.advert, self.share, self.notice, self.nav, self.sidebar])())
        if r.random() < 0.12:
            blocks.append(self.comments())
        if r.random() < 0.08:
            blocks.append(self.form())
        inside = "".join(parts + blocks)
        kind = r.random()
        if kind < 0.5:
            return f"<article{self.attrs('post', 'entry', 'story', 'article', chance=0.3)}>{inside}</article>"
        if kind < 0.62:
            return f"<main{self.attrs('main', 'content', chance=0.3)}>{inside}</main>"
        if kind < 0.9:
            return f"<div{self.attrs('content', 'article', 'post', 'entry', 'post-content', 'story', 'article-body', 'main', 'text', chance=0.9)}>{inside}</div>"
        if kind < 0.95:
            return f"<section{self.attrs('content', 'post', chance=0.5)}>{inside}</section>"
        return inside

    def page(self) -> str:
        r = self.r
        before = [f() for f in (self.notice, self.header, self.nav, self.nav, self.form, self.advert, self.sidebar) if r.random() < 0.4]
        if r.random() < 0.7:
            r.shuffle(before)
        middle = self.body() if r.random() < 0.95 else ""  # a few pages have no article
        if r.random() < 0.35:
            beside = self.sidebar()
            middle = middle + beside if r.random() < 0.6 else beside + middle
            if r.random() < 0.6:
                middle = f"<div{self.attrs('wrapper', 'container', 'page', 'row', 'columns')}>{middle}</div>"
        after = [f() for f in (self.share, self.comments, self.sidebar, self.advert, self.form, self.nav) if r.random() < 0.3]
        if r.random() < 0.75:
            after.append(self.footer())
        if r.random() < 0.15:
            after.append(self.notice())
        inside = "".join(before) + middle + "".join(after)
        if r.random() < 0.2:
            inside = f"<div{self.attrs('wrapper', 'page', 'site')}>{inside}</div>"
        head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        return f"{head}<body>{inside}" + ("</body></html>" if r.random() < 0.8 else "")


def made_page(seed: int) -> tuple[str, list[str]]:
    """(html, article blocks in page order)."""
    maker = _Maker(seed)
    html = maker.page()
    return html, maker.article
