"""Labelled pages to train on: layouts of many kinds in invented words, where it is known which blocks are the article.

Every text block ends with a mark that tells its kind; labelled() takes the marks out again.
"""

from __future__ import annotations

import random

MAIN, REST = "", ""
_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo yu za ber chen der ent fra gio hal ion".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, a: int, b: int) -> str:
        out = ["".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(a, b))]
        return " ".join(w + ("," if self.r.random() < 0.08 else "") for w in out)

    def sentence(self, a: int = 3, b: int = 18) -> str:
        return self.words(a, b).capitalize() + self.r.choice("...!?")

    def prose(self) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 5, 9])))
        if self.r.random() < 0.2:
            return text + f' <a href="/x">{self.words(1, 3)}</a> ' + self.sentence()
        return f"<b>{text}</b>" if self.r.random() < 0.1 else text

    def links(self, n: int, mark: str = REST) -> str:
        inner = [f'<a href="/{k}">{self.words(1, 3)}{mark}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in inner) + "</ul>" if self.r.random() < 0.7 else " | ".join(inner)

    def named(self, tag: str, names: list[str], inner: str) -> str:
        name = self.r.choice(names)
        if tag in ("nav", "header", "footer", "aside", "form") and self.r.random() < 0.4:
            name = ""  # the tag says it
        if name and self.r.random() < 0.3:
            name = self.r.choice(["site-{}", "page-{}", "{}-box", "{}-wrap", "c-{}", "{}_1"]).format(name)
        attribute = f' {self.r.choice(["class", "class", "id"])}="{name}"' if name else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def rest(self, kind: str) -> str:
        r, p = self.r, lambda: f"<p>{self.sentence()}{REST}</p>"
        say = lambda: p() if r.random() < 0.5 else self.sentence() + REST
        if kind == "nav":
            return self.named(r.choice(["nav", "nav", "div", "ul"]), ["nav", "menu", "navigation", "breadcrumbs", "topnav", ""] if r.random() < 0.8 else ["menu"], self.links(r.randint(3, 9)))
        if kind == "header":
            return self.named(r.choice(["header", "header", "div"]), ["header", "masthead", "branding", "top"], f"<{(t := r.choice(['div', 'p', 'h2', 'h1']))}>{self.words(1, 4)}{REST}</{t}>" + (say() if r.random() < 0.4 else "") + (self.links(r.randint(2, 6)) if r.random() < 0.5 else ""))
        if kind == "footer":
            return self.named(r.choice(["footer", "footer", "div"]), ["footer", "copyright", "bottom", "legal"], f"&copy; {self.words(1, 3)} &middot; {self.sentence()}{REST}" + "".join(p() for _ in range(r.choice([0, 0, 1, 2]))) + (self.links(r.randint(2, 6)) if r.random() < 0.4 else ""))
        if kind == "side":
            return self.named(r.choice(["aside", "aside", "div", "section"]), ["sidebar", "side", "widget", "related", "recommended", "rail", "more"], (f"<h3>{self.words(1, 4)}{REST}</h3>" if r.random() < 0.7 else "") + "".join(say() for _ in range(r.randint(0, 3))) + (self.links(r.randint(2, 7)) if r.random() < 0.7 else p()))
        if kind == "notice":
            return self.named(r.choice(["div", "section", "div", "aside"]), ["notice", "cookie", "cookie-notice", "banner", "consent", "alert", "popup", "modal", "gdpr", "newsletter", "subscribe", "paywall", "message"], "".join(p() for _ in range(r.randint(1, 3))) if r.random() < 0.6 else say())
        if kind == "ad":
            return self.named(r.choice(["div", "div", "aside", "section"]), ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "sponsor", "promotion"], say() if r.random() < 0.7 else "".join(p() for _ in range(r.randint(1, 3))))
        if kind == "form":
            return self.named("form", ["form", "search", "login", "signup", "contact", ""], f"<label>{self.words(1, 3)}{REST}</label> <input> " + (say() if r.random() < 0.5 else "") + f"<button>{self.words(1, 2)}{REST}</button>")
        if kind == "share":
            return self.named("div", ["share", "social", "tags", "toolbar", "pagination", "author-links"], self.links(r.randint(2, 5)))
        one = lambda: self.named(r.choice(["div", "li", "article", "section"]), ["comment", "comment-body", "reply", "response", ""], say() if r.random() < 0.5 else f"<div>{self.words(1, 2)}{REST}</div><p>{self.sentence()} {self.sentence()}{REST}</p>")
        return self.named(r.choice(["section", "div", "div", "ol", "aside"]), ["comments", "comment-list", "discussion", "responses", "disqus", "replies", "reader-comments"], (f"<h2>{self.words(1, 2)}{REST}</h2>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 6))))

    def article(self, inside: list[str]) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.words(2, 12)}{MAIN}</h1>")
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            x = r.random()
            if x < 0.62:
                out.append(f"<p>{self.prose()}{MAIN}" + ("</p>" if r.random() < 0.8 else ""))
            elif x < 0.70:
                out.append(f"<p><b>{self.sentence()}{MAIN}<br><p>{self.prose()}{MAIN}</p>")
            elif x < 0.80:
                out.append(f"<h{(k := r.choice([2, 2, 3, 4]))}>{self.words(1, 7)}{MAIN}</h{k}>")
            elif x < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.sentence()}{MAIN}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.90:
                out.append(f"<blockquote>{f'<p>{self.prose()}{MAIN}</p>' if r.random() < 0.5 else self.prose() + MAIN}</blockquote>")
            elif x < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}{MAIN}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.96:
                out.append(f"<pre>{self.words(3, 20)}{MAIN}</pre>")
            else:
                out.append(f"<div>{self.prose()}{MAIN}</div>")
        for x in inside:
            out.insert(r.randint(0 if x != "comments" else len(out), len(out)), self.rest(x))
        body = "".join(out)
        tag, names = r.choice([("article", [""]), ("article", ["post", "article", "entry"]), ("div", ["content", "article", "post", "entry-content", "article-body", "story", "main", "text"]), ("main", [""]), ("section", ["content", "article", "post"]), ("div", [""])])
        if r.random() < 0.2:
            body = self.named("div", ["body", "text", "content", "inner", ""], body)
        return self.named(tag, names, body)

    def page(self) -> str:
        r = self.r
        some = lambda kinds, p: [k for k in kinds if r.random() < p]
        before, after = some(["header", "nav", "notice", "ad", "form", "side"], 0.4), some(["side", "ad", "comments", "share", "notice", "form", "nav"], 0.3) + some(["footer"], 0.8)
        r.shuffle(before)
        main = self.article(some(["ad", "share", "side", "form", "notice", "comments"], 0.12))
        middle = [main, *[self.rest(k) for k in some(["side", "comments", "ad"], 0.2)]]
        inner = "".join(self.rest(k) for k in before) + (self.named(r.choice(["div", "main"]), ["page", "wrapper", "container", "layout", ""], "".join(middle)) if r.random() < 0.5 else "".join(middle)) + "".join(self.rest(k) for k in after)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{inner}</body></html>"


def labelled(n: int, seed: int = 7) -> list[str]:
    """n marked pages."""
    return [_Writer(seed * 1_000_003 + k).page() for k in range(n)]
