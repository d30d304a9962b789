"""Made-up pages with known main text, on which the extraction model is trained.

Layouts, wrappers, class names and what stands around and within an article vary at random. Blocks of main text
carry the attribute ``data-main``, which is a label and no feature.
"""

from __future__ import annotations

import random

MAIN = ' data-main="1"'
WRAP = ("article", "content", "post", "entry-content", "story-body", "main-text", "article-body", "post-content", "blog-post", "c1", "x-wrap", "col-8", "")
SIDE = ("sidebar", "side", "widget-area", "right-rail", "secondary", "col-4")
NOISE = ("row", "box", "clearfix", "container", "wrap", "inner", "u-mt", "grid", "block", "")


def words(r: random.Random, low: int, high: int) -> str:
    """A sentence of invented words, now and then with a comma or a character reference."""
    parts = ["".join(r.choice(("ta", "re", "mi", "on", "es", "qu", "lo", "in", "ar", "th")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    for i in range(6, len(parts), 9):
        parts[i] += ","
    if r.random() < 0.1:
        parts.insert(0, "&amp;")
    return " ".join(parts).capitalize() + r.choice((".", ".", "."))


def para(r: random.Random) -> str:
    n = r.choice((1, 1, 2, 3, 5, 8))
    if r.random() < 0.15:  # shouting, symbols after each word, no sentence marks
        odd = r.choice(("!!", "***", " |", "###", "", " -"))
        text = " ".join(w + odd for w in " ".join(words(r, 2, 22) for _ in range(n)).split())
        return r.choice((text, text.upper(), text.replace(".", "")))
    return " ".join(words(r, 1 if n == 1 else 4, 22) for _ in range(n))


def tag(r: random.Random, name: str, inner: str, cls: str = "", extra: str = "") -> str:
    names = " ".join(x for x in (cls, r.choice(NOISE)) if x)
    how = r.random()
    attr = "" if not names else f' id="{names.split()[0]}"' if how < 0.2 else f' class="{names}"'
    return f"<{name}{attr}{extra}>{inner}</{name}>"


def links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{words(r, 1, 3)[:-1]}</a></li>' for i in range(n))


def around(r: random.Random, kind: str) -> str:
    """One piece that is no main text."""
    some = [para(r) for _ in range(r.randint(1, 3))]
    texts = "".join(f"<p>{t}</p>" for t in some)
    if kind == "menu":
        inner = f"<ul>{links(r, r.randint(3, 9))}</ul>"
        return tag(r, "nav", inner) if r.random() < 0.6 else tag(r, r.choice(("div", "ul")), inner, r.choice(("menu", "nav", "navbar", "breadcrumbs", "main-menu", "top-nav")))
    if kind == "header":
        inner = r.choice((f"<h1>{words(r, 1, 3)}</h1>", f"<a href='/'>{words(r, 1, 2)}</a>", f"<p>{words(r, 2, 6)}</p>", ""))
        inner += r.choice(("", f"<p>{words(r, 2, 9)}</p>"))
        return tag(r, "header", inner) if r.random() < 0.6 else tag(r, "div", inner, r.choice(("header", "masthead", "site-header", "banner", "topbar")))
    if kind == "footer":
        inner = r.choice((f"&copy; {words(r, 2, 8)}", f"<p>&copy; {words(r, 3, 9)}</p>", f"<ul>{links(r, 4)}</ul><p>{words(r, 2, 9)}</p>", texts))
        return tag(r, "footer", inner) if r.random() < 0.6 else tag(r, "div", inner, r.choice(("footer", "site-footer", "copyright", "legal")))
    if kind == "side":
        inner = "".join(r.choice((f"<h3>{words(r, 1, 4)}</h3><p>{para(r)}</p>", f"<ul>{links(r, 5)}</ul>", f"<div><p>{para(r)}</p></div>")) for _ in range(r.randint(1, 4)))
        return tag(r, "aside", inner) if r.random() < 0.5 else tag(r, r.choice(("div", "section")), inner, r.choice(SIDE))
    if kind == "ad":
        inner = r.choice((words(r, 2, 12), f"<p>{words(r, 2, 14)}</p>", f'<a href="/x">{words(r, 2, 8)}</a>', texts))
        return tag(r, r.choice(("div", "div", "div", "section", "aside", "p", "span")), inner, r.choice(("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement", "ad-banner")))
    if kind == "notice":
        inner = r.choice((words(r, 4, 20), f"<p>{words(r, 4, 20)}</p><button>{words(r, 1, 2)}</button>", texts))
        return tag(r, r.choice(("div", "div", "section", "aside", "p")), inner, r.choice(("cookie", "cookie-notice", "notice", "consent", "gdpr-banner", "alert", "popup", "modal", "disclaimer")))
    if kind == "comment":
        each = "".join(r.choice((f"<li><p>{para(r)}</p></li>", f'<div class="comment"><b>{words(r, 1, 2)}</b><p>{para(r)}</p></div>', f"<p>{para(r)}</p>")) for _ in range(r.randint(1, 6)))
        inner = r.choice(("", f"<h2>{words(r, 1, 3)}</h2>", "<h3>Comments</h3>")) + (f"<ol>{each}</ol>" if each.startswith("<li") else each)
        return tag(r, r.choice(("section", "div", "div", "aside")), inner, r.choice(("comments", "comment-list", "reader-comments", "discussion", "responses", "disqus")))
    if kind == "form":
        inner = f"<label>{words(r, 1, 4)}</label><input type='text'>" + r.choice(("", f"<p>{words(r, 3, 14)}</p>")) + f"<button>{words(r, 1, 2)}</button>"
        form = tag(r, "form", inner, r.choice(("", "search", "newsletter", "subscribe")))
        return form if r.random() < 0.6 else tag(r, "div", r.choice(("", f"<h3>{words(r, 2, 6)}</h3>")) + form, r.choice(("newsletter", "signup", "subscribe-box", "search")))
    if kind == "share":
        return tag(r, "div", r.choice((f"<ul>{links(r, 3)}</ul>", f'<a href="#">{words(r, 1, 2)}</a> <a href="#">{words(r, 1, 2)}</a>')), r.choice(("share", "social", "share-buttons")))
    inner = f"<h3>{words(r, 1, 4)}</h3>" + r.choice((f"<ul>{links(r, 4)}</ul>", f'<div><a href="/y">{words(r, 3, 9)}</a><p>{para(r)}</p></div>' * 2))
    return tag(r, r.choice(("div", "section", "aside")), inner, r.choice(("related", "recommended", "more-stories", "trending", "teasers")))


KINDS = ("menu", "header", "footer", "side", "ad", "notice", "comment", "form", "share", "related")


def main_blocks(r: random.Random) -> list[str]:
    """Blocks of an article; some are closed badly."""
    out = []
    for _ in range(r.choice((1, 2, 3, 5, 8, 13, 30))):
        kind = r.random()
        if kind < 0.72:
            text = para(r)
            if r.random() < 0.15:
                text = text.replace(" ", f' <a href="/z">{words(r, 1, 2)[:-1]}</a> ', 1)
            out.append(r.choice((f"<p{MAIN}>{text}</p>",) * 5 + (f"<p{MAIN}><b>{text}<br>", f"<p{MAIN}>{text}")))
        elif kind < 0.8:
            out.append(f"<h{r.choice('23')}{MAIN}>{words(r, 1, 8)}</h2>".replace("</h2>", "") + "</h2></h3>")
        elif kind < 0.86:
            name = r.choice(("ul", "ol"))
            out.append(f"<{name}{MAIN}>" + "".join(f"<li{MAIN}>{words(r, 1, 18)}</li>" for _ in range(r.randint(1, 6))) + f"</{name}>")
        elif kind < 0.9:
            out.append(f"<blockquote{MAIN}><p{MAIN}>{para(r)}</p></blockquote>")
        elif kind < 0.93:
            out.append(f"<pre{MAIN}>{words(r, 2, 12)}</pre>")
        elif kind < 0.96:
            out.append(f"<table{MAIN}>" + "".join(f"<tr{MAIN}><td{MAIN}>{words(r, 1, 3)}</td><td{MAIN}>{words(r, 1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        elif kind < 0.98:
            out.append(f"<figure{MAIN}><img src='a'><figcaption{MAIN}>{words(r, 2, 9)}</figcaption></figure>")
        else:
            out.append(f"<div{MAIN}>{para(r)}</div>")
    return out


def page(r: random.Random) -> str:
    body = main_blocks(r)
    head = f"<h1{MAIN}>{words(r, 1, 9)}</h1>"
    if r.random() < 0.75:
        body.insert(0, r.choice((head, head, f"<header{MAIN}>{head}</header>")))
    if r.random() < 0.5:  # what stands within the article and is not of it
        for _ in range(r.randint(1, 3)):
            body.insert(r.randint(0, len(body)), around(r, r.choice(("ad", "ad", "share", "related", "form", "notice", "comment", "side", "menu"))))
    inner = "".join(body)
    how = r.random()
    if how < 0.45:
        inner = tag(r, "article", inner, r.choice(("", "", *WRAP)), MAIN)
    elif how < 0.6:
        inner = tag(r, "main", inner, r.choice(("", *WRAP)), MAIN)
    elif how < 0.95:
        inner = tag(r, r.choice(("div", "section")), inner, r.choice(WRAP), MAIN)
    for _ in range(r.choice((0, 0, 1, 2))):
        inner = tag(r, r.choice(("div", "section", "main")), inner, r.choice(("", "main", "container", "content", "wrapper", "page")), MAIN)
    before = [around(r, k) for k in ("notice", "menu", "header", "ad", "form") if r.random() < 0.5]
    after = [around(r, k) for k in ("side", "comment", "related", "ad", "form", "notice", "footer") if r.random() < 0.5]
    r.shuffle(before)
    if r.random() < 0.3:
        cut = r.randint(0, len(after))
        inner = tag(r, "div", inner + "".join(after[:cut]), r.choice(("", "container", "wrapper", "page", "main")), MAIN)
        after = after[cut:]
    return f"<!DOCTYPE html><html><head><title>{words(r, 1, 8)}</title><style>p{{}}</style></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>"


def pages(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [page(r) for _ in range(n)]
