"""Labelled pages of many layouts: what stands between [[ and ]] is content, a block for each pair. {p} is a paragraph, {s} a
sentence, {w} a few words, {m} a list of links."""

import random
import re

SYLLABLES = "ka ri to mel an so ve dun lo par est mi gra nor ti che wal en bu fos".split()

LAYOUTS = {
    "semantic": "<header><a href=/>{w}</a></header><nav>{m}</nav><main><article><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{s}]]</p><p>[[{p}]]</p></article></main><aside><h3>{w}</h3>{m}</aside><footer>&copy; {w} {s}</footer>",
    "advert first": "<nav>{m}</nav><div class=ad>{s} {s}</div><article><h1>[[{w}]]</h1><p><b>[[{p}]]<br><p>[[{p}]]</p><p>[[{one}.]]</p><p>[[{p}]]</p></article><footer>&copy; host &middot; {s}</footer>",
    "div soup": "<div id=x1><a href=/>{w}</a> <a href=/b>{w}</a> <a href=/c>{w}</a></div><div id=x2><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{one}.]]</p><p>[[{p}]]</p><p>[[{w}]]</p><p>[[{p}]]</p></div><div id=x3>{m}</div><div id=x4>Copyright {w}. All rights reserved.</div>",
    "blog": "<div id=masthead><p>{s}</p></div><div class=menu-main>{m}</div><div id=content><div class='post hentry'><h2>[[{w}]]</h2><div class=entry-content><p>[[{p}]]</p><ul><li>[[{w}]]</li><li>[[{w}]]</li></ul><p>[[{p}]]</p></div></div><div id=comments><h3>{w}</h3><ol><li><p>{p}</p></li><li><p>{s}</p></li></ol></div></div><div class=sidebar><p>{s}</p>{m}</div>",
    "comments as articles": "<main><article class=post><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{p}]]</p></article><section id=comments><article class=comment-body><p>{p}</p></article><article class=comment-body><p>{s} {s}</p></article><form><p>{s}</p><textarea>x</textarea></form></section></main>",
    "cookie notice": "<div class=cookie-notice><p>We use cookies. {s} {s}</p><button>{w}</button></div><div class=container><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{p}]]</p></div>",
    "bare notice": "<div class=q7>We use cookies to improve this site, see our privacy policy. <a href=/p>{w}</a></div><div class=q8><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{p}]]</p><p>[[{s}]]</p></div>",
    "one form around": "<form id=aspnetForm><div class=nav>{m}</div><div class=page><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{p}]]</p></div><div class=footer>{s}</div></form>",
    "advert inside": "<article><h1>[[{w}]]</h1><p>[[{p}]]</p><div class=ad-slot><p>{s}</p></div><p>[[{p}]]</p><div class=newsletter-box><p>Subscribe to our newsletter. {s}</p></div><p>[[{p}]]</p></article>",
    "share price": "<div class=nav>{m}</div><div class=share-price-report><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{p}]]</p></div><div class=share-bar><a href=x>{w}</a> <a href=y>{w}</a></div>",
    "tags explained": "<div class=tags-explained><p>[[{p}]]</p><p>[[{p}]]</p><p>[[{p}]]</p></div><div class=tags><a href=1>{one}</a><a href=2>{one}</a></div>",
    "table": "<table><tr><td class=nav>{m}</td><td><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{p}]]</p></td><td class=promo>{s}</td></tr></table>",
    "wrapper named": "<div class='content-sidebar-wrap'><main class=content><article><header><h1>[[{w}]]</h1></header><p>[[{p}]]</p><blockquote>[[{s}]]</blockquote><p>[[{p}]]</p></article></main><aside class=sidebar><p>{s}</p></aside></div>",
    "headings": "<nav>{m}</nav><main><h1>[[{w}]]</h1><h2>[[{w}]]</h2><p>[[{p}]]</p><h2>[[{w}]]</h2><p>[[{p}]]</p><h2>[[{one}]]</h2><p>[[{p}]]</p></main><footer>{m}<p>{s}</p></footer>",
    "links in text": "<div class=menu>{m}</div><div class=text><p>[[{s} <a href=x>{w}</a> {s}]]</p><p>[[{p}]]</p><p>[[<a href=y>{w}</a>]]</p><p>[[{p}]]</p></div><div class=related><h4>{w}</h4>{m}</div>",
    "stray quotes": "<p class=\"skip\"><a href=#m>Skip to content</a></p><div id=m><h1>[[{w}]]</h1><p class=\"x\" title=\"5\" tall\">[[{p}]]</p><p data-x='a>b'>[[{p}]]</p></div>",
    "pagination": "<article><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{p}]]</p></article><div class=pagination><a href=1>1</a> <a href=2>2</a> <a href=3>{w}</a></div><div class=social-links><a href=f>{one}</a> <a href=t>{one}</a></div>",
    "login": "<header class=site-header><div class=logo>{w}</div><form class=login><label>{one}</label><input></form></header><div role=main><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{p}]]</p></div><div role=contentinfo><p>{s}</p></div>",
    "hidden": "<div hidden><p>{p}</p></div><div style='display: none'>{p}</div><section><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{p}]]</p><pre>[[{w}]]</pre></section>",
    "byline header": "<article><header class=entry-header><h1>[[{w}]]</h1></header><div class=entry-content><p>[[{p}]]</p><figure><img><figcaption>[[{s}]]</figcaption></figure><p>[[{p}]]</p></div><footer class=entry-footer><a href=a>{w}</a> {w}</footer></article>",
    "teasers": "<div class=top-nav>{m}</div><div class=story><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{p}]]</p></div><div class=recommended><div><h4><a href=1>{w}</a></h4><p>{s}</p></div><div><h4><a href=2>{w}</a></h4><p>{s}</p></div></div>",
    "breadcrumbs": "<ol class=breadcrumb><li><a href=/>{one}</a></li><li><a href=/x>{w}</a></li></ol><div id=bodyContent><h1>[[{w}]]</h1><p>[[{p}]]</p><dl><dt>[[{w}]]</dt><dd>[[{s}]]</dd></dl><p>[[{p}]]</p></div><div id=footer><ul><li>{s}</li></ul></div>",
    "alert inside main": "<main><div role=alert>{s}</div><div class=breadcrumbs><a href=/>{w}</a></div><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{p}]]</p><div class=widget><p>{s}</p></div></main>",
    "modal": "<div class='modal popup'><h2>{w}</h2><p>{s} {s}</p></div><div class=wrapper><div class=main-text><p>[[{p}]]</p><p>[[{p}]]</p><p>[[{one}!]]</p><p>[[{p}]]</p></div></div><div class=legal>{s}</div>",
    "discussion": "<div class=article><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{p}]]</p></div><div class=discussion><div class=reply><p>{p}</p></div><div class=reply><p>{s}</p></div></div>",
    "short article": "<nav>{m}</nav><div class=ad>{s}</div><article><h1>[[{w}]]</h1><p>[[{one}.]]</p></article><footer>{s}</footer>",
    "site name": "<header><h1>{w}</h1><p>{s}</p></header><nav>{m}</nav><div id=content><h2>[[{w}]]</h2><p>[[{p}]]</p><p>[[{p}]]</p></div><footer><h4>{w}</h4><p>{s}</p></footer>",
    "site name and article": "<header><h2>{w}</h2></header><article><h1>[[{w}]]</h1><p>[[{s}]]</p><div class=ad>{s}</div><p>[[{one} <a href=x>{w}</a> {one}.]]</p><form><p>{s}</p><input></form></article><aside><p>{s}</p></aside>",
    "text in the container": "<div class=toolbar><span>{w}</span></div><div class=story-body>[[{p}<br><br>{p}]]<p>[[{s}]]</p></div><div id=side>{m}</div>",
    "plain": "<p>[[{p}]]</p><p>[[{s}]]</p><p>[[{p}]]</p>",
    "untold comments": "<div id=x1>{m}</div><div id=x2><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{p}]]</p><p>[[{s}]]</p></div><div id=x3><h3>Comments</h3><div><b>{w}</b> {w}<p>{p}</p></div><div><b>{w}</b> {w}<p>{p}</p></div><div><b>{w}</b> {w}<p>{s}</p></div></div>",
    "more stories": "<article><h1>[[{w}]]</h1><p>[[{p}]]</p><p>[[{p}]]</p><div class=z><h3>More stories</h3><p><a href=1>{w}</a> {s}</p><p><a href=2>{w}</a> {s}</p></div></article><div class=site-info>{s}</div>",
    "author box": "<article><h1>[[{w}]]</h1><p>[[{p}]]</p><h2>[[{w}]]</h2><p>[[{p}]]</p><div class=author-bio><p>{s} {s}</p></div></article><section><h2>3 responses</h2><p>{p}</p><p>{s}</p></section>",
    "odd names": "<form id=aspnetForm><div class=page><div class=reader><p>[[{p} {p}]]</p><p>[[{p} {p} {p}]]</p><p>[[{p} {p}]]</p><p>[[{s}]]</p></div></div><div class=tag>{s}</div></form>",
    "search and menu": "<div id=search><form><p>{w}</p></form></div><ul id=menu><li><a href=1>{one}</a><li><a href=2>{one}</a><li><a href=3>{w}</a></ul><div class=prose><h1>[[{w}]]</h1><p>[[{p}]]</p><ol><li>[[{s}]]</li><li>[[{s}]]</li></ol></div><p class=copyright>{s}</p>",
}


def page(layout: str, seed: int) -> tuple[str, list[str]]:
    """(html, texts of its content blocks) of a layout with invented words."""
    draw = random.Random(f"{layout} {seed}")

    def word() -> str:
        return "".join(draw.choice(SYLLABLES) for _ in range(draw.randrange(1, 4)))

    def words(n: int) -> str:
        return " ".join(word() for _ in range(n)).capitalize()

    def fill(m: re.Match) -> str:
        kind = m[1]
        if kind == "one":
            return words(1)
        if kind == "w":
            return words(draw.randrange(2, 6))
        if kind == "s":
            return words(draw.randrange(6, 20)) + "."
        if kind == "p":
            return " ".join(words(draw.randrange(6, 18)) + "." for _ in range(draw.randrange(2, 6)))
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(draw.randrange(1, 3))}</a></li>' for _ in range(draw.randrange(3, 8))) + "</ul>"

    text = re.sub(r"\{(one|w|s|p|m)\}", fill, LAYOUTS[layout])
    content = [" ".join(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")).split()) for x in re.findall(r"\[\[(.*?)\]\]", text)]
    text = text.replace("[[", "").replace("]]", "")
    return f"<!DOCTYPE html><html><head><title>{words(3)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{text}</body></html>", content
